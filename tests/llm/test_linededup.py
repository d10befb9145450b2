import hashlib
import random

import numpy as np
import pytest

from statemill.llm import linededup as ld

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(docs, least=20, docs_needed=3):
    held = {}
    for i, t in docs:
        if i is not None and t is not None:
            for k in {key(x) for x in t.split("\n")}:
                if len(k) >= least:
                    held.setdefault(k, []).append(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        go = [i is not None and len(h := held.get(key(x), [])) >= docs_needed and max(h) != i for x in lines]
        kept = "\n".join(x for x, g in zip(lines, go) if not g)
        out.append((i, len(lines), sum(go), None if t is None else kept))
    return sorted(out, key=repr)


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, 7, None) for i, t in docs], "doc_id long, text string, n_lines int, h1 string")
    out = ld.dedup_lines(spark, df, **kw)
    assert out.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=repr)


def test_small_cases(spark):
    long = "This very line stands in many documents"
    docs = [(1, f"{long}\nown one"), (2, f"  {long.upper()}\t\n{long}"), (3, long), (4, ""), (5, None), (None, long), (6, "é" * 19 + "\n" + "x" * 20), (7, "é" * 19 + "\n" + "x" * 20), (8, "é" * 19 + "\n" + "x" * 20), (8, "X" * 20 + "\r"), (9, "\n\n")]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []


def test_hot_line_is_salted_and_nothing_is_lost(spark):
    rng = random.Random(5)
    pool = [f"shared line number {k} with enough text" for k in range(60)]
    hot = "the line that a third of all documents hold"
    docs = [(i, "\n".join(rng.choices(pool, k=3) + [f"own line of document {i} alone"] + [hot] * (i % 3 == 0))) for i in range(1500)]
    assert run(spark, docs, lines_per_shard=100) == brute(docs)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, np.uint64))
    f = ld.PerfectHash.of(keys)
    assert sorted(f.slots(keys).tolist()) == list(range(len(keys)))


def test_shard_round_trip():
    r = np.random.default_rng(1)
    h1, h2, last = (r.integers(-(2**62), 2**62, 5000) for _ in range(3))
    counts = r.integers(3, 9, 5000)
    s = ld.Shard(ld.pack_shard(h1, h2, counts, last))
    found, n, most = s.probe(h1, h2)
    assert found.all() and (n == counts).all() and (most == last).all()
    assert not s.probe(h1, h2 + 1)[0].any() and not s.probe(h1 + 1, h2)[0].any()


def test_query_digest(spark, tmp_path):
    from statemill.llm.queries import op5_line_dedup

    text = "one line of twenty characters\nshort"
    spark.createDataFrame([(1, text), (2, text), (3, text), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op5_line_dedup(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (2, 1, sha("short")), 2: (2, 1, sha("short")), 3: (2, 0, sha(text)), 4: (1, 0, sha(""))}
