import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from statemill.llm import ngramjoin as nj
from statemill.llm.shared import Scratch, lookup


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(docs):
    sets, low = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}
    find = lambda i: i if low[i] == i else find(low[i])
    for a, b in combinations(sets, 2):
        o = len(sets[a] & sets[b])
        if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
            x, y = sorted((find(a), find(b)))
            low[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, node int, key string")
    return sorted(tuple(r) for r in nj.jaccard_components(spark, df, settings=nj.Settings(**kw)).collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijkl") + rng.choice("xyz")
    docs, common = [], [word() for _ in range(30)]
    for _ in range(n):
        body = [word() for _ in range(rng.choice([1, 3, 6, 20, 60]))]
        if rng.random() < 0.3:
            body += common
        docs.append(body)
    for _ in range(2 * n):  # chains and groups of near copies, at and around the threshold
        body = list(rng.choice(docs))
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            body[rng.randrange(len(body))] = word()
        docs.append(body[: rng.choice([len(body), len(body), max(1, len(body) * 5 // 6)])])
    rng.shuffle(docs)
    return [(1000 - 2 * i, rng.choice([" ", "\n", " \t"]).join(b)) for i, b in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    docs = corpus(seed)
    assert run(spark, docs, chunk_chars=500) == brute(docs)


def test_odd_rows(spark):
    docs = [(5, "one two three four five six"), (3, "One two\nthree four FIVE six"), (9, None), (8, ""), (7, " \t\n"), (6, "few words"), (2, "few WORDS"), (1, "words few")]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []
    repeated = [(4, "a b c d e f")] * 3 + [(None, "a b c d e f"), (2, "a b c d e f")]
    got = spark.createDataFrame(repeated, "doc_id long, text string")
    rows = [tuple(r) for r in nj.jaccard_components(spark, got, settings=nj.Settings()).collect()]
    assert sorted(rows, key=repr) == [(2, 2, 2), (4, 2, 2), (4, 2, 2), (4, 2, 2), (None, 2, None)]


def test_large_group_of_near_copies_makes_few_pairs(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    docs = []
    for i in range(400):
        body = list(base)
        body[rng.randrange(300)] = f"own{i}"
        docs.append((i, " ".join(body)))
    docs.append((999, "x " + " ".join(base[:100])))
    s = nj.Settings(sketch_bits=18)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.sparkContext.broadcast(bytes((1 << s.sketch_bits) // 8))
    held = df.select("text").mapInArrow(nj._postings(none, s), nj._POSTING_SCHEMA).repartition(3, "key").sortWithinPartitions("key", "h").mapInArrow(nj._only_shared, nj._POSTING_SCHEMA)
    held = held.select("key", "h", "l", F.expr("cast(meta >> 4 as int)").alias("k"), F.expr("cast(meta >> 1 & 7 as int)").alias("c")).cache()
    nodes = held.select("h", "l").distinct().withColumns({"node": F.xxhash64("h"), "n": F.lit(296)})
    assert nj.star_pairs(nj.prefixes(held, nodes, s), s).count() <= 2 * len(docs)
    assert run(spark, docs) == brute(docs)


def test_shared_rows_survive_batch_bounds():
    import pyarrow as pa

    rows = sorted((k, n // 2, n, 33 if k == 5 else 32) for k, count in ((1, 1), (2, 3), (3, 1), (4, 2), (5, 1)) for n in range(count) for _ in range(1 + (n == 1)))
    want = sorted({r for r in rows if r[0] in (2, 4, 5)})
    for cuts in combinations(range(len(rows) + 1), 2):
        parts = [rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :]]
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array([r[i] for r in p], np.int64)) for i in range(4)], nj._POSTING) for p in parts]
        assert sorted(tuple(r.values()) for b in nj._only_shared(iter(batches)) for r in b.to_pylist()) == want


def test_fragments_cover_the_order():
    s = nj.Settings(classes=((0, 1.0), (50, 0.25)), fragments=5, sketch_bits=16)
    assert nj.fragment_bounds(1, s) == [2**62, 2**63, 3 * 2**62]
    common = np.zeros(1 << s.sketch_bits, np.uint8)
    common[5] = 1
    own = np.sort(np.concatenate([np.random.default_rng(3).integers(0, 2**64, 400, np.uint64), np.array([5, 2**63 + 5], np.uint64)]))
    for c in (0, 1):
        head, rest, last = nj.ordered(own, c, common, s)
        assert sorted([*head, *rest, *last]) == own.tolist() and {5, 2**63 + 5} <= set(last.tolist())
        assert all(x < 2**62 for x in head.tolist()) == (c == 1) and (c == 1) == bool(len(rest))


def test_sizes_that_can_link_share_a_class():
    s = nj.Settings()
    for n in range(1, 3000):
        for m in (n, n * 100 // 80):
            c = max(nj.class_of(n, s), nj.class_of(m, s))
            assert c in nj.classes_of(n, s) and c in nj.classes_of(m, s)


def test_partial_overlaps_are_rows_of_pairs_and_fragments(spark):
    segments = spark.createDataFrame([(1, 1, 0, [1, 2, 3]), (1, 1, 1, [7]), (1, 1, 2, []), (2, 1, 0, [2, 3, 4]), (2, 1, 1, [7]), (2, 1, 2, [9])], "node long, c int, fragment int, keys array<long>")
    pairs = spark.createDataFrame([(1, 2, 4, 5, 1, f) for f in range(3)], "a long, b long, n int, m int, c int, fragment int")
    hubs = nj.Hot(pairs, "a"), nj.Hot(pairs, "b")
    got = nj.partial_overlaps(pairs, segments, hubs).orderBy("fragment").collect()
    assert [(r.fragment, r.o, r.x, r.y) for r in got] == [(0, 2, 3, 3), (1, 1, 1, 1), (2, 0, 0, 1)]


CLASSES = (((0, 0.001),), ((0, 0.9),), ((0, 1.0), (10, 0.3), (40, 0.1)))


@pytest.mark.parametrize("classes, common, fragments", [(CLASSES[0], (0, 3), 3), (CLASSES[1], (1, 0), 5), (CLASSES[2], (4, 64), 6)])
def test_any_order_gives_the_same_result(spark, classes, common, fragments):
    docs = corpus(7, 40)
    assert run(spark, docs, classes=classes, fragments=fragments, sketch_bits=10, common=common) == brute(docs)


def test_hot_values_are_dealt_to_several_tasks(spark):
    many = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(2000)], "k long, i long")
    one = spark.createDataFrame([(i, i * 10) for i in range(2000)], "k long, v long")
    hot = nj.Hot(many, "k")
    assert [k for k, _ in hot.rows] == [7]
    hot.rows = [(7, 5)]
    got = sorted(tuple(r) for r in hot.join(many, one, ["k"], "k", deal="i").select("k", "i", "v").collect())
    assert got == sorted((k, i, 10 * k) for i in range(2000) for k in [7 if i % 3 else i])


def test_prefix_meets_every_link():
    s = nj.Settings()
    for n in range(1, 400):
        p = n - nj.needed_of_one(n, s) + 1
        assert 1 <= p <= n
        assert all(o >= nj.needed_of_one(n, s) for m in range(n, 500) for o in (-(-80 * (n + m) // 180),) if m * 80 <= n * 100)
    sets = nj.shingle_sets([b"a b c d e f g", b"A  b\tc d e f g", None, b""], 5)
    assert (sets[0] == sets[1]).all() and len(sets[0]) == 3 and not len(sets[2]) and isinstance(sets[3], np.ndarray)


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def test_jobs_do_not_grow_with_the_partitions(spark):
    rows = [(1, 64 << 14, 0, 0, None, None)] + [(None, None, None, None, b, bytes([200 * (b == 5)] * (1 << 14))) for b in range(64)]
    first = spark.createDataFrame(rows, "doc_id long, n long, h long, l long, block int, counts binary")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        before = jobs(spark)
        bits = np.unpackbits(np.frombuffer(nj.common_counters(first, nj.Settings(sketch_bits=20)), np.uint8))
        assert jobs(spark) - before <= 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert np.flatnonzero(bits).tolist() == list(range(5 << 14, 6 << 14))


def test_prefixes_and_pivots_take_few_shuffles(spark):
    held = spark.createDataFrame([(k, h, 0, 3, 0) for k in range(3) for h in range(4)], "key long, h long, l long, k int, c int")
    nodes = spark.createDataFrame([(h, 0, h, 3) for h in range(4)], "h long, l long, node long, n int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shared = nj.prefixes(held, nodes, nj.Settings())
        shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert shuffles(shared) <= 4
        flat = spark.createDataFrame(shared.collect(), shared.schema)
        assert shuffles(nj.star_pairs(flat, nj.Settings())) <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted((r.key, r.node, r.room) for r in flat.collect()) == [(0, h, 1) for h in range(4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_between_components_join_them(spark, seed):
    rng = random.Random(seed)
    near = [(rng.randrange(300), rng.randrange(300)) for _ in range(90)]
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(60)] + [(i, 399 - i) for i in range(350, 360)] * 30
    rows = lambda links: spark.createDataFrame(links, "src long, dst long")
    scratch = nj.Scratch(spark, "test")
    labels = nj.components(spark, rows(near), scratch)
    got = nj.joined_components(spark, labels, rows(more), scratch)
    want = nj.components(spark, rows(near + more), scratch)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    low = {i: i for link in near + more for i in link}
    for _ in low:
        for a, b in near + more:
            low[a] = low[b] = min(low[a], low[b])
    assert sorted(map(tuple, got.collect())) == sorted(low.items())


def test_repeated_ids_change_no_component(spark):
    docs = corpus(5, 30)
    again = docs[::3] * 2
    want = brute(docs)
    assert sorted(run(spark, docs + again)) == sorted(want + [r for i, _ in again for r in want if r[0] == i])


def test_tables_that_grow_are_not_broadcast(spark):
    with Scratch(spark, "test") as scratch:
        n = 400_000  # under 10 MB on disk, and tens of MB as a hash table
        shared = scratch.save(spark.range(n).select((F.col("id") % (n // 2)).alias("key"), F.xxhash64("id").alias("node"), F.lit(9).cast("long").alias("n"), F.lit(1).alias("room"), F.lit(1.0).alias("common"), F.lit(True).alias("home")))
        labels = scratch.save(spark.range(n).select(F.xxhash64("id").alias("node"), F.xxhash64(F.col("id") % 9).alias("component")))
        s = nj.Settings()
        for df in (nj.star_pairs(shared, s), nj.cross_pairs(shared, labels, s)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan
        few = scratch.save(labels.limit(10))
        assert "Broadcast" in shared.join(lookup(few), "node")._jdf.queryExecution().executedPlan().toString()
