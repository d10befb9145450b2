import pytest
import test_decontaminate
import test_linededup
import test_ngramjoin

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage gets and gives, as the check tool runs them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("steps") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(steps):
    for _, before, after in steps[:-1]:
        assert after.dtypes == before.dtypes
    assert steps[-1][2].columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "round_trip"]


def test_quality(steps, spark):
    before, after = texts(steps[0][1]), texts(steps[0][2])
    rated = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert after.items() <= before.items()
    good = [i for i, q in rated.items() if q == (1, 0)]
    assert sum(i in after for i in good) >= 0.95 * len(good)


def test_lines(steps):
    before, after = texts(steps[1][1]), texts(steps[1][2])
    want = {i: t for i, _, n, t in test_linededup.brute(list(before.items())) if not n or t.strip(test_linededup.BLANK)}
    assert after == want
    assert all(r.n_chars == len(r.text) for r in steps[1][2].collect())


def test_copies(steps):
    before, after = texts(steps[2][1]), texts(steps[2][2])
    assert after == {i: before[i] for i, _, low in test_ngramjoin.brute(list(before.items())) if i == low}


def test_contamination(steps, spark):
    before, after = texts(steps[3][1]), texts(steps[3][2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert after == {i: before[i] for i, *_, hit in test_decontaminate.brute(list(before.items()), items) if not hit}


def test_tokens(steps):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=cp.PIECE_MODEL)
    before = texts(steps[4][1])
    rows = steps[4][2].collect()
    assert {r.doc_id for r in rows} == before.keys() and len(rows) == len(before)
    for r in rows:
        assert r.token_ids == own.encode(before[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.round_trip == (own.decode(r.token_ids) == before[r.doc_id])


def test_run_gives_the_same_rows(steps, spark):
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, steps[-1][2].collect()))
