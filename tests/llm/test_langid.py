import numpy as np
import pytest

from statemill.llm import langid as li

SAY = {"aa": ["kolo mita sun", "mita kolo kolo", "sunmi takolo"], "bb": ["xerx yogg wuzz", "yoggyogg xerx", "wuzz xerx"], "cc": ["änä öly üpü", "ölyöly änä", "üpü öly"]}
QUICK = li.Settings(bits=10, rounds=30)


def make(spark, n=60):
    rows = [(f"{c}{i}", SAY[lang][i % 3] + f" {SAY[lang][(i + 1) % 3]}" * (i % 4), lang, 0.5) for i in range(n) for c, lang in (("a", "aa"), ("b", "bb"), ("c", "cc"))]
    return spark.createDataFrame(rows, "doc_id string, text string, lang string, score double")


def test_learns_and_answers_every_case(spark):
    docs = make(spark)
    noise = spark.createDataFrame([("n1", None, "aa", 1.0), ("n2", "123 ... !", "bb", 1.0), ("n3", "", None, 1.0), ("n4", "kolo", None, None), (None, "YOGG wuzz", None, None), ("n5", "xerx yogg " * 30000, None, None)], docs.schema)
    model = li.train(spark, docs.union(noise), settings=QUICK)
    assert model.languages == ["aa", "bb", "cc"]
    out = li.predict(docs.union(noise), model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"]
    rows = {r.doc_id: r for r in out.collect()}
    assert all(r.lang_pred == r.lang and not r.ambiguous for k, r in rows.items() if k and k[0] in "abc")
    assert all((rows[k].lang_pred, rows[k].score, rows[k].ambiguous) == ("und", 0.0, True) for k in ("n1", "n2", "n3"))
    assert rows["n4"].lang_pred == "aa" and rows[None].lang_pred == rows["n5"].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_order_of_rows_does_not_matter(spark):
    a = li.train(spark, make(spark), settings=QUICK)
    b = li.train(spark, make(spark).repartition(7, "text"), settings=QUICK)
    assert np.allclose(a.weights, b.weights, atol=1e-3)


def test_without_labels_or_rows(spark):
    empty = make(spark).limit(0)
    model = li.train(spark, empty, settings=QUICK)
    assert [r.lang_pred for r in li.predict(make(spark, 1), model).collect()] == ["und"] * 3
    assert li.predict(empty, model).count() == 0
    one = li.train(spark, make(spark).where("lang = 'aa'"), settings=QUICK)
    assert {r.lang_pred for r in li.predict(make(spark, 1), one).collect()} == {"aa"}


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 30, 120])
def test_codewords_differ(n):
    code = li.code_words(n)
    assert code.shape[0] == n and len({tuple(r) for r in code}) == n
    apart = ((code[:, None] != code[None]).sum(2) + 99 * np.eye(n)).min()
    assert apart >= (2 ** (n - 2) if n <= 7 else 3)


def test_margins_use_the_whole_text():
    rng = np.random.default_rng(0)
    m = li.Model(["a", "b"], li.code_words(2), rng.normal(size=(len(li.ORDERS) << 8, 1)).astype(np.float32), np.zeros(1), li.Settings(bits=8))
    text = "".join(rng.choice(list("abcde  "), 200_000))
    codes = li._codes(text)
    want = sum(m.weights[p].sum(0, dtype=np.float64) for p in li._features(codes, 8)) / len(codes)
    assert np.allclose(m.margins(text), want)


def test_held_out_accuracy(spark):
    """On the generated table, with the production settings."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = li.predict(docs.where(li.held_out()), li.train(spark, docs.where(~li.held_out())))
    right = out.where("lang_pred = lang").count()
    assert right >= 0.97 * out.count()


def test_copies_do_not_keep_a_language_out(spark):
    few = li.Settings(per_language=5)
    texts = spark.range(200).selectExpr("concat('kolo mita ', char(97 + id % 26), char(97 + id div 26)) AS text")
    late = [r.text for r in texts.where("pmod(xxhash64(text), 1 << 30) >= (1 << 30) * 0.5").orderBy("text").limit(2).collect()]
    early = [r.text for r in texts.orderBy("text").limit(40).collect()]
    rows = [(t, "copies") for t in late * 500] + [(t, "mixed") for t in early] + [(early[0], "mixed")] * 1000
    got = [(r.lang, r.text) for r in li.sample(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", few).collect()]
    assert sorted(t for lang, t in got if lang == "copies") == sorted(late)
    assert len(got) == len(set(got)) and sum(lang == "mixed" for lang, _ in got) == 5


def test_every_language_is_learned(spark):
    rows = [(f"{chr(0x4E00 + k)} text {j}", f"l{k:03}") for k in range(250) for j in range(3)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = [r.lang for r in li.sample(df, "text", "lang", li.Settings(most_rows=500)).collect()]
    assert len(set(got)) == 250 and len(got) == 500
    assert len({r.lang for r in li.sample(df, "text", "lang", li.Settings(most_rows=10)).collect()}) == 250


def test_letters_whose_lower_case_is_two_characters_count():
    assert [chr(c) for c in li._codes("İ")] == [" ", "i", " "]
    assert [c for c, low in enumerate(li._letters()) if low != 32] == [c for c in range(65536) if chr(c).isalpha()]
