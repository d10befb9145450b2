import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statemill.llm import quality as q

SMALL = q.Settings(least_docs=3, least_z=2.5, rounds=150)


def texts(n=240):
    rng = random.Random(2)
    words = [f"word{k}" for k in range(50)]
    out = []
    for i in range(n):
        body = rng.choices(words, k=rng.choice([5, 40, 400]))
        grade = i % 4
        if grade == 0:
            body.insert(rng.randrange(len(body)), rng.choice(["awful", "Awful!", "awfulness"]))
        if grade == 1:
            body = [w.upper() + "!!" for w in body]
        out.append((i, " ".join(body), min(grade, 2)))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "doc_id long, text string, accept int")
    rated = spark.createDataFrame([(i, g) for i, _, g in rows if i % 5] + [(None, 1), (3, None), (9999, 2)], "doc_id long, grade int")
    return docs, rated, q.train(spark, docs, rated, settings=SMALL)


def test_held_out_rows_are_graded_right(fitted):
    docs, _, model = fitted
    want = {i: g for i, _, g in texts()}
    assert model.thresholds == sorted(model.thresholds)
    rows = q.score(docs, model).where("doc_id % 5 = 0").collect()
    right = [r.accept == (want[r.doc_id] == 2) for r in rows]
    assert np.mean(right) >= 0.95
    toxic = [r.expected_grade for r in rows if want[r.doc_id] == 0]
    good = [r.expected_grade for r in rows if want[r.doc_id] == 2]
    assert max(toxic) < min(good)


def test_one_telling_word_in_a_long_text(spark, fitted):
    model = fitted[2]
    clean = " ".join(f"word{k % 50} w{k}" for k in range(30000))
    rows = spark.createDataFrame([(1, clean), (2, clean + " awful"), (3, None), (4, ""), (5, "...")], "doc_id long, text string")
    got = {r.doc_id: r for r in q.score(rows, model).collect()}
    assert got[1].accept and not got[2].accept
    assert got[3].tail_prob == got[4].tail_prob and 0 <= got[3].expected_grade <= 2
    assert q.score(rows.limit(0), model).count() == 0


def test_without_ratings(spark, fitted):
    docs, rated, _ = fitted
    model = q.train(spark, docs, rated.limit(0), settings=SMALL)
    r = q.score(docs, model).first()
    assert (r.expected_grade, r.tail_prob, r.accept) == (0.0, 1.0, True)
    assert q.score(docs, model).columns == ["doc_id", "text", "expected_grade", "tail_prob", "accept"]
    one = q.train(spark, docs, rated.where("grade = 0"), settings=SMALL)
    assert q.score(docs, one).count() == docs.count()


def test_grades(spark):
    rows = [(1, 0, 2), (1, 1, 0), (0, 0, 1), (0, 1, 0), (None, 1, 0), (1, None, None), (None, 0, None)]
    df = spark.createDataFrame(rows, "quality int, toxic int, want int").withColumn("grade", q.grades())
    assert all(r.grade == r.want for r in df.collect())


def test_limit_on_rated_rows(spark, fitted):
    docs, rated, _ = fitted
    few = q.train(spark, docs, rated, settings=q.Settings(most_rated=10))
    assert len(few.weights) == 0


def test_production_settings_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rated = spark.read.parquet(f"{sf}/labels.parquet").withColumn("grade", q.grades()).where("grade is not null")
    model = q.train(spark, docs, rated.where(F.col("doc_id") % 4 != 0))
    got = q.score(docs.join(rated.where(F.col("doc_id") % 4 == 0), "doc_id"), model)
    assert got.where("accept = (grade = 2)").count() >= 0.95 * got.count()
    assert got.where("grade = 2 and not accept").count() <= 0.02 * got.where("grade = 2").count()
