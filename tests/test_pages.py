"""The page layer: one row a page, so that no token is shuffled beside the lines that it is printed from."""

import re

import pytest
import statements

from statemill.operators import geometry as g
from statemill.plans import token_queries, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["t14_token_lanes", "t17_row_classes", "t21_transactions", "t23_provenance", "t24_diagnostics"])
def test_only_the_lines_are_shuffled(spark, name):
    plan = token_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?m)^\W*(?:\*\(\d+\) )?Exchange ", plan)) == 1
    assert "Join" not in plan


def test_pages_and_tokens_give_the_same(spark):
    tokens = spark.createDataFrame(statements.bank_statement() + statements.card_statement(), g.TOKEN_SCHEMA)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(g.transactions(g.pages(tokens))) == key(g.transactions(tokens.repartition(5, "text")))
    assert key(views.tokens(spark, SF).select("doc_id", "page", "ord", "text")) == key(views.pages(spark, SF).selectExpr("doc_id", "page", "inline(ts)").select("doc_id", "page", "ord", "text"))


def test_lanes_of_pages_are_those_of_rows(spark):
    tokens = spark.createDataFrame(statements.bank_statement() + statements.card_statement(), g.TOKEN_SCHEMA)
    old = g.page_layouts(g.lanes(g.header_anchors(g.baselines(tokens)), tokens), tokens)
    key = lambda df: sorted((r.doc_id, r.page, tuple(map(tuple, r.layout))) for r in df.select("doc_id", "page", "layout").collect())
    assert key(g.laid_out(g.page_rows(tokens))) == key(old)


def test_a_word_that_reaches_over_lanes_takes_the_first_of_the_widest(spark):
    from pyspark.sql import functions as F

    lanes = F.array(*(F.struct(F.lit(n).alias("canonical"), F.lit(a).alias("x_min"), F.lit(b).alias("x_max")) for n, a, b in (("date", 0.0, 10.0), ("description", 10.0, 20.0))))
    for x0, x1, want in ((2.0, 8.0, "date"), (5.0, 15.0, "date"), (9.0, 20.0, "description"), (30.0, 31.0, "description"), (10.0, 10.0, "date")):
        assert spark.range(1).select(g.token_lane(F.lit(x0), F.lit(x1), lanes)["canonical"]).first()[0] == want


def test_the_whole_reading_shuffles_only_the_lines(spark):
    plan = token_queries.QUERIES["statement_process"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?m)^\W*(?:\*\(\d+\) )?Exchange ", plan)) == 1
    assert "Join" not in plan and "InMemoryTableScan" not in plan


def test_the_whole_reading_of_odd_documents(spark):
    from decimal import Decimal as D

    from statemill.plans.statement import process

    head = statements.line(0, 40, [("date", "Date"), ("description", "Description"), ("amount", "Amount"), ("balance", "Balance")])
    mark = lambda y, b: statements.line(0, y, [("date", "2024-01-01"), ("description", "Balance forward"), ("balance", b)])
    entry = lambda p, y, a, b: statements.line(p, y, [("date", "2024-01-02"), ("description", "PAPER"), ("amount", a), ("balance", b)])
    docs = {
        "empty": [statements.line(0, 20, [("date", "Opening Balance"), ("amount", "7.00")]), statements.line(1, 20, [("date", "Closing Balance"), ("amount", "9.00")])],
        "mark": [head, mark(80, "5.00")],
        "two": [head, mark(80, "5.00"), entry(0, 120, "-1.00", "4.00"), mark(160, "50.00"), entry(1, 60, "2.50", "52.50")],
        "none": [statements.line(3, 20, [("date", "words")])],
    }
    tokens = spark.createDataFrame(sum((statements.tokens(d, x) for d, x in docs.items()), []), g.TOKEN_SCHEMA)
    columns = ("status", "n_segments", "opening", "closing", "difference", "running_balance_breaks", "deposits_credits", "withdrawals_debits", "segments")
    for keep in (True, False):
        with process(tokens, keep=keep) as done:
            got = {r.doc_id: r for r in done.reconciliation.select("doc_id", *columns).collect()}
            assert sorted((r.doc_id, r.idx) for r in done.transactions.collect()) == [("mark", 0), ("two", 0), ("two", 1), ("two", 2), ("two", 3)]
            assert {r.doc_id: r.opening_source for r in done.balances.collect()} == {"empty": "summary_band", "mark": "checkpoint", "two": "checkpoint", "none": "summary_band"}
            assert len(done.types.collect()) == len(done.summaries.collect()) == len(done.payload().collect()) == 4
        assert tuple(got["empty"])[1:] == ("UNBALANCED", 0, D("7.00"), D("9.00"), D("-2.00"), 0, D("0.00"), D("0.00"), None)
        assert tuple(got["none"])[1:] == ("INSUFFICIENT_DATA", 0, None, None, None, 0, D("0.00"), D("0.00"), None)
        assert tuple(got["mark"])[1:] == ("BALANCED", 0, D("5.00"), D("5.00"), D("0.00"), 0, D("0.00"), D("0.00"), None)
        assert tuple(got["two"])[1:-1] == ("BALANCED", 2, D("5.00"), D("52.50"), D("0.00"), 0, D("2.50"), D("1.00"))
        assert [(x.segment, x.opening_page, x.closing_page, x.transactions) for x in got["two"].segments] == [(0, 0, 0, 1), (1, 1, 1, 1)]


def test_quick_texts_are_read_as_all_others(spark):
    from pyspark.sql import functions as F

    from statemill.functions import money, patterns as p

    blanks = money.BLANKS + "\x1c\x1f\u180e\u200b\ufeff"
    texts = [a + b + c for a in ("", *blanks, "\r\n ") for b in ("x", "", "12.50", "\u00e9 1") for c in ("", *blanks, " \u3000\n")]
    texts += ["-12.5", "123.456", "0.00", "-0", "1" * 15, "1" * 16, "12.345", "+5.00", "5.00\n", "--5.00", "-1234567890123456.00", "\u0661\u0662.\u0665\u0660"]
    found = [r"\b\d{1,2}\b", r"^\W+$", r"\bfee\s", r"[^0-9\s]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    # the quick path is not taken with a blank in front, which counts for nothing
    out = df.select(money.strip(t).alias("a"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "").alias("b"), money.parse_amount(t).alias("c"), money.parse_amount(F.concat(F.lit(" "), t)).alias("d"), *(x for k in found for x in (p.unicode_like(t, k, "i"), t.rlike(f"(?iU){k}"))))
    for r in out.collect():
        assert r[0] == r[1] and r[2] == r[3] and r[4::2] == r[5::2], r
