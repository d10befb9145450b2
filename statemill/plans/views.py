"""Deterministic statement views over the star-schema tables, in Spark and, as text, in DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs unchanged on both engines: a ledger for each customer, from the orders.
LEDGER = """
SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx,
       CAST(o_orderdate AS DATE) AS date,
       CASE o_orderkey % 7 WHEN 0 THEN 'Monthly service charge' WHEN 1 THEN 'Interest earned' WHEN 2 THEN 'Payment received'
            WHEN 3 THEN 'Refund of order' WHEN 4 THEN 'Wire fee' ELSE 'Purchase of goods' END AS description,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * CAST(o_totalprice AS DECIMAL(18, 2)) AS DECIMAL(28, 2)) AS amount,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR(20)) END AS check_number,
       CAST(o_orderkey % 3 AS INTEGER) AS page
FROM orders
"""

HEADERS = """
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'CREDIT_CARD' ELSE 'BANK_ACCOUNT' END AS statement_type,
       CAST(c_acctbal AS DECIMAL(28, 2)) AS opening
FROM customer
"""

AMOUNTS = """
SELECT id, k, v, CASE k WHEN 0 THEN s WHEN 1 THEN '$' || s WHEN 2 THEN '(' || s || ')' WHEN 3 THEN s || '-' WHEN 4 THEN s || ' CR'
       WHEN 5 THEN s || ' DR' WHEN 6 THEN s || 'DR' WHEN 7 THEN '+$' || s WHEN 8 THEN '  -' || s || ' ' ELSE 'n/a ' || s END AS text
FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 10 AS k, CAST(l_extendedprice AS DECIMAL(18, 2)) AS v,
             CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR(30)) AS s FROM lineitem) t
"""

CHANGES = """
SELECT event_id, CASE event_type WHEN 'click' THEN 'date' WHEN 'view' THEN 'description' WHEN 'purchase' THEN 'amount' WHEN 'login' THEN 'balance' ELSE 'note' END AS field_name,
       CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL ELSE CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR(30)) END AS old_value,
       CASE WHEN event_id % 3 = 0 THEN CAST(CAST(value AS DECIMAL(18, 2)) + 1 AS VARCHAR(30)) ELSE CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR(30)) END AS new_value,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS confidence, user_id % 50 AS session
FROM events
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries without reported balances and checkpoints."""
    tables(spark, sf_dir, "orders")
    return spark.sql(f"SELECT *, CAST(NULL AS DECIMAL(28, 2)) AS balance, false AS is_balance_forward FROM ({LEDGER})")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer")
    return spark.sql(HEADERS)


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    return spark.sql(AMOUNTS)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(CHANGES)


#: Statements printed from the order lines, four to a page, as words on nominal baselines: role, line number, column.
#: Page 0 has balances, a header, and for every fourth order a section of payments; other pages take its layout over.
_PRICE = "CAST(l_extendedprice AS DECIMAL(18, 2))"
LINES = f"""
SELECT doc, ln, CAST(floor((ln - 1) / 4) AS INTEGER) AS page, 40 + 30 * ((ln - 1) % 4 + 1) AS base, day, part, supp, qty, CASE WHEN ln % 2 = 1 THEN -price ELSE price END AS printed,
       CASE WHEN ln % 2 = 1 OR doc % 4 = 0 THEN -price ELSE price END AS amount
FROM (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS ln, CAST(l_shipdate AS DATE) AS day,
             l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS DECIMAL(18, 2)) AS qty, {_PRICE} AS price FROM lineitem) t
"""
TOTALS = "SELECT doc, sum(amount) AS total, 1000 + sum(amount) + CASE WHEN doc % 2 = 1 THEN 5 ELSE 0 END AS closing FROM lines GROUP BY doc"


#: The same words for every document: role, baseline, x:text.
_FIXED = (("opening", 10, "50:Opening 90:Balance 330:1000.00"), ("header", 40, "50:Date 130:Description 330:Amount 430:Balance"), ("closing", 385, "50:Closing 90:Balance"), ("footer", 400, "50:Page 75:1 85:of 100:2"))


def _fixed(role: str, base: int, words: str) -> str:
    parts = [w.split(":") for w in words.split()]
    return " UNION ALL ".join(f"SELECT doc, 0 AS page, {base} AS base, '{role}' AS role, 0 AS ln, {x} AS x0, '{t}' AS text FROM totals" for x, t in parts)


_CELLS = (
    ("txn", 0, 50, "CAST(day AS STRING)", "true"),
    ("txn", 0, 130, "'ITEM'", "true"),
    ("txn", 0, 155, "'P' || CAST(part AS STRING)", "true"),
    ("txn", 0, 330, "CAST(printed AS STRING)", "true"),
    ("txn", 0, 430, "CAST(qty AS STRING)", "true"),
    ("after", 12, 130, "'LOT'", "ln % 3 = 0"),
    ("after", 12, 150, "'Q' || CAST(supp AS STRING)", "ln % 3 = 0"),
    ("before", -10, 130, "'REF'", "ln % 3 = 2"),
    ("before", -10, 150, "'R' || CAST(ln AS STRING)", "ln % 3 = 2"),
)
WORDS = " UNION ALL ".join(
    [
        *(f"SELECT doc, page, base + {dy} AS base, '{role}' AS role, ln, {x} AS x0, {text} AS text FROM lines WHERE {cond}" for role, dy, x, text, cond in _CELLS),
        *(_fixed(*x) for x in _FIXED),
        _fixed("section", 55, "50:Payments") + " WHERE doc % 4 = 0",
        "SELECT doc, 0 AS page, 385 AS base, 'closing' AS role, 0 AS ln, 330 AS x0, CAST(CAST(closing AS DECIMAL(18, 2)) AS STRING) AS text FROM totals",
    ]
)
_TOKEN = """
CAST(doc AS STRING) AS doc_id, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY base, x0) AS BIGINT) AS ord, text, CAST(x0 AS DOUBLE) AS x0, base + (length(text) % 4) * CAST(0.5 AS DOUBLE) AS y0,
CAST(x0 + 5 * length(text) AS DOUBLE) AS x1, base + 10 + (length(text) % 4) * CAST(0.5 AS DOUBLE) AS y1, 'DIGITAL' AS mode, CAST(CASE length(text) % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.75 ELSE 1 END AS DOUBLE) AS confidence,
CAST(NULL AS DOUBLE) AS font_size, doc, base, role, ln
"""
#: The columns doc, base, role and ln are what the oracles need beside the token's own.
TOKENS = f"WITH lines AS ({LINES}), totals AS ({TOTALS}), words AS ({WORDS}) SELECT {_TOKEN} FROM words"


_IN_LINE = re.compile(r"\b(day|part|supp|printed|qty|ln|base)\b")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, ts): the rows of TOKENS, a page's as one array, printed in one pass over the lines.

    Only lines are shuffled, by document; pages come sorted within each partition, so that what follows along a document
    needs no further exchange or sort.
    """
    tables(spark, sf_dir, "lineitem")
    lines = LINES.replace("FROM lineitem", "FROM (SELECT *, CAST(l_orderkey AS STRING) AS doc_id FROM lineitem)").replace("PARTITION BY l_orderkey", "PARTITION BY doc_id")
    lines = lines.replace("SELECT l_orderkey AS doc,", "SELECT doc_id, l_orderkey AS doc,").replace("SELECT doc, ln,", "SELECT doc_id, doc, ln,")
    per_page = spark.sql(lines).groupBy("doc_id", "page").agg(F.first("doc").alias("doc"), F.sum("amount").alias("moved"), F.collect_list(F.struct("ln", "base", "day", "part", "supp", "qty", "printed")).alias("ls"))
    every = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    closing = F.sum("moved").over(every) + 1000 + F.when(F.col("doc") % 2 == 1, 5).otherwise(0)
    per_page = per_page.withColumn("closing", closing.cast("decimal(18,2)"))
    word = lambda base, x, text: f"named_struct('base', CAST({base} AS INT), 'x0', CAST({x} AS DOUBLE), 'text', {text})"
    own = lambda sql: _IN_LINE.sub(r"l.\1", sql)
    cells = ", ".join(f"if({own(cond)}, {word(f'l.base + {dy}', x, own(text))}, NULL)" for _, dy, x, text, cond in _CELLS)
    fixed = [word(base, x, f"'{t}'") for _, base, words in _FIXED for x, t in (w.split(":") for w in words.split())]
    fixed += [f"if(doc % 4 = 0, {word(55, 50, repr('Payments'))}, NULL)", word(385, 330, "CAST(closing AS STRING)")]
    words = f"flatten(transform(ls, l -> array({cells})))"
    words = f"sort_array(filter(if(page = 0, concat({words}, array({', '.join(fixed)})), {words}), x -> x IS NOT NULL))"
    token = "named_struct('ord', CAST(i + 1 AS BIGINT), 'text', w.text, 'x0', w.x0, 'y0', w.base + (length(w.text) % 4) * 0.5D, 'x1', w.x0 + 5 * length(w.text), 'y1', w.base + 10 + (length(w.text) % 4) * 0.5D, 'mode', 'DIGITAL', 'confidence', CASE length(w.text) % 3 WHEN 0 THEN 0.5D WHEN 1 THEN 0.75D ELSE 1D END, 'font_size', CAST(NULL AS DOUBLE))"
    return per_page.select(F.col("doc_id").alias("doc_id"), F.col("page").alias("page"), F.expr(f"transform({words}, (w, i) -> {token})").alias("ts"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as TOKENS, one for each token."""
    return pages(spark, sf_dir).selectExpr("doc_id", "page", "inline(ts)")
