"""Queries of the token layer over statements printed from the order lines; their SQL knows the answers from the printing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, summary
from ..sources.tables import reading_order, split_spans
from . import statement, views

_cents = lambda c: (F.col(c) * 100).cast("long").alias(c)
_T = f"WITH t AS ({views.TOKENS})"
_LINES = f"WITH lines AS ({views.LINES}), totals AS ({views.TOTALS})"
_LANE = "CASE WHEN x0 < 108 THEN 'date' WHEN x0 < 251 THEN 'description' WHEN x0 < 396 THEN 'amount' ELSE 'balance' END"
_ROW = "dense_rank() OVER (PARTITION BY doc_id, page ORDER BY base) - 1"


def t1_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.baselines(views.tokens(spark, sf_dir)).select("doc_id", "page", "ord", F.col("row").cast("long").alias("row"), F.col("pos").cast("long").alias("pos"))


T1_SQL = f"{_T} SELECT doc_id, page, ord, {_ROW} AS row, row_number() OVER (PARTITION BY doc_id, page, base ORDER BY x0) - 1 AS pos FROM t"


def t2_page_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.page_heights(views.tokens(spark, sf_dir)).select("doc_id", "page", "page_bottom", "typical")


T2_SQL = f"{_T} SELECT doc_id, page, max(y1) AS page_bottom, CAST(median(y1 - y0) AS DOUBLE) AS typical FROM t GROUP BY doc_id, page"


def t4_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = geometry.overlap(F.col("x0"), F.col("x1"), F.lit(90.0), F.lit(160.0))
    return views.tokens(spark, sf_dir).select("doc_id", "page", "ord", F.round(share, 9).alias("share"))


T4_SQL = f"{_T} SELECT doc_id, page, ord, round(greatest(0, least(x1, 160) - greatest(x0, 90)) / (x1 - x0), 9) AS share FROM t"


def t6_header_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.tokens(spark, sf_dir).select("doc_id", "page", "ord", F.array_join(geometry.header_matches(F.col("text")), ",").alias("columns"))


T6_SQL = f"{_T} SELECT doc_id, page, ord, CASE WHEN text IN ('Date', 'Description', 'Amount', 'Balance') THEN lower(text) WHEN text = 'Payments' THEN 'credit' WHEN text = 'REF' THEN 'check_number' ELSE '' END AS columns FROM t"


def t8_header_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.header_anchors(geometry.baselines(views.tokens(spark, sf_dir)))
    return found.select("doc_id", "page", "canonical", geometry.lane_centre(F.col("xs")).alias("x"))


T8_SQL = f"{_T} SELECT doc_id, page, lower(text) AS canonical, (x0 + x1) / 2 AS x FROM t WHERE role = 'header'"


def _lanes(tokens: DataFrame) -> DataFrame:
    return geometry.lanes(geometry.header_anchors(geometry.baselines(tokens)), tokens)


def t11_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lanes(views.tokens(spark, sf_dir)).select("doc_id", "page", F.col("lane").cast("long").alias("lane"), "canonical", "x_min", "x_max")


T11_SQL = f"""{_T}, edges AS (SELECT doc_id, min(x0) AS l, max(x1) AS r FROM t WHERE page = 0 GROUP BY doc_id), h AS (SELECT doc_id, page, lower(text) AS canonical, (x0 + x1) / 2 AS x FROM t WHERE role = 'header'),
p AS (SELECT *, row_number() OVER w - 1 AS lane, lag(x) OVER w AS a, lead(x) OVER w AS b FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY x))
SELECT p.doc_id, page, lane, canonical, CASE WHEN a IS NULL THEN l ELSE (a + x) / 2 END AS x_min, CASE WHEN b IS NULL THEN r + 1 ELSE (x + b) / 2 END AS x_max FROM p JOIN edges e ON p.doc_id = e.doc_id"""


def t13_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = views.tokens(spark, sf_dir)
    return geometry.page_layouts(_lanes(tokens), tokens).select("doc_id", "page", F.array_join(F.transform("layout", lambda x: x["canonical"]), ",").alias("columns"))


T13_SQL = f"{_T} SELECT DISTINCT doc_id, page, 'date,description,amount,balance' AS columns FROM t"


def t14_token_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.token_lanes(views.pages(spark, sf_dir))


T14_SQL = f"{_T} SELECT doc_id, page, ord, {_LANE} AS canonical FROM t"


def t17_row_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geometry.classified_rows(views.pages(spark, sf_dir))
    return rows.select("doc_id", "page", F.col("row").cast("long").alias("row"), "step", "section", F.coalesce("kind", F.lit("")).alias("kind"))


T17_SQL = f"""{_T}, r AS (SELECT doc_id, doc, page, base, min(role) AS role FROM t GROUP BY ALL)
SELECT doc_id, page, {_ROW} AS row, CASE role WHEN 'txn' THEN 'txn' WHEN 'before' THEN 'desc' WHEN 'after' THEN 'desc' WHEN 'header' THEN 'header' WHEN 'section' THEN 'credit' ELSE 'noise' END AS step,
       CASE WHEN doc % 4 = 0 AND (page > 0 OR base >= 55) THEN 'credit' ELSE 'debit' END AS section, CASE role WHEN 'txn' THEN 'txn' WHEN 'before' THEN 'desc' WHEN 'after' THEN 'desc' ELSE '' END AS kind FROM r"""


def t18_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geometry.attached_rows(geometry.classified_pages(views.pages(spark, sf_dir)))
    words = lambda c: F.array_join(F.transform(F.coalesce(c, F.slice("tokens", 1, 0)), lambda t: t["text"]), " ")
    return rows.select("doc_id", "page", F.col("row").cast("long").alias("row"), words(F.col("before")).alias("before"), words(F.col("after")).alias("after"))


T18_SQL = f"""{_T}, r AS (SELECT doc_id, page, base, ln, min(role) AS role, string_agg(text, ' ' ORDER BY x0) AS words FROM t GROUP BY ALL), n AS (SELECT *, {_ROW} AS row FROM r)
SELECT n.doc_id, n.page, n.row, coalesce(b.words, '') AS before, coalesce(a.words, '') AS after FROM n LEFT JOIN r b ON b.doc_id = n.doc_id AND b.ln = n.ln AND b.role = 'before' LEFT JOIN r a ON a.doc_id = n.doc_id AND a.ln = n.ln AND a.role = 'after' WHERE n.role = 'txn'"""

_TEXT = "CASE WHEN ln % 3 = 2 THEN 'REF R' || CAST(ln AS STRING) || ' ' ELSE '' END || 'ITEM P' || CAST(part AS STRING) || CASE WHEN ln % 3 = 0 THEN ' LOT Q' || CAST(supp AS STRING) ELSE '' END"


def t21_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geometry.transactions(views.pages(spark, sf_dir))
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), "page", "date", "description", _cents("amount"), "type", _cents("balance"), "is_balance_forward", F.coalesce("post_date", "check_number", F.lit("")).alias("other"))


T21_SQL = f"""{_LINES} SELECT CAST(doc AS STRING) AS doc_id, ln - 1 AS idx, page, CAST(day AS STRING) AS date, {_TEXT} AS description, CAST(amount * 100 AS BIGINT) AS amount, CASE WHEN amount > 0 THEN 'credit' ELSE 'debit' END AS type,
       CAST(qty * 100 AS BIGINT) AS balance, false AS is_balance_forward, '' AS other FROM lines"""


def t23_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = geometry.transactions(views.pages(spark, sf_dir)).select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("provenance")["description"].alias("c"))
    return cell.select("doc_id", "idx", "c.text", "c.page", "c.mode", *(F.col("c.bbox")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))), "c.confidence")


T23_SQL = f"""{_T} SELECT doc_id, ln - 1 AS idx, string_agg(text, ' ' ORDER BY base, x0) AS text, page, 'DIGITAL' AS mode, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(confidence) AS confidence
FROM t WHERE ln > 0 AND {_LANE} = 'description' GROUP BY doc_id, ln, page"""


def t24_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.diagnostics(views.pages(spark, sf_dir)).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("rows_seen", "continuations", "transactions")))


T24_SQL = f"""{_T}, r AS (SELECT doc_id, page, base, min(role) AS role FROM t GROUP BY ALL)
SELECT doc_id, count(*) AS rows_seen, count(*) FILTER (role IN ('before', 'after')) AS continuations, count(*) FILTER (role = 'txn') AS transactions FROM r GROUP BY doc_id"""


def j4_summary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summary_values(views.pages(spark, sf_dir)).select("doc_id", "name", _cents("value"), "page", F.col("bbox")[0].alias("x0"))


J4_SQL = f"""{_LINES} SELECT CAST(doc AS STRING) AS doc_id, 'opening_balance' AS name, CAST(100000 AS BIGINT) AS value, 0 AS page, CAST(330 AS DOUBLE) AS x0 FROM totals
UNION ALL SELECT CAST(doc AS STRING), 'closing_balance', CAST(closing * 100 AS BIGINT), 0, CAST(330 AS DOUBLE) FROM totals
UNION ALL SELECT CAST(l.doc AS STRING), 'payments_and_credits', CAST(CASE WHEN n = 1 AND length(CAST(CAST(closing AS DECIMAL(18, 2)) AS STRING)) < length(CAST(printed AS STRING)) THEN closing ELSE printed END * 100 AS BIGINT), 0, CAST(330 AS DOUBLE)
FROM lines l JOIN totals t ON t.doc = l.doc JOIN (SELECT doc, count(*) AS n FROM lines GROUP BY doc) c ON c.doc = l.doc WHERE l.doc % 4 = 0 AND ln = 1"""


def statement_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole reading: type, balances and reconciliation of every printed statement."""
    done = statement.process(views.pages(spark, sf_dir), keep=False)
    return done.reconciliation.select("doc_id", "statement_type", "bank_score", "card_score", "status", "n_segments", _cents("opening"), _cents("closing"), _cents("difference"), _cents("deposits_credits"), _cents("withdrawals_debits"))


PROCESS_SQL = f"""{_LINES}, s AS (SELECT doc, coalesce(sum(amount) FILTER (amount > 0), 0) AS plus, coalesce(-sum(amount) FILTER (amount < 0), 0) AS minus FROM lines GROUP BY doc)
SELECT CAST(t.doc AS STRING) AS doc_id, 'BANK_ACCOUNT' AS statement_type, CAST(2 AS DOUBLE) AS bank_score, CAST(0 AS DOUBLE) AS card_score, CASE WHEN t.doc % 2 = 1 THEN 'UNBALANCED' ELSE 'BALANCED' END AS status, 1 AS n_segments, CAST(100000 AS BIGINT) AS opening,
       CAST(closing * 100 AS BIGINT) AS closing, CAST(CASE WHEN t.doc % 2 = 1 THEN -500 ELSE 0 END AS BIGINT) AS difference, CAST(plus * 100 AS BIGINT) AS deposits_credits, CAST(minus * 100 AS BIGINT) AS withdrawals_debits
FROM totals t JOIN s ON s.doc = t.doc"""


def s6_split_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as one span each, six points a character."""
    views.tables(spark, sf_dir, "part")
    spans = spark.sql("SELECT p_partkey AS doc_id, 0 AS page, 0 AS span, '  ' || p_name || '  ' || p_type AS text, 10.0D AS x0, 5.0D AS y0, 10.0D + 6 * (4 + length(p_name) + length(p_type)) AS x1, 15.0D AS y1 FROM part")
    return split_spans(spans).select("doc_id", "text", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


S6_SQL = r"""
WITH s AS (SELECT p_partkey AS doc_id, '  ' || p_name || '  ' || p_type AS text FROM part),
c AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM s),
b AS (SELECT doc_id, text, i FROM c WHERE text[i] <> ' ' AND (i = 1 OR text[i - 1] = ' ')),
w AS (SELECT doc_id, i, string_split(substring(text, i), ' ')[1] AS word FROM b)
SELECT doc_id, word AS text, CAST(10 + 6 * (i - 1) AS DOUBLE) AS x0, CAST(10 + 6 * (i - 1 + length(word)) AS DOUBLE) AS x1 FROM w
"""


def o1_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = views.tokens(spark, sf_dir).withColumn("ord", -F.col("ord"))
    return reading_order(shuffled).select("doc_id", "page", "text", "x0", "y0", "ord")


O1_SQL = f"{_T} SELECT doc_id, page, text, x0, y0, row_number() OVER (PARTITION BY doc_id, page ORDER BY (y0 + y1) / 2, x0, -ord) - 1 AS ord FROM t"

QUERIES = {
    "t1_baselines": t1_baselines,
    "t2_page_heights": t2_page_heights,
    "t4_overlap": t4_overlap,
    "t6_header_words": t6_header_words,
    "t8_header_anchors": t8_header_anchors,
    "t11_lanes": t11_lanes,
    "t13_layouts": t13_layouts,
    "t14_token_lanes": t14_token_lanes,
    "t17_row_classes": t17_row_classes,
    "t18_attached": t18_attached,
    "t21_transactions": t21_transactions,
    "t23_provenance": t23_provenance,
    "t24_diagnostics": t24_diagnostics,
    "j4_summary_values": j4_summary_values,
    "statement_process": statement_process,
    "s6_split_spans": s6_split_spans,
    "o1_reading_order": o1_reading_order,
}
ORACLE_SQL = {
    "t1_baselines": T1_SQL,
    "t2_page_heights": T2_SQL,
    "t4_overlap": T4_SQL,
    "t6_header_words": T6_SQL,
    "t8_header_anchors": T8_SQL,
    "t11_lanes": T11_SQL,
    "t13_layouts": T13_SQL,
    "t14_token_lanes": T14_SQL,
    "t17_row_classes": T17_SQL,
    "t18_attached": T18_SQL,
    "t21_transactions": T21_SQL,
    "t23_provenance": T23_SQL,
    "t24_diagnostics": T24_SQL,
    "j4_summary_values": J4_SQL,
    "statement_process": PROCESS_SQL,
    "s6_split_spans": S6_SQL,
    "o1_reading_order": O1_SQL,
}
