"""Sources of statements: token tables, page facts, payloads, sessions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geometry import TOKEN_SCHEMA

PAYLOAD_SCHEMA = "file_name string, statement_type string, opening_balance double, closing_balance double, transactions array<struct<id:string,date:string,description:string,amount:double,type:string,balance:double,page:int>>, reconciled boolean"


def read_tokens(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(TOKEN_SCHEMA).format(fmt).load(path)


def payload_from_json(spark: SparkSession, path: str) -> DataFrame | None:
    """Statements stored as JSON documents; None where there is nothing."""
    try:
        return spark.read.schema(PAYLOAD_SCHEMA).option("multiLine", True).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def split_spans(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, page, span, text, x0, y0, x1, y1) as words: boxes in proportion to the characters, heights kept."""
    words = F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0))
    gaps = F.transform(F.split("text", r"(?U)\S+", -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,a:int,b:int>>").alias("out"))

    def step(s, x):
        a = s["at"] + x["gap"]
        return F.struct((a + F.length(x["w"])).alias("at"), F.array_append(s["out"], F.struct(x["w"].alias("text"), a.alias("a"), (a + F.length(x["w"])).alias("b"))).alias("out"))

    parts = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(words)).alias("gap"), words.alias("w"))
    each = spans.withColumn("n", F.greatest(F.length("text"), F.lit(1))).withColumn("w", F.explode(F.aggregate(parts, start, step, lambda s: s["out"])))
    x = lambda c: F.col("x0") + (F.col("x1") - F.col("x0")) * F.col(c) / F.col("n")
    return each.select("doc_id", "page", "span", F.col("w.text").alias("text"), x("w.a").alias("x0"), "y0", x("w.b").alias("x1"), "y1")


def reading_order(tokens: DataFrame) -> DataFrame:
    """Numbers each page's tokens by the height of their centres, then from left to right."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page").orderBy((F.col("y0") + F.col("y1")) / 2, "x0", *(c for c in ("span", "ord") if c in tokens.columns))
    return tokens.withColumn("ord", (F.row_number().over(w) - 1).cast("long"))


class Sessions:
    """Statements under a session id, as one Parquet table partitioned by a bucket of the id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame) -> None:
        rows.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(64)).cast("int")).write.mode("append").partitionBy("bucket").parquet(self.path)

    def get(self, session_id: str) -> DataFrame:
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(session_id)), F.lit(64))).first()[0]
        return self.spark.read.parquet(self.path).where((F.col("bucket") == bucket) & (F.col("session_id") == session_id)).drop("bucket")


def audit_path(option: str | None = None) -> str:
    """Where the audit log is: the option, an environment variable, or the user's folder."""
    return option or os.environ.get("STATEMILL_AUDIT_PATH") or os.path.join(os.environ.get("LOCALAPPDATA") or os.path.expanduser("~"), ".statemill", "audit_log")
