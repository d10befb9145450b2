"""The audit log of corrections: statuses, appends, corrections onto base rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.money import strip
from ..functions.text import same_text

SCHEMA = "id long, timestamp timestamp, session_id string, transaction_index int, field_name string, old_value string, new_value string, page int, bbox string, source string, status string, confidence double"


def values_agree(field: Column, old: Column, new: Column) -> Column:
    """Money within half a cent as numbers; all else as text without regard to blanks and case."""
    a, b = strip(old).try_cast("double"), strip(new).try_cast("double")
    near = F.coalesce(F.abs(a - b) <= rules.AMOUNT_AGREES, F.lit(False))
    return F.when(field.isin("amount", "balance"), near).otherwise(same_text(old, new))


def has_prior(old: Column, is_float: Column | None = None) -> Column:
    """There was a value: not null, not blank, and not the 0.0 of an untouched numeric cell."""
    filled = F.coalesce(F.length(strip(old)) > 0, F.lit(False))
    zero = F.coalesce((is_float if is_float is not None else F.lit(False)) & (strip(old).try_cast("double") == 0), F.lit(False))
    return filled & ~zero


def status(field: Column, old: Column, new: Column, confidence: Column, *, is_float: Column | None = None, low: float = rules.LOW_CONFIDENCE) -> Column:
    return F.when(confidence < low, "LOW_CONFIDENCE").when(~has_prior(old, is_float), "DIFFERENT").when(values_agree(field, old, new), "MATCH").otherwise("CONFLICT")


def auditable(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("field_name").isin(*rules.AUDIT_FIELDS))


def with_baseline(changes: DataFrame, baseline: DataFrame) -> DataFrame:
    """The server's current value (session_id, transaction_index, field_name, value) beats the old value that a client sends."""
    joined = changes.join(baseline, ["session_id", "transaction_index", "field_name"], "left")
    return joined.withColumn("old_value", F.coalesce("value", "old_value", F.lit(""))).drop("value")


class AuditLog:
    """An append-only Parquet log; ids go on from the largest one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def append(self, changes: DataFrame, *, dry_run: bool = False, low: float = rules.LOW_CONFIDENCE) -> DataFrame:
        """The new rows in the log's columns, written unless ``dry_run``; unknown fields are left out, unknown sources refused.

        Ids follow the largest one, in the order of session, row, field and values. Rows are dealt by ranges of that
        order, the ranges' sizes are summed up, and each range numbers its own rows, so no task holds them all. One
        writer at a time: ids are taken from the log as it is read.
        """
        bad = changes.where(~F.col("source").isin(*rules.AUDIT_SOURCES) | F.col("source").isNull())
        if not bad.isEmpty():
            raise ValueError(f"source must be one of {rules.AUDIT_SOURCES}")
        last = self.read().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        judged = auditable(changes).withColumns({"status": status(*(F.col(c) for c in ("field_name", "old_value", "new_value", "confidence")), low=low), "timestamp": F.lit(datetime.now())})
        keys = ["session_id", "transaction_index", "field_name", "old_value", "new_value", "confidence", "bbox", "page", "source"]
        dealt = judged.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id())
        if not dry_run:  # ranges come from a sample: they are fixed by writing them down
            staged = f"{self.path}.staged"
            dealt.write.mode("overwrite").parquet(staged)
            dealt = self.spark.read.schema(dealt.schema).parquet(staged)
        sizes = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}  # one for each partition
        before, total = [], last
        for part in sorted(sizes):
            before.append((part, total))
            total += sizes[part]
        starts = F.broadcast(self.spark.createDataFrame(before, "__part int, __before long"))
        place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
        out = dealt.join(starts, "__part").withColumn("id", F.col("__before") + place)
        out = out.select(*(F.col(f.split(" ")[0]).cast(f.split(" ")[1]) for f in SCHEMA.split(", ")))
        if not dry_run:
            out.write.mode("append").parquet(self.path)
            return self.read().where(F.col("id") > last)
        return out


def apply_corrections(rows: DataFrame, log: DataFrame, fields: tuple[str, ...] = ("date", "description", "amount", "type")) -> DataFrame:
    """Base rows (session_id, idx, fields) with the last logged value of each field."""
    last = log.groupBy("session_id", F.col("transaction_index").alias("idx")).pivot("field_name", list(fields)).agg(F.max_by("new_value", "id"))
    named = last.select("session_id", "idx", *(F.col(f).alias(f"__{f}") for f in fields))
    joined = rows.join(named, ["session_id", "idx"], "left")
    new = {f: F.coalesce(F.col(f"__{f}").cast(rows.schema[f].dataType), F.col(f)) for f in fields}
    return joined.withColumns(new).select(*rows.columns)


def toggle_type(rows: DataFrame, chosen: Column) -> DataFrame:
    """Credit and debit change places; the sign stays."""
    return rows.withColumn("type", F.when(chosen, F.when(F.col("type") == "credit", "debit").otherwise("credit")).otherwise(F.col("type")))


def delete_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (doc_id, idx) of ``gone`` removed, the rest numbered anew."""
    kept = rows.join(gone.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1)


def append_rows(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` behind each document's rows, numbered on."""
    both = rows.withColumn("__part", F.lit(0)).unionByName(more.withColumn("__part", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("__part", "idx")) - 1).drop("__part")
