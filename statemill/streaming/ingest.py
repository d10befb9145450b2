"""Statements as they arrive: an extension; the batch plan runs on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.geometry import TOKEN_SCHEMA
from ..plans.statement import process


def stream_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TOKEN_SCHEMA).parquet(path)


def ingest(tokens: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes transactions and reconciliations of every micro-batch; a document's tokens must arrive in one file. Each
    batch has its own folder that is overwritten, so that a repeated batch leaves no doubles."""

    def write(batch: DataFrame, number: int) -> None:
        with process(batch) as done:
            done.transactions.write.mode("overwrite").parquet(f"{out}/transactions/batch={number}")
            done.reconciliation.write.mode("overwrite").parquet(f"{out}/reconciliation/batch={number}")

    stream = tokens.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (stream.trigger(availableNow=True) if once else stream).start()
