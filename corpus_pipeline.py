"""The corpus pipeline: every stage works on all that the one before it kept, written as Parquet and read again.

1. quality: the ordinal classifier, fitted on the rated documents, drops what it doesn't accept as good.
2. line_dedup: lines that three documents or more hold stay in one of them; documents that this leaves without text go.
3. ngram_join: of each component of near copies the document with the smallest id stays.
4. decontaminate: documents that hold benchmark passages go.
5. encode: what is left becomes SentencePiece tokens, which are decoded again and compared with the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statemill.llm import decontaminate as contamination
from statemill.llm import linededup, ngramjoin, quality, tokenization
from statemill.llm.queries import PIECE_MODEL
from statemill.llm.shared import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; a null or empty text is judged like any other, repeated rows alike."""
    rated = table(spark, sf_dir, "labels").withColumn("grade", quality.grades())
    model = quality.train(spark, docs, rated)
    return quality.score(docs, model).where("accept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those that lose lines and have no text left go, all others stay as they are."""
    out = linededup.dedup_lines(spark, docs)
    changed = F.col("n_dropped") > 0
    out = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; documents without words or id link with nothing and stay."""
    found = ngramjoin.jaccard_components(spark, docs)
    copies = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark; a null text has no words and stays."""
    return contamination.decontaminate(spark, docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, and whether they decode to its text; both are null for a null text."""
    model = tokenization.read_model(spark, PIECE_MODEL)
    out = tokenization.encode(docs, model, round_trip="round_trip")
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", ngram_stage),
    ("decontaminate", decontaminate_stage),
    ("encode", encode_stage),
]

#: Neither the fitted model nor the tokenizer can be expressed in SQL; tests/llm hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; the last one's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
