"""The corpus pipeline: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs; all but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.llm import linededup, mixing, packing, quality, simhash
from tidewise.llm.common import ensure_checkpoint_dir, removed, table
from tidewise.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Null texts are scored as empty ones."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated windows of lines (two lines too, of 50 words together) go, and with them documents of which nothing is
    left; n_chars follows the text.  Texts that were null or blank before stay as they are."""
    out = linededup.dedup_lines(docs, pairs=True).withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.where((F.col("_removed") == 0) | (F.trim(F.coalesce("text", F.lit(""))) != "")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays: the
    one with the smallest doc_id."""
    return simhash.keep_one(docs, shingle=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought nearer to equal shares: documents repeat or go by their Poisson draw."""
    return mixing.mix(docs, temperature=0.7).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenisation and fitted trees are beyond SQL: tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what they keep is written below the shared checkpoint folder, and
    goes once the next stage is written, but for the rows that the result itself reads."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4()}"
    docs, before = table(spark, sf_dir, "documents"), None
    *writing, (_, last) = STAGES
    for k, (name, stage) in enumerate(writing):
        here = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            removed(spark, before)
        before = here
    return last(spark, docs, sf_dir)
