"""Corpus pipeline: whole documents in, packed training sequences out.

Each stage reads all that its predecessor kept, as written Parquet.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import mixing, packing, quality, secret_scan, simhash
from tallyloom.llm.queries import tokenizer_path
from tallyloom.session import cut, table


#: Rows that go to a Python worker at a time.  Whole texts are wide, and two
#: workers share an executor with the JVM; results don't depend on it.
BATCH_ROWS = "1000"


def staged(stage):
    """A stage that hands small batches to Python workers, also when its result is read later."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@staged
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and the compression bands."""
    return docs.where(quality.passes(F.col("text")))


@staged
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: SimHash of five-word shingles, and a similarity of 0.8 beyond its reach."""
    return simhash.keep_one(docs, size=5, budget=3, similarity=0.8)


@staged
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text."""
    limits = secret_scan.thresholds(docs)
    text = secret_scan.redacted(F.col("text"), limits)
    clean = docs.withColumn("text", text)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture of their sources says, as many tokens as came in."""
    return mixing.mix(docs, budget_share=1.0, target_entropy_share=0.98, most_passes=4.0).select("row.*")


@staged
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence of at most 2048 tokens and their place in it."""
    pieces = packing.document_pieces(docs, tokenizer_path(), end_id=0, capacity=2048)
    return packing.pack(pieces, 2048)


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixture", mix_sources),
    ("packing", pack_sequences),
]

#: zstandard ratios, SimHash and tokens are beyond SQL; tests/llm/test_pipeline.py walks a small fixture by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
