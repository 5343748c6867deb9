"""CSV and JSON tables with fixed schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the dataset catalogue.
CATALOGUE_COLUMNS = [
    "dataset_id", "name", "chinese_name", "disease_type", "expected_strategy", "expected_systems",
    "description", "platform", "n_samples", "pub_date", "gdstype",
]
RUN_SCHEMA = ("dataset_id string, disease_type string, analysis_time string, analysis_strategy string, "
              "top_systems array<string>, errors array<string>, classification_results string, system_scores string")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and a given schema; a byte order mark is dropped by the reader."""
    return spark.read.option("header", "true").option("encoding", "UTF-8").option("enforceSchema", "true").csv(path, schema=schema)


def catalogue(rows: DataFrame) -> DataFrame:
    """Catalogue rows trimmed and with defaults; rows without an id drop out."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    out = rows.select(
        text("dataset_id").alias("dataset_id"),
        F.coalesce(text("name"), text("dataset_id")).alias("name"),
        F.coalesce(text("chinese_name"), text("dataset_id")).alias("chinese_name"),
        F.coalesce(text("disease_type"), F.lit("unknown")).alias("disease_type"),
        F.coalesce(text("expected_strategy"), F.lit("")).alias("expected_strategy"),
        F.filter(F.transform(F.split(F.coalesce("expected_systems", F.lit("")), ";"), lambda s: F.trim(s)), lambda s: s != "").alias("expected_systems"),
        *[F.coalesce(text(c), F.lit("")).alias(c) for c in ("description", "platform")],
        F.coalesce(text("n_samples").try_cast("int"), F.lit(0)).alias("n_samples"),
        *[F.coalesce(text(c), F.lit("")).alias(c) for c in ("pub_date", "gdstype")],
    )
    return out.filter("dataset_id IS NOT NULL")


def run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Successful runs among JSON summaries, one file each."""
    rows = spark.read.schema(RUN_SCHEMA).option("multiLine", "true").json(path)
    return successful_runs(rows)


def successful_runs(rows: DataFrame) -> DataFrame:
    filled = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("", "{}", "[]")
    return rows.filter(
        (F.coalesce(F.size("errors"), F.lit(0)) <= 0) & filled("classification_results") & filled("system_scores"))


def joined_study(info: DataFrame, features: DataFrame, scores: DataFrame, key: str = "sample_id",
                 required: Sequence[str] = ("sample_id", "group")) -> DataFrame:
    """Sample information joined with two score tables; required columns are
    checked, rows without a group drop out, missing scores become 0."""
    missing = [c for c in required if c not in info.columns]
    if missing:
        raise ValueError(f"sample information lacks {missing}")
    out = info.join(features, key).join(scores, key).dropna(subset=list(required))
    numbers = [c for c, t in out.dtypes if t in ("double", "float")]
    return out.fillna(0.0, numbers)
