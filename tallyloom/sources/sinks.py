"""Exports: flat and nested results, per-key files, increments, summaries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.term_rules import SUBSYSTEM_NAMES, SYSTEM_NAMES
from tallyloom.functions.rules import mapped
from tallyloom.session import cut

# Columns of the flat export, in their order.
EXPORT_COLUMNS = [
    "ID", "Name", "Definition", "Source", "Namespace", "Primary_System", "Subsystem", "All_Systems",
    "Inflammation_Polarity", "Confidence_Score", "Decision_Path",
]


def flat_results(rows: DataFrame) -> DataFrame:
    """Classified entries as text columns, arrays joined."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    every = F.transform("all_systems", lambda s: mapped(s, SYSTEM_NAMES, ""))
    return rows.select(
        F.col("id").cast("string").alias("ID"), text("name").alias("Name"), text("definition").alias("Definition"),
        text("source").alias("Source"), text("namespace").alias("Namespace"),
        mapped(F.col("system"), SYSTEM_NAMES, "").alias("Primary_System"), text("subsystem").alias("Subsystem"),
        F.array_join(every, "; ").alias("All_Systems"), text("polarity").alias("Inflammation_Polarity"),
        F.format_number("confidence", 3).alias("Confidence_Score"), F.array_join("path", " -> ").alias("Decision_Path"))


def with_names(rows: DataFrame) -> DataFrame:
    return rows.withColumn("subsystem_name", mapped(F.col("subsystem"), SUBSYSTEM_NAMES, ""))


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_by_key(rows: DataFrame, path: str, key: str, batch_rows: int = 0) -> None:
    """One folder per key; ``batch_rows`` bounds the rows of a file."""
    writer = rows.write.mode("overwrite").partitionBy(key).option("header", "true")
    (writer.option("maxRecordsPerFile", batch_rows) if batch_rows else writer).csv(path)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append rows whose key the table does not hold yet; returns how many.

    The new rows are fixed before the write, so that a rerun task cannot see
    what it wrote itself.
    """
    known = rows.sparkSession.read.parquet(path).select(key).distinct()
    fresh = cut(rows.dropDuplicates([key]).join(known, key, "left_anti"))
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def summary_counts(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, key, n): counts of every dimension in one pass."""
    long = rows.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("none")).alias("key")) for d in dimensions
    ])).alias("_x")).select("_x.*")
    return long.groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"))


def check_export(rows: DataFrame, required: Sequence[str], key: str) -> DataFrame:
    """One row: rows, missing columns, rows without a key."""
    missing = [c for c in required if c not in rows.columns]
    empty = F.count_if(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")) if key in rows.columns else F.lit(None)
    return rows.agg(F.count(F.lit(1)).alias("rows"), empty.alias("without_key")).withColumns({
        "missing": F.lit(",".join(missing)), "valid": F.lit(not missing)}).withColumn(
        "valid", F.col("valid") & (F.coalesce("without_key", F.lit(0)) == 0))


def wide_scores(scores: DataFrame, sample: str, feature: str, value: str, features: Sequence) -> DataFrame:
    """Sample x feature table for a fixed list of features, missing as 0.0."""
    return scores.groupBy(sample).pivot(feature, list(features)).agg(F.first(value)).fillna(0.0)


def time_table(points: DataFrame, time: str, feature: str, value: str, features: Sequence) -> DataFrame:
    """Time x feature table of means."""
    return points.groupBy(time).pivot(feature, list(features)).agg(F.avg(value))


def as_records(rows: DataFrame) -> DataFrame:
    """Rows as JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def from_records(texts: DataFrame, schema: str, defaults: dict | None = None) -> DataFrame:
    """JSON text as rows, missing fields filled from ``defaults``."""
    out = texts.select(F.from_json("json", schema).alias("_r")).select("_r.*")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in (defaults or {}).items()})


def run_metric(spark: SparkSession, path: str, step: str, status: str, rows: int, seconds: float) -> None:
    """Append one line to the table of operator runs."""
    spark.range(1).select(
        F.lit(step).alias("step"), F.lit(status).alias("status"), F.lit(rows).cast("long").alias("rows"),
        F.lit(float(seconds)).alias("seconds"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


_observed: dict[tuple[str, str], tuple[Observation, float]] = {}


def observed_run(rows: DataFrame, path: str, step: str) -> DataFrame:
    """``rows`` unchanged; the job that reads them also counts them for the log at ``path``."""
    seen = Observation(f"{step}-{uuid.uuid4().hex}")
    _observed[path, step] = (seen, time.perf_counter())
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"))


def log_observed(spark: SparkSession, path: str, step: str) -> None:
    """Append the finished run of ``step`` to the log."""
    seen, start = _observed.pop((path, step))
    run_metric(spark, path, step, "ok", seen.get["rows"], time.perf_counter() - start)
