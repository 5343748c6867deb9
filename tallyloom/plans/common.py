"""The five table shapes, read out of the given tables, in Spark and in SQL.

sample = supplier, feature = part, value = mean line price; a part's brand and
its type are two sets it belongs to; a brand's number modulo 5 is the system
above the set, all types form one more system.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.enrichment import dealt_means, running_extreme_scores
from tallyloom.session import cut, table

ROUND = 6


def r6(column, name: str):
    return F.round(column, ROUND).alias(name)


def measurements(spark: SparkSession, sf: str, by: tuple[str | Column, ...] = ()) -> DataFrame:
    """(*by, sample, feature, value), written once: scoring reads it in several
    passes, and the lines below it are far more."""
    rows = table(spark, sf, "lineitem").select(
        *by, F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("feature"), F.col("l_extendedprice").alias("value"))
    return cut(dealt_means(rows, rows.columns[:-1]))


def sets(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.select(
        F.explode(F.array("p_brand", F.concat(F.lit("Type#"), "p_type"))).alias("set_id"),
        F.col("p_partkey").alias("feature"),
    )


def system_of(set_id: str = "set_id"):
    number = F.regexp_extract(set_id, "([0-9]+)$", 1).cast("int")
    return F.when(
        F.col(set_id).startswith("Brand#"), F.concat(F.lit("S"), (number % 5).cast("string"))
    ).otherwise(F.lit("ST"))


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return sets(spark, sf).select("set_id").distinct().withColumn("system", system_of())


def scores(spark: SparkSession, sf: str, values: DataFrame | None = None) -> DataFrame:
    """(sample, set_id, es), computed once and cut, as every statistic reads it."""
    es = running_extreme_scores(values or measurements(spark, sf), sets(spark, sf))
    return cut(es)


def system_scores(spark: SparkSession, sf: str) -> DataFrame:
    return (
        scores(spark, sf)
        .groupBy("sample", system_of().alias("system"))
        .agg(F.avg("es").alias("score"))
    )


MEAS = """meas AS (SELECT l_suppkey AS sample, l_partkey AS feature, avg(l_extendedprice) AS value
  FROM lineitem GROUP BY 1, 2)"""

SETS = """sets AS (SELECT p_brand AS set_id, p_partkey AS feature FROM part
  UNION SELECT 'Type#' || p_type, p_partkey FROM part)"""

SYSTEM = ("CASE WHEN starts_with(set_id, 'Brand#') THEN 'S' || "
          "(CAST(regexp_extract(set_id, '([0-9]+)$', 1) AS INT) % 5) ELSE 'ST' END")


def score_ctes(meas: str = MEAS, keys: str = "sample") -> str:
    """CTEs ending in ``scores(<keys>, set_id, es)``."""
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"g.{k} = x.{k}" for k in ks)
    return f"""{meas}, {SETS},
ranked AS (SELECT {keys}, feature, value,
    row_number() OVER (PARTITION BY {keys} ORDER BY value DESC, feature) AS r,
    count(*) OVER (PARTITION BY {keys}) AS n FROM meas),
hits AS (SELECT {keys}, set_id, r, n, pow(abs(value), 0.25) AS w FROM ranked JOIN sets USING (feature)),
curve AS (SELECT *, row_number() OVER o AS k, sum(w) OVER o AS cw,
    count(*) OVER (PARTITION BY {keys}, set_id) AS nh, sum(w) OVER (PARTITION BY {keys}, set_id) AS s
  FROM hits WINDOW o AS (PARTITION BY {keys}, set_id ORDER BY r)),
steps AS (SELECT *, cw / s - (r - k) * (CASE WHEN n > nh THEN 1.0 / (n - nh) ELSE 0 END) AS hi FROM curve),
ext AS (SELECT {keys}, set_id, greatest(0, max(hi)) AS mx, least(0, min(hi - w / s)) AS mn
  FROM steps GROUP BY {keys}, set_id),
grid AS (SELECT * FROM (SELECT DISTINCT {keys} FROM meas), (SELECT DISTINCT set_id FROM sets)),
scores AS (SELECT {', '.join('g.' + k for k in ks)}, g.set_id,
    coalesce(CASE WHEN round(abs(mx), 12) >= round(abs(mn), 12) THEN mx ELSE mn END, 0.0) AS es
  FROM grid g LEFT JOIN ext x ON {same} AND g.set_id = x.set_id)"""


SCORES = score_ctes()
SYS_SCORES = SCORES + f""",
sys AS (SELECT sample, {SYSTEM} AS system, avg(es) AS score FROM scores GROUP BY 1, 2)"""
