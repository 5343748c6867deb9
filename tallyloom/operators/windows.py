"""Steps between neighbours, cumulative shares, top and bottom lists, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ordering import running, top_rows


def running_extremes(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], step: str) -> DataFrame:
    """Highest (at least 0) and lowest (at most 0) point of the running sum."""
    curve = running(rows, keys, order, {"_sum": step})
    return curve.groupBy(*keys).agg(
        F.greatest(F.lit(0.0), F.max("_sum")).alias("high"),
        F.least(F.lit(0.0), F.min("_sum")).alias("low"),
    )


def steps(points: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Change from the previous time point.  ``points`` holds one row per group
    and time (an aggregate), so a group is as long as the calendar."""
    before = Window.partitionBy(*keys).orderBy(time)
    return points.withColumn("step", F.col(value) - F.lag(value).over(before))


def largest_step(points: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    moved = steps(points, keys, time, value).filter(F.col("step").isNotNull())
    biggest = F.struct(-F.abs("step"), F.col(time))
    return moved.groupBy(*keys).agg(
        F.min_by(time, biggest).alias("change_point"), F.min_by("step", biggest).alias("step")
    )


def cumulative_share(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: str) -> DataFrame:
    """Running share of the group's total weight in the given order."""
    placed = running(rows, keys, order, {"_sum": weight}, {"_total": weight})
    return placed.withColumn("cumulative", F.col("_sum") / F.col("_total")).drop("_sum", "_total")


def first_reaching(shares: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Fewest leading rows whose shares reach the threshold."""
    return shares.groupBy(*keys).agg(
        F.min(F.when(F.col("cumulative") >= threshold, F.col("position"))).alias("needed")
    )


def top_and_bottom(rows: DataFrame, value: str, name: str, n: int = 5) -> DataFrame:
    """``n`` highest and ``n`` lowest names; the lists overlap below 2n rows."""
    high = rows.orderBy(F.col(value).desc(), F.col(name)).limit(n)
    low = rows.orderBy(F.col(value).asc(), F.col(name).desc()).limit(n)
    place = lambda order: F.row_number().over(Window.partitionBy("side").orderBy(*order))
    top = high.withColumn("side", F.lit("top")).withColumn(
        "place", place([F.col(value).desc(), F.col(name)])
    )
    bottom = low.withColumn("side", F.lit("bottom")).withColumn(
        "place", place([F.col(value).asc(), F.col(name).desc()])
    )
    return top.unionByName(bottom)


def seeded_sample(rows: DataFrame, group: Sequence[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows per group, the same ones on every run and partitioning."""
    draw = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    drawn = rows.withColumn("_draw", draw)
    return top_rows(drawn, group, [F.col("_draw"), F.col(key)], n).drop("_draw", "place")


def label_number(label: str) -> Column:
    """Number embedded in a time label, for natural ordering."""
    return F.regexp_extract(label, "(\\d+)", 1).try_cast("int")
