"""Per-sample enrichment scores of feature sets.

Sets are never expanded to every feature of a sample.  Each sample is ordered
once, the set members are joined on, and everything else is arithmetic on the
hits: between two hits the running curve falls by a known amount, so its
extremes and its area follow from the hits' positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.joins import small_side
from tallyloom.operators.ordering import running, tie_ranks, tied_positions
from tallyloom.session import broadcast_rows, cut, window_rows

#: Set ids carried in one row when the sample x set grid is laid out.
GRID_CHUNK = 1000
#: Rows of samples, or hits of sets, that one task orders.
TASK_ROWS = 500_000


def present_values(values: DataFrame, value: str = "value") -> DataFrame:
    """Finite values only."""
    return values.filter(F.col(value).isNotNull() & ~F.isnan(value))


def sample_set_grid(samples: DataFrame, sets: DataFrame, set_id: str = "set_id") -> DataFrame:
    """Every set for every sample, laid out by exploding arrays of set ids.

    The result is as large as the scores it completes.  Set ids are packed into
    rows of at most about ``GRID_CHUNK`` ids and joined on the chunk number.
    """
    ids = sets.select(set_id).distinct()
    n = ids.count()
    chunks = max(1, -(-n // GRID_CHUNK))
    packed = (
        ids.groupBy(F.pmod(F.xxhash64(set_id), F.lit(chunks)).alias("_chunk"))
        .agg(F.collect_list(set_id).alias("_ids"))
    )
    spread = samples.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
    )
    # a chunk number is no key to shuffle all samples on: the packed ids go to them while their count is bounded
    joined = spread.join(F.broadcast(packed) if n <= broadcast_rows(sets.sparkSession) else packed, "_chunk")
    return joined.select(*samples.columns, F.explode("_ids").alias(set_id))


def _sizes(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, bool, int]:
    """One row per sample with its size, written once (it serves as the list of
    samples too), whether every sample fits a window, and all rows."""
    sizes = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    return sizes, (most or 0) <= window_rows(rows.sparkSession), total or 0


def _dealt(rows: DataFrame, keys: Sequence[str], total: int, small: bool) -> DataFrame:
    """Whole groups dealt to as many tasks as ``total`` rows ask for, so that what one task sorts doesn't grow with the table."""
    return rows.repartition(1 + total // TASK_ROWS, *keys) if small else rows


def dealt_means(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean value of rows with equal keys.

    Where nearly every row has keys of its own, as in measurements, sums
    before the shuffle save nothing and fill a table as long as a task's
    input; rows go straight to as many tasks as they ask for.
    """
    return rows.repartition(1 + rows.count() // TASK_ROWS, *keys).groupBy(*keys).agg(F.avg(value).alias(value))


def _hits(total: int, sets: DataFrame) -> int:
    """About how many rows ``total`` rows become once their sets are joined on."""
    members, features = sets.agg(F.count(F.lit(1)), F.count_distinct("feature")).first()
    return total * members // max(features, 1)


def _complete(scores: DataFrame, samples: DataFrame, sets: DataFrame, keys: Sequence[str],
              fills: dict[str, Column]) -> DataFrame:
    grid = sample_set_grid(samples.select(*keys), sets)
    joined = grid.join(scores, [*keys, "set_id"], "left")
    return joined.select(
        *keys, "set_id", *[F.coalesce(F.col(c), fill).alias(c) for c, fill in fills.items()]
    )


def _members(sets: DataFrame) -> DataFrame:
    return small_side(sets.select("set_id", "feature").distinct())


def running_extreme_scores(
    values: DataFrame, sets: DataFrame, keys: Sequence[str] = ("sample",), alpha: float = 0.25
) -> DataFrame:
    """Signed extreme of the weighted running sum, per sample and set.

    Samples are ordered by value descending, ties by feature.  A hit adds its
    share of ``|value|^alpha``, a miss subtracts ``1/(n - hits)``.  The larger
    absolute extreme wins, the maximum on equality; 0 where nothing matches.
    """
    keys = list(keys)
    rows = present_values(values).select(*keys, "feature", "value")
    sizes, small, total = _sizes(rows, keys)
    ranked = running(
        _dealt(rows, keys, total, small), keys, [F.col("value").desc(), F.col("feature")],
        totals={"n": None}, position="r", small=small,
    )
    hits = ranked.join(_members(sets), "feature").withColumn(
        "w", F.pow(F.abs("value"), F.lit(alpha))
    )
    group = [*keys, "set_id"]
    curve = running(
        _dealt(hits.select(*group, "r", "n", "w"), group, _hits(total, sets), small), group, [F.col("r")],
        sums={"cw": "w"}, totals={"hits": None, "weight": "w"}, position="k", small=small,
    )
    miss = F.when(F.col("n") > F.col("hits"), 1 / (F.col("n") - F.col("hits"))).otherwise(0.0)
    after = F.col("cw") / F.col("weight") - (F.col("r") - F.col("k")) * miss
    before = after - F.col("w") / F.col("weight")
    extremes = (
        curve.filter(F.col("weight") > 0)
        .groupBy(*keys, "set_id")
        .agg(
            F.greatest(F.lit(0.0), F.max(after)).alias("high"),
            F.least(F.lit(0.0), F.min(before)).alias("low"),
        )
    )
    # rounding keeps an exact tie of the two extremes a tie
    high_wins = F.round(F.abs("high"), 12) >= F.round(F.abs("low"), 12)
    scores = extremes.select(
        *keys, "set_id", F.when(high_wins, F.col("high")).otherwise(F.col("low")).alias("es")
    )
    return _complete(scores, sizes, sets, keys, {"es": F.lit(0.0)})


def rank_area_scores(
    values: DataFrame,
    sets: DataFrame,
    keys: Sequence[str] = ("sample",),
    alpha: float = 0.25,
    min_size: int = 1,
    max_size: int | None = None,
) -> DataFrame:
    """Area between the hit and miss curves on rank-normalised samples
    (published single-sample algorithm), with scores scaled by their range.

    Every sample has a row for every set, 0 where nothing matches.  A caller
    may leave out sets with fewer than ``min_size`` or more than ``max_size``
    measured members.
    """
    keys = list(keys)
    rows = present_values(values).select(*keys, "feature", "value")
    sizes, small, total = _sizes(rows, keys)
    measured = rows.select("feature").distinct()
    sized = (
        sets.select("set_id", "feature").distinct().join(measured, "feature", "left_semi")
        .groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
        .filter(F.col("size") >= min_size)
    )
    if max_size is not None:
        sized = sized.filter(F.col("size") <= max_size)
    kept = sets.join(sized, "set_id", "left_semi") if min_size > 1 or max_size is not None else sets
    scored = tied_positions(_dealt(rows, keys, total, small), keys, "value", ["feature"], descending=True, small=small).withColumnRenamed("group_rows", "n")
    # normalised value: average rank on a 10,000 scale, smallest value lowest
    low_rank = F.col("n") + 1 - (F.col("tie_first") + F.col("tie_last")) / F.lit(2.0)
    hits = scored.join(_members(kept), "feature").withColumn(
        "w", F.pow(F.lit(10000.0) * low_rank / F.col("n"), F.lit(alpha))
    )
    reach = F.col("n") - F.col("position") + 1
    sums = hits.groupBy(*keys, "set_id").agg(
        F.max("n").alias("n"),
        F.count(F.lit(1)).alias("hits"),
        F.sum("w").alias("weight"),
        F.sum(F.col("w") * reach).alias("weighted_reach"),
        F.sum(reach).alias("reach"),
    )
    inside = F.col("weighted_reach") / F.col("weight")
    outside = F.when(
        F.col("n") > F.col("hits"),
        (F.col("n") * (F.col("n") + 1) / 2 - F.col("reach")) / (F.col("n") - F.col("hits")),
    ).otherwise(0.0)
    found = sums.select(*keys, "set_id", (inside - outside).alias("es"))
    es = cut(_complete(found, sizes, kept, keys, {"es": F.lit(0.0)}))
    # one number back: the range of all scores
    low, high = es.agg(F.min("es"), F.max("es")).first()
    span = (high or 0.0) - (low or 0.0)
    return es.withColumn("nes", F.col("es") / F.lit(span) if span > 0 else F.lit(None).cast("double"))


def rank_percentile_scores(
    values: DataFrame, sets: DataFrame, keys: Sequence[str] = ("sample",), form: int = 1
) -> DataFrame:
    """Mean descending rank of the members as a share of the sample size.

    Form 1 is ``(n - rank)/n`` with 0.5 where nothing matches, form 2
    ``(n - rank + 1)/n`` with 0.
    """
    keys = list(keys)
    rows = present_values(values).select(*keys, "feature", "value")
    sizes, small, total = _sizes(rows, keys)
    ranked = tie_ranks(_dealt(rows, keys, total, small), keys, "value", name="rank", descending=True, small=small)
    means = (
        ranked.join(_members(sets), "feature")
        .groupBy(*keys, "set_id")
        .agg(F.avg("rank").alias("mean_rank"))
        .join(sizes, keys)
    )
    shift = 0 if form == 1 else 1
    score = (F.col("n") - F.col("mean_rank") + shift) / F.col("n")
    scores = means.select(*keys, "set_id", score.alias("score"))
    return _complete(scores, sizes, sets, keys, {"score": F.lit(0.5 if form == 1 else 0.0)})


def z_scores(values: DataFrame, sets: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Mean z-value of the members against all features of the sample; 0 where
    nothing matches.  The mean of z is the z of the mean, so members and
    samples are aggregated before they meet."""
    keys = list(keys)
    rows = present_values(values).select(*keys, "feature", "value")
    moments = rows.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )
    means = (
        rows.join(_members(sets), "feature")
        .groupBy(*keys, "set_id")
        .agg(F.avg("value").alias("member_mean"))
        .join(moments, keys)
    )
    z = F.when(F.col("sd") > 0, (F.col("member_mean") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    scores = means.select(*keys, "set_id", z.alias("score"))
    return _complete(scores, rows.select(*keys).distinct(), sets, keys, {"score": F.lit(0.0)})


def mean_value_scores(values: DataFrame, sets: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Mean value of the measured members, per sample and set."""
    rows = present_values(values)
    return (
        rows.join(_members(sets), "feature")
        .groupBy(*keys, "set_id")
        .agg(F.avg("value").alias("score"))
    )


def require_matches(coverage: DataFrame) -> None:
    """Stop when no set matches any measured feature."""
    total = coverage.agg(F.sum("matched")).first()[0] or 0
    if total == 0:
        raise ValueError("no feature of any set was measured; check the feature mapping")


def require_features(values: DataFrame, probe_share: float, least: int = 200) -> int:
    """Number of distinct features; stop at none, or at too few of a
    probe-like kind."""
    n = values.select("feature").distinct().count()
    if n == 0:
        raise ValueError("no feature left after mapping")
    if n < least and probe_share > 0:
        raise ValueError(f"only {n} features left and the identifiers look unmapped")
    return n
