"""Tests and associations, each from one pass of partial aggregates.

``keys`` name what a result row stands for (feature, dataset and feature, ...).
Raw rows are only ever aggregated or ordered by ``ordering``; tail
probabilities are evaluated on the aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.distributions import chi2_upper, f_upper, normal_two_sided, t_two_sided
from tallyloom.functions.labels import guarded_ratio, log2_fold_change
from tallyloom.functions.moments import correlation
from tallyloom.operators.joins import small_side
from tallyloom.operators.ordering import quantiles, running, top_rows
from tallyloom.session import cut

#: Up to so many named features are laid out as columns of one aggregation; more go block by block.
CORRELATION_COLUMNS = 200


# ---------------------------------------------------------------- two groups

def two_group_moments(rows: DataFrame, keys: Sequence[str], group: str, a: str, b: str,
                      value: str = "value") -> DataFrame:
    """n, mean and sample variance of both arms side by side."""
    def arm(label: str) -> Column:
        return F.when(F.col(group) == label, F.col(value))

    return rows.filter(F.col(group).isin(a, b)).groupBy(*keys).agg(
        F.count(arm(a)).alias("n_a"), F.count(arm(b)).alias("n_b"),
        F.avg(arm(a)).alias("mean_a"), F.avg(arm(b)).alias("mean_b"),
        F.var_samp(arm(a)).alias("var_a"), F.var_samp(arm(b)).alias("var_b"),
    )


def enough(moments: DataFrame, least: int = 2) -> DataFrame:
    return moments.filter((F.col("n_a") >= least) & (F.col("n_b") >= least))


def pooled_sd() -> Column:
    n_a, n_b = F.col("n_a"), F.col("n_b")
    v_a, v_b = F.coalesce("var_a", F.lit(0.0)), F.coalesce("var_b", F.lit(0.0))
    return F.sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / F.greatest(n_a + n_b - 2, F.lit(1)))


def mean_sd() -> Column:
    return F.sqrt((F.col("var_a") + F.col("var_b")) / 2)


def case_control(moments: DataFrame) -> DataFrame:
    """Difference, fold change, pooled-sd effect size and Welch p (normal tail)."""
    diff = F.col("mean_a") - F.col("mean_b")
    se = F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    sd = pooled_sd()
    tested = moments.withColumns(
        {
            "mean_diff": diff,
            "fold_change": guarded_ratio(F.col("mean_a"), F.col("mean_b")),
            "effect_size": F.when(sd > 1e-12, diff / sd).otherwise(0.0),
            "_z": F.when(
                (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (se > 1e-12), F.abs(diff) / se
            ),
        }
    )
    return tested.withColumn("p_value", F.coalesce(normal_two_sided(F.col("_z")), F.lit(1.0))).drop("_z")


def pooled_t(moments: DataFrame, d_by: str = "pooled") -> DataFrame:
    """Student's t with pooled variance and Cohen's d.

    ``d_by="mean"`` divides by the root of the mean of both variances instead.
    """
    diff = F.col("mean_a") - F.col("mean_b")
    sd = pooled_sd()
    se = sd * F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b"))
    by = sd if d_by == "pooled" else mean_sd()
    out = moments.withColumns(
        {
            "mean_diff": diff,
            "df": F.col("n_a") + F.col("n_b") - 2,
            "t": F.when(se > 0, diff / se),
            "d": F.when(by > 0, diff / by).otherwise(0.0),
        }
    )
    return out.withColumn("p_value", t_two_sided(F.col("t"), F.col("df")))


def disease_control(moments: DataFrame, alpha: float = 0.05, least_d: float = 0.2) -> DataFrame:
    """Pooled t with log2 fold change of positive means and a verdict."""
    return pooled_t(moments).withColumns(
        {
            "log2_fold_change": log2_fold_change(F.col("mean_a"), F.col("mean_b")),
            "significant": (F.col("p_value") < alpha) & (F.abs("d") > least_d),
        }
    )


def mean_difference_interval(moments: DataFrame, quantile: Column | float = 1.96) -> DataFrame:
    """Mean difference with its interval; ``quantile`` is the multiple of the
    standard error (pass a t quantile column for small samples)."""
    by = F.lit(quantile) if isinstance(quantile, float) else quantile
    diff = F.col("mean_a") - F.col("mean_b")
    se = pooled_sd() * F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b"))
    return moments.withColumns(
        {"mean_diff": diff, "se": se, "low": diff - by * se, "high": diff + by * se}
    )


def _value_counts(rows: DataFrame, keys: Sequence[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """Per distinct value: rows of either arm and rows of ``b`` at or below it."""
    counts = rows.filter(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count_if(F.col(group) == a).alias("_a"), F.count_if(F.col(group) == b).alias("_b")
    )
    return running(counts, keys, [F.col(value)], {"_b_upto": "_b"})


def rank_sum(rows: DataFrame, keys: Sequence[str], group: str, a: str, b: str,
             value: str = "value") -> DataFrame:
    """Mann-Whitney U of arm ``a``, area under the ROC curve, two-sided p
    (normal, tie-corrected, with continuity).

    Equal values are counted before they are ordered.
    """
    placed = _value_counts(rows, keys, group, a, b, value)
    below = F.col("_b_upto") - F.col("_b")
    ties = F.col("_a") + F.col("_b")
    out = placed.groupBy(*keys).agg(
        F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"),
        F.sum(F.col("_a") * (below + F.col("_b") / F.lit(2.0))).alias("u"),
        F.sum((ties * ties * ties - ties).cast("double")).alias("_t"),
    ).filter((F.col("n_a") > 0) & (F.col("n_b") > 0))
    n, product = F.col("n_a") + F.col("n_b"), F.col("n_a") * F.col("n_b")
    sigma = F.sqrt(product / 12.0 * ((n + 1) - F.col("_t") / (n * (n - 1))))
    gap = F.greatest(F.abs(F.col("u") - product / 2.0) - 0.5, F.lit(0.0))
    scored = out.withColumns(
        {"auc": F.col("u") / product, "z": F.when(sigma > 0, gap / sigma)}
    ).drop("_t")
    return scored.withColumn("p_value", F.coalesce(normal_two_sided(F.col("z")), F.lit(1.0)))


# ---------------------------------------------------------------- many groups

def group_moments(rows: DataFrame, keys: Sequence[str], group: str, value: str = "value") -> DataFrame:
    return rows.groupBy(*keys, group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")
    )


def anova(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-way F, its p and eta squared, from the per-group moments."""
    overall = moments.groupBy(*keys).agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_grand")
    )
    parts = moments.join(overall, list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_grand"), 2)).alias("ssb"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ssw"),
    ).filter((F.col("groups") >= 2) & (F.col("n") > F.col("groups")))
    df1, df2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    out = parts.withColumns(
        {
            "df1": df1, "df2": df2,
            "f": F.when(F.col("ssw") > 0, (F.col("ssb") / df1) / (F.col("ssw") / df2)),
            "eta2": F.when(F.col("ssb") + F.col("ssw") > 0, F.col("ssb") / (F.col("ssb") + F.col("ssw"))),
        }
    )
    return out.withColumn("p_value", f_upper(F.col("f"), F.col("df1"), F.col("df2")))


def chi_square(rows: DataFrame, keys: Sequence[str], row: str, column: str) -> DataFrame:
    """Independence test of two labels; 2 x 2 tables get Yates' correction."""
    cells = rows.groupBy(*keys, row, column).agg(F.count(F.lit(1)).alias("_o"))
    by_row = cells.groupBy(*keys, row).agg(F.sum("_o").alias("_r"))
    by_column = cells.groupBy(*keys, column).agg(F.sum("_o").alias("_c"))
    full = cells.join(by_row, [*keys, row]).join(by_column, [*keys, column])
    # for 2 x 2 tables one cell fixes all four deviations
    out = full.groupBy(*keys).agg(
        F.sum("_o").alias("n"),
        F.count_distinct(row).alias("rows"), F.count_distinct(column).alias("columns"),
        F.sum(F.col("_o") * F.col("_o") / (F.col("_r") * F.col("_c"))).alias("_s"),
        F.max(F.struct("_o", "_r", "_c")).alias("_cell"),
    )
    n = F.col("n")
    r, c = F.col("_cell._r"), F.col("_cell._c")
    expected = r * c / n
    gap = F.abs(F.col("_cell._o") - expected)
    shrunk = F.greatest(gap - 0.5, F.lit(0.0))
    yates = shrunk * shrunk * n * n * n / (r.cast("double") * (n - r) * c * (n - c))
    square = (F.col("rows") == 2) & (F.col("columns") == 2)
    tested = out.withColumns(
        {
            "df": (F.col("rows") - 1) * (F.col("columns") - 1),
            "chi2": F.when(square, yates).otherwise(n * (F.col("_s") - 1)),
        }
    ).drop("_s", "_cell")
    return tested.withColumn("p_value", chi2_upper(F.col("chi2"), F.col("df")))


def one_sample_t(rows: DataFrame, keys: Sequence[str], value: str, against: float = 0.0) -> DataFrame:
    """t of the mean against a constant; with differences it is the paired t,
    and mean over sd is Cohen's d."""
    out = rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    ).filter(F.col("n") >= 2)
    gap = F.col("mean") - against
    tested = out.withColumns(
        {
            "t": F.when(F.col("sd") > 0, gap / (F.col("sd") / F.sqrt("n"))),
            "d": F.when(F.col("sd") > 0, gap / F.col("sd")),
            "df": F.col("n") - 1,
        }
    )
    return tested.withColumn("p_value", t_two_sided(F.col("t"), F.col("df")))


def subtype_comparison(rows: DataFrame, keys: Sequence[str], group: str, value: str = "value",
                       least: int = 2) -> DataFrame:
    """Group means per feature, their spread, and own mean minus the mean of
    the other groups' means."""
    means = group_moments(rows.filter(F.col(group) != "unknown"), keys, group, value).filter(F.col("n") >= least)
    across = means.groupBy(*keys).agg(
        F.sum("mean").alias("_sum"), F.count(F.lit(1)).alias("groups"),
        (F.max("mean") - F.min("mean")).alias("spread"),
    )
    others = F.when(
        F.col("groups") > 1, (F.col("_sum") - F.col("mean")) / (F.col("groups") - 1)
    ).otherwise(0.0)
    return means.join(across, list(keys)).withColumn("signature", F.col("mean") - others).drop("_sum", "var")


# ---------------------------------------------------------------- time

def time_summary(rows: DataFrame, keys: Sequence[str], scope: Sequence[str], time: str = "days",
                 sample: str = "sample", value: str = "value") -> DataFrame:
    """Slope, direction, time of the highest value, late minus early mean.

    Early and late are the first and last time of the ``scope`` (dataset).
    """
    timed = rows.filter(F.col(time).isNotNull())
    span = timed.groupBy(*scope).agg(
        F.min(time).alias("_first"), F.max(time).alias("_last"), F.count_distinct(time).alias("times")
    )
    joined = timed.join(F.broadcast(span), list(scope))  # one row for each dataset
    out = joined.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.regr_slope(value, time).alias("slope"),
        F.min_by(time, F.struct(-F.col(value), F.col(sample))).alias("peak_time"),
        F.avg(F.when(F.col(time) == F.col("_first"), F.col(value))).alias("early"),
        F.avg(F.when(F.col(time) == F.col("_last"), F.col(value))).alias("late"),
        F.max("times").alias("times"),
    )
    slope = F.when(F.col("n") >= 3, F.coalesce("slope", F.lit(0.0))).otherwise(0.0)
    return out.withColumns(
        {
            "slope": slope,
            "direction": F.when(slope > 0, "up").when(slope < 0, "down").otherwise("flat"),
            "shift": F.coalesce("late", F.lit(0.0)) - F.coalesce("early", F.lit(0.0)),
        }
    )


def time_points(rows: DataFrame, keys: Sequence[str], time: str, value: str = "value") -> DataFrame:
    """Mean per key and time, with the time's index among the key's times.

    One row per time point is left, so a window is as long as the calendar.
    """
    means = rows.filter(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.avg(value).alias("mean"))
    order = Window.partitionBy(*keys).orderBy(time)
    return means.withColumns(
        {"i": F.row_number().over(order) - 1, "step": F.col("mean") - F.lag("mean").over(order)}
    )


def trend(points: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Correlation with the time index and what follows from it; the largest
    step between neighbouring times is the change point."""
    biggest = F.struct(-F.abs("step"), F.col("i"))
    out = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("times"),
        correlation("i", "mean").alias("r"),
        F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("sd"),
        (F.max("mean") - F.min("mean")).alias("range"),
        F.min_by(time, F.when(F.col("step").isNotNull(), biggest)).alias("change_point"),
        F.min_by("step", F.when(F.col("step").isNotNull(), biggest)).alias("change"),
    )
    with_p = out.withColumn("p_value", correlation_p(F.col("r"), F.col("times")))
    sure = F.col("p_value") < 0.05
    return with_p.withColumns(
        {
            "cv": F.when(F.col("mean") != 0, F.col("sd") / F.col("mean")).otherwise(0.0),
            "trend": F.when((F.col("r") > 0.3) & sure, "increasing")
            .when((F.col("r") < -0.3) & sure, "decreasing").otherwise("stable"),
        }
    )


def mann_kendall(points: DataFrame, keys: Sequence[str], ties: bool = False, slice_rows: int | None = None) -> DataFrame:
    """Monotone-trend statistic S with its normal p; ``(*keys, n, s, z, p_value)``.

    The signs of all pairs are summed by counting inversions, so a series may
    have any length.  ``ties`` takes equal means out of the variance; without
    it the variance is that of a series without ties; ``slice_rows`` is the
    length from which a series is cut into slices.
    """
    from tallyloom.operators.trend import sign_sums

    present = points.filter(F.col("mean").isNotNull()).select(*keys, F.col("i").cast("long").alias("t"), F.col("mean").cast("double").alias("v"),
                                                             F.lit(1).cast("long").alias("w"))
    rows = cut(present)
    same = rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    counts = same.groupBy(*keys).agg(F.sum("_c").cast("long").alias("n"), F.sum(F.col("_c") * (F.col("_c") - 1) * (2 * F.col("_c") + 5)).alias("_t"))
    n, s = F.col("n").cast("double"), F.col("s")
    all_pairs = n * (n - 1) * (2 * n + 5)
    spread = F.sqrt((all_pairs - F.col("_t") if ties else all_pairs) / 18)
    z = F.when((F.col("n") < 3) | (spread <= 0), 0.0).when(s > 0, (s - 1) / spread).when(s < 0, (s + 1) / spread).otherwise(0.0)
    out = counts.join(sign_sums(rows, keys, slice_rows), list(keys)).withColumn("s", s.cast("double")).withColumn("z", z).drop("_t")
    return out.withColumn("p_value", normal_two_sided(F.col("z")))


def phase_shifts(points: DataFrame, system: str, time: str, early_until: float = 3.0) -> DataFrame:
    """Peak time per system, order of peaks, gap to the next peak, late minus
    early mean.  ``points`` is one row per system and time."""
    peaks = points.groupBy(system).agg(
        F.min_by(time, F.struct(-F.col("mean"), F.col(time))).alias("peak_time"),
        F.max("mean").alias("peak"),
        F.avg(F.when(F.col(time) <= early_until, F.col("mean"))).alias("early"),
        F.avg(F.when(F.col(time) > early_until, F.col("mean"))).alias("late"),
        F.count(F.lit(1)).alias("times"),
    ).filter(F.col("times") >= 2)
    placed = running(peaks.withColumn("_all", F.lit(0)), ["_all"], [F.col("peak_time"), F.col(system)],
                     position="place").drop("_all")
    following = placed.select((F.col("place") - 1).alias("place"), F.col("peak_time").alias("_next"))
    return placed.join(following, "place", "left").withColumns(
        {"gap_to_next": F.col("_next") - F.col("peak_time"), "late_minus_early": F.col("late") - F.col("early")}
    ).drop("_next")


def change_from_baseline(rows: DataFrame, keys: Sequence[str], time: str, dataset: Sequence[str] = ("dataset",),
                         value: str = "value") -> DataFrame:
    """Mean at the last time of a dataset against that at its first.

    Means by time come first, so rows meet no table; datasets with one time drop out.
    """
    means = rows.filter(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.avg(value).alias("_mean"))
    span = means.groupBy(*dataset).agg(F.min(time).alias("_first"), F.max(time).alias("_last")).filter("_first < _last")
    out = means.join(F.broadcast(span), list(dataset)).groupBy(*keys).agg(
        F.max(F.when(F.col(time) == F.col("_first"), F.col("_mean"))).alias("baseline"),
        F.max(F.when(F.col(time) == F.col("_last"), F.col("_mean"))).alias("final"),
    ).filter(F.col("baseline").isNotNull() & F.col("final").isNotNull())
    change = F.col("final") - F.col("baseline")
    return out.withColumns(
        {"change": change,
         "change_pct": F.when(F.col("baseline") != 0, change / F.abs("baseline") * 100).otherwise(0.0)}
    )


# ---------------------------------------------------------------- association

def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a Pearson correlation of ``n`` pairs."""
    t = F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))
    return F.when((n > 2) & (F.abs(r) >= 1), 0.0).otherwise(t_two_sided(t, n - 2))


def trait_association(rows: DataFrame, keys: Sequence[str], trait: str, value: str = "value",
                      least: int = 6) -> DataFrame:
    """Pearson correlation of trait and value; 0 where the value does not vary."""
    known = rows.filter(F.col(trait).isNotNull() & ~F.isnan(trait))
    out = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        correlation(trait, value).alias("_r"), F.stddev_pop(value).alias("_sd"),
        F.stddev_pop(trait).alias("_spread"),
    ).filter((F.col("n") >= least) & (F.col("_spread") > 1e-9))
    r = F.when(F.col("_sd") > 1e-9, F.col("_r")).otherwise(0.0)
    return out.withColumn("r", r).withColumn("r2", F.col("r") * F.col("r")).drop("_r", "_sd", "_spread")


def linear_fit(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"),
    )


def pair_correlations(rows: DataFrame, by: Sequence[str], sample: str, feature: str, value: str,
                      features: Sequence[str] | None = None) -> DataFrame:
    """Correlation over samples of every pair of features.

    A short list of ``features`` becomes columns and one aggregation computes
    all pairs, with partial sums per task.  All features (``None``), or a list
    too long for columns, go block by block; both ways give the same rows.
    """
    if features is None or len(features) > CORRELATION_COLUMNS:
        from tallyloom.operators.correlation import all_pair_correlations

        kept = rows
        if features is not None:
            listed = rows.sparkSession.createDataFrame([(f,) for f in sorted(set(features))], [feature])
            kept = rows.join(small_side(listed), feature, "left_semi")
        return all_pair_correlations(kept, by, sample, feature, value)
    names = sorted(features)
    wide = rows.groupBy(*by, sample).pivot(feature, names).agg(F.avg(value))
    pairs = list(combinations(range(len(names)), 2))
    column = lambda i: F.col(f"`{names[i]}`")
    out = wide.groupBy(*by).agg(
        F.array(
            *[
                F.struct(
                    F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"),
                    correlation(column(i), column(j)).alias("r"),
                    F.count_if(column(i).isNotNull() & column(j).isNotNull()).alias("n"),
                )
                for i, j in pairs
            ]
        ).alias("_pairs")
    )
    return out.select(*by, F.inline("_pairs")).filter(F.col("r").isNotNull())


def correlation_difference(by_group: DataFrame, group: str, a: str, b: str, least: float = 0.1,
                           least_samples: int = 3) -> DataFrame:
    """Pairs whose correlation differs between two groups by more than ``least``;
    a group needs ``least_samples`` samples with both features."""
    out = by_group.filter(F.col("n") >= least_samples).groupBy("a", "b").agg(
        F.max(F.when(F.col(group) == a, F.col("r"))).alias("r_a"),
        F.max(F.when(F.col(group) == b, F.col("r"))).alias("r_b"),
    )
    return out.withColumn("difference", F.col("r_a") - F.col("r_b")).filter(F.abs("difference") > least)


def platform_agreement(means: DataFrame, platform: str, feature: str, value: str, a: str, b: str) -> DataFrame:
    """Correlation of the feature means of two platforms, with a verdict."""
    both = means.groupBy(feature).agg(
        F.max(F.when(F.col(platform) == a, F.col(value))).alias("_x"),
        F.max(F.when(F.col(platform) == b, F.col(value))).alias("_y"),
    ).filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    out = both.agg(F.count(F.lit(1)).alias("features"), correlation("_x", "_y").alias("r")).filter("features > 2")
    verdict = F.when(F.col("r") > 0.7, "high").when(F.col("r") > 0.4, "moderate").otherwise("low")
    return out.withColumn("verdict", verdict)


def heterogeneity(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.when(F.count(value) > 1, F.var_samp(value)).otherwise(0.0).alias("variance")
    )


# ---------------------------------------------------------------- paired, strata, ranks

def paired_change(pairs: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """Mean and sd of post minus pre over pairs."""
    return pairs.groupBy(*keys).agg(
        F.count("delta").alias("pairs"), F.avg("delta").alias("mean_delta"),
        F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("sd_delta"),
    ).filter(F.col("pairs") >= least)


def strata(rows: DataFrame, keys: Sequence[str], value: str, cuts: Sequence[float],
           names: Sequence[str], stratum: str = "stratum") -> DataFrame:
    """Right-closed strata at exact quantiles of the group's values."""
    probs = {f"_c{i}": p for i, p in enumerate(cuts)}
    edges = quantiles(rows, keys, value, probs)
    word = F
    for i, name in enumerate(names[:-1]):
        word = word.when(F.col(value) <= F.col(f"_c{i}"), name)
    # one row for each group, sent to the values rather than the values to it
    return rows.join(small_side(edges), list(keys)).withColumn(stratum, word.otherwise(names[-1])).drop(*probs)


def rank_gaps(means: DataFrame, keys: Sequence[str], feature: str, value: str,
              expected: Column | None = None) -> DataFrame:
    """Rank, distance from the leader, lead over the next one down."""
    placed = running(means, keys, [F.col(value).desc(), F.col(feature)], position="place")
    best = placed.groupBy(*keys).agg(F.max(value).alias("_best"))
    following = placed.select(*keys, (F.col("place") - 1).alias("place"), F.col(value).alias("_next"))
    out = placed.join(following, [*keys, "place"], "left").join(best, list(keys)).withColumns(
        {"from_top": F.col("_best") - F.col(value), "lead": F.col(value) - F.col("_next")}
    ).drop("_best", "_next")
    return out if expected is None else out.withColumn("rank_deviation", F.col("place") - expected)


def expected_against_observed(means: DataFrame, expected: DataFrame, dataset: str = "dataset",
                              system: str = "system", value: str = "score") -> DataFrame:
    """Top three against the expected systems: matched, missing, unexpected;
    bottom two.  Lists hold at most three observed or the expected systems."""
    high = top_rows(means, [dataset], [F.col(value).desc(), F.col(system)], 3).groupBy(dataset).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", system))), lambda e: e[system]).alias("active"))
    low = top_rows(means, [dataset], [F.col(value), F.col(system).desc()], 2).groupBy(dataset).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", system))), lambda e: e[system]).alias("suppressed"))
    return high.join(low, dataset).join(expected, dataset).select(
        dataset, "active", "suppressed",
        F.array_intersect("expected", "active").alias("matched"),
        F.array_except("expected", "active").alias("missing"),
        F.array_except("active", "expected").alias("unexpected"),
    )


def expected_rank(means: DataFrame, expected: DataFrame, dataset: str = "dataset",
                  system: str = "system", value: str = "score") -> DataFrame:
    """Rank of the dataset's one expected system and its significance word."""
    wanted = expected.select(dataset, F.element_at("expected", 1).alias("_want"))
    # written once: worked out twice, a mean may differ in its last digit and come before itself
    joined = cut(means.join(wanted, dataset))
    own = F.max(F.when(F.col(system) == F.col("_want"), F.col(value)))
    scored = joined.groupBy(dataset).agg(own.alias("expected_score"), F.first("_want").alias("expected_system"))
    ranked = joined.join(scored, dataset).groupBy(dataset, "expected_system", "expected_score").agg(
        (F.count_if(F.col(value) > F.col("expected_score")) + 1).alias("rank"))
    word = F.when(F.col("rank") == 1, "HIGH").when(F.col("rank") <= 2, "MODERATE").otherwise("LOW")
    return ranked.withColumn("significance", word)


def top_two_overlap(means: DataFrame, expected: DataFrame, dataset: str = "dataset",
                    system: str = "system", value: str = "score") -> DataFrame:
    """How many of the two leading systems were expected, as a strength."""
    top = top_rows(means, [dataset], [F.col(value).desc(), F.col(system)], 2).join(expected, dataset)
    out = top.groupBy(dataset).agg(F.count_if(F.array_contains("expected", F.col(system))).alias("overlap"))
    word = F.when(F.col("overlap") >= 2, "STRONG").when(F.col("overlap") >= 1, "MODERATE").otherwise("WEAK")
    return out.withColumn("strength", word)


def named_rank(scores: DataFrame, name: str, sample: str = "sample", system: str = "system", value: str = "score") -> DataFrame:
    """(sample, other, difference, rank): rank of one named system in each
    sample, and by how much it leads every other one."""
    own = scores.filter(F.col(system) == name).select(sample, F.col(value).alias("_own"))
    both = scores.filter(F.col(system) != name).join(own, sample)
    ahead = (F.col(value) > F.col("_own")) | ((F.col(value) == F.col("_own")) & (F.col(system) < name))
    ranks = both.groupBy(sample).agg((F.count_if(ahead) + 1).alias("rank"))
    return both.select(sample, F.col(system).alias("other"), (F.col("_own") - F.col(value)).alias("difference")).join(ranks, sample)


def relevance(item: Column, expected: Column, system_of) -> Column:
    """2 for an expected set, 1 for one of the same system as the first expected set, else 0."""
    same = system_of(item) == system_of(F.try_element_at(expected, F.lit(1)))
    return F.when(F.array_contains(expected, item), 2).when(same, 1).otherwise(0)


def row_z_scores(points: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """z-values with the population sd of the key's own row."""
    moments = points.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return points.join(moments, list(keys)).withColumn("z", z).drop("_m", "_s")


def adjust(tests: DataFrame, keys: Sequence[str], p: str, test_id: str, method: str = "fdr_bh") -> DataFrame:
    """Adjusted p-values: ``bonferroni``, ``fdr_bh`` or ``fdr_by``.

    The step-up minimum is a running minimum from the largest p down.
    """
    rows = tests.filter(F.col(p).isNotNull())
    ranked = running(rows, keys, [F.col(p), F.col(test_id)], totals={"_m": None}, position="_i")
    m, i = F.col("_m"), F.col("_i")
    if method == "bonferroni":
        return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * m)).drop("_m", "_i")
    if method not in ("fdr_bh", "fdr_by"):
        raise ValueError(f"unknown method {method}")
    raw = F.col(p) * m / i
    if method == "fdr_by":
        harmonic = ranked.groupBy(*keys).agg(F.sum(1 / i).alias("_h"))
        ranked, raw = ranked.join(harmonic, list(keys)), raw * F.col("_h")
    stepped = running(
        ranked.withColumn("_raw", raw), keys, [i.desc()], mins={"_least": "_raw"}, position="_back"
    )
    return stepped.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("_least"))).select(
        *tests.columns, "p_adjusted"
    )
