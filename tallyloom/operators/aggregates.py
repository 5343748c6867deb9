"""Group summaries, roll-ups and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.moments import correlation
from tallyloom.operators.ordering import quantiles, running, top_rows


def set_summary(scores: DataFrame, coverage: DataFrame, score: str = "es") -> DataFrame:
    """Mean, population sd, median, min and max of a set's scores, with coverage."""
    moments = scores.groupBy("set_id").agg(
        F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
    )
    middle = quantiles(scores, ["set_id"], score, {"median": 0.5})
    return moments.join(middle, "set_id").join(coverage, "set_id")


def system_means(scores: DataFrame, hierarchy: DataFrame, score: str = "es") -> DataFrame:
    """Unweighted mean of the set means below each system; 0.0 where none."""
    set_means = scores.groupBy("set_id").agg(F.avg(score).alias("mean"))
    return (
        hierarchy.join(set_means, "set_id", "left")
        .groupBy("system")
        .agg(F.coalesce(F.avg("mean"), F.lit(0.0)).alias("score"), F.count("mean").alias("sets"))
    )


def sample_system_scores(scores: DataFrame, hierarchy: DataFrame, score: str = "es") -> DataFrame:
    return (
        scores.join(hierarchy, "set_id")
        .groupBy("sample", "system")
        .agg(F.avg(score).alias("score"))
    )


def group_profiles(rows: DataFrame, group: Sequence[str], value: str, least: int = 1) -> DataFrame:
    """Mean, sample sd and size per group; groups below ``least`` rows drop out."""
    return (
        rows.groupBy(*group)
        .agg(
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("sd"),
            F.count(value).alias("n"),
        )
        .filter(F.col("n") >= least)
    )


def skewness_unbiased(value: str, n: Column) -> Column:
    """Bias-corrected skewness from Spark's population form."""
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_unbiased(value: str, n: Column) -> Column:
    """Bias-corrected excess kurtosis from Spark's population form."""
    return F.when(
        n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)
    )


def distribution_statistics(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    n = F.count(value)
    moments = rows.groupBy(*keys).agg(
        n.alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        skewness_unbiased(value, n).alias("skewness"),
        kurtosis_unbiased(value, n).alias("kurtosis"),
    )
    cuts = quantiles(rows, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(cuts, list(keys)).withColumns(
        {
            "range": F.col("max") - F.col("min"),
            "iqr": F.col("q3") - F.col("q1"),
            "cv": F.when(F.col("mean") != 0, F.col("sd") / F.abs("mean")),
        }
    )


def variability(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.when(F.avg(value) != 0, F.stddev_samp(value) / F.abs(F.avg(value))).alias("cv"),
        (F.max(value) - F.min(value)).alias("range"),
        F.stddev_samp(value).alias("sd"),
    )


def shares(rows: DataFrame, parent: Sequence[str], child: Sequence[str]) -> DataFrame:
    """Count per (parent, child), with its share of the parent and of all rows.

    Totals come from their own small aggregates, so no parent is gathered.
    """
    counts = rows.groupBy(*parent, *child).agg(F.count(F.lit(1)).alias("n"))
    parents = counts.groupBy(*parent).agg(F.sum("n").alias("_parent"))
    everything = rows.count() or 1
    return counts.join(parents, list(parent)).select(
        *parent,
        *child,
        "n",
        (F.col("n") * 100.0 / F.col("_parent")).alias("pct_of_parent"),
        (F.col("n") * 100.0 / everything).alias("pct_of_total"),
    )


def classification_statistics(rows: DataFrame, by: Sequence[str], confidence: str, source: str,
                              term: str) -> DataFrame:
    """Per label: entries, mean and sd of confidence, sources, share of all."""
    everything = rows.count() or 1
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(confidence).alias("mean_confidence"),
        F.stddev_samp(confidence).alias("sd_confidence"),
        F.count_distinct(source).alias("sources"),
        F.count_distinct(term).alias("terms"),
        (F.count(F.lit(1)) * 100.0 / everything).alias("pct_of_total"),
    )


def examples(rows: DataFrame, by: Sequence[str], order: Sequence[Column], text: str, n: int) -> DataFrame:
    """First ``n`` texts of each label, joined in order."""
    first = top_rows(rows.select(*by, text, *[c.alias(f"_o{i}") for i, c in enumerate(order)]),
                     by, [F.col(f"_o{i}") for i in range(len(order))], n)
    packed = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", text))).alias("_x"))
    return packed.select(*by, F.array_join(F.transform("_x", lambda e: e[text]), "; ").alias("examples"))


def breakdown(rows: DataFrame, label: str, dimensions: Sequence[str]) -> DataFrame:
    """Counts per label and per label x dimension in one pass (grouping sets)."""
    groupings = [[F.col(label)]] + [[F.col(label), F.col(d)] for d in dimensions]
    wide = rows.groupingSets(groupings, F.col(label), *[F.col(d) for d in dimensions]).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_level")
    )
    bits = len(dimensions)
    dimension = F.when(F.col("_level") == (1 << bits) - 1, F.lit("all"))
    key = F.lit("all")
    for i, d in enumerate(dimensions):
        level = ((1 << bits) - 1) ^ (1 << (bits - 1 - i))
        dimension = dimension.when(F.col("_level") == level, F.lit(d))
        key = F.when(F.col("_level") == level, F.col(d).cast("string")).otherwise(key)
    return wide.select(label, dimension.alias("dimension"), key.alias("key"), "n")


def coverage_rates(rows: DataFrame, source: str, classified: Column, annotated: Column) -> DataFrame:
    """Classified and annotated rates per source and overall (``all``)."""
    return rows.rollup(source).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(classified).alias("classified"),
        F.avg(classified.cast("double")).alias("classified_rate"),
        F.avg(annotated.cast("double")).alias("annotated_rate"),
    ).withColumn(source, F.coalesce(F.col(source), F.lit("all")))


def gini(counts: DataFrame, value: str) -> DataFrame:
    """Gini index of a column of non-negative numbers."""
    keyed = counts.select(F.lit(0).alias("_all"), F.col(value).alias("_v"))
    tied = keyed.groupBy("_all", "_v").agg(F.count(F.lit(1)).alias("_t"))
    placed = running(tied, ["_all"], [F.col("_v")], {"_upto": "_t"})
    # ranks upto-t+1 .. upto share one value: their sum times the value
    weighted = F.col("_v") * (F.col("_t") * (2 * F.col("_upto") - F.col("_t") + 1) / 2)
    out = placed.agg(
        F.sum(weighted).alias("_w"), F.sum("_t").alias("_n"), F.sum(F.col("_v") * F.col("_t")).alias("_s")
    )
    n, s = F.col("_n"), F.col("_s")
    return out.select(F.when(s > 0, 2 * F.col("_w") / (n * s) - (n + 1) / n).otherwise(0.0).alias("gini"))


def top_words(rows: DataFrame, group: str, text: str, stop_words: Sequence[str], n: int = 15,
              least_length: int = 4) -> DataFrame:
    """Most frequent words per group: lower case, letters only, stop words out."""
    cleaned = F.regexp_replace(F.lower(text), "[^a-z\\s]", " ")
    words = rows.select(group, F.explode(F.split(cleaned, "\\s+")).alias("word")).filter(
        (F.length("word") >= least_length) & ~F.col("word").isin(list(stop_words))
    )
    counts = words.groupBy(group, "word").agg(F.count(F.lit(1)).alias("n"))
    return top_rows(counts, [group], [F.col("n").desc(), F.col("word")], n)


def leader_shares(rows: DataFrame, sample: Sequence[str], feature: str, value: str) -> DataFrame:
    """Which feature leads in each sample, and its share of the samples."""
    # equal values: the alphabetically first feature leads
    leader = F.min_by(feature, F.struct(-F.col(value), F.col(feature)))
    named = rows.groupBy(*sample).agg(leader.alias(feature))
    total = named.count() or 1
    return named.groupBy(feature).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(total)).alias("share")
    )


def multiplicity(mapping: DataFrame, target: str, feature: str) -> DataFrame:
    """How many targets have 1, 2, ... distinct features."""
    per = mapping.groupBy(target).agg(F.count_distinct(feature).alias("features"))
    return per.groupBy("features").agg(F.count(F.lit(1)).alias("targets"))


def assignment_counts(features: DataFrame, members: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Features by the number of systems that claim them."""
    systems = members.join(hierarchy, "set_id").select("feature", "system").distinct()
    per = features.select("feature").distinct().join(systems, "feature", "left").groupBy("feature").agg(
        F.count("system").alias("systems")
    )
    kind = (
        F.when(F.col("systems") == 0, "unassigned").when(F.col("systems") == 1, "single").otherwise("multi")
    )
    return per.groupBy(kind.alias("assignment")).agg(F.count(F.lit(1)).alias("n"))


def pooled_timepoints(rows: DataFrame, dataset: str, time: str, feature: str, value: str) -> DataFrame:
    """Mean over datasets of the dataset means per time and feature."""
    means = rows.groupBy(dataset, time, feature).agg(F.avg(value).alias("_m"))
    return means.groupBy(time, feature).agg(
        F.avg("_m").alias("mean"), F.count(F.lit(1)).alias("datasets")
    )


def impute_with_mean(values: DataFrame, feature: Sequence[str], value: str) -> DataFrame:
    """Null values become the feature's mean, attached by a join."""
    means = values.groupBy(*feature).agg(F.avg(value).alias("_mean"))
    return values.join(means, list(feature)).select(
        *[F.coalesce(F.col(value), F.col("_mean")).alias(value) if c == value else F.col(c)
          for c in values.columns]
    )


def cross_table(rows: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts with one column per value of a fixed list."""
    return rows.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0)


def score_agreement(known: DataFrame, tested: DataFrame, known_members: DataFrame,
                    tested_members: DataFrame, least_jaccard: float = 0.1, score: str = "es") -> DataFrame:
    """Known against tested sets that overlap: shared features, Jaccard index
    and correlation of their scores over samples.

    Pairs come from shared features only, so disjoint sets never meet.
    """
    a = known_members.select(F.col("set_id").alias("known"), "feature").distinct()
    b = tested_members.select(F.col("set_id").alias("tested"), "feature").distinct()
    overlap = a.join(b, "feature").groupBy("known", "tested").agg(F.count(F.lit(1)).alias("overlap"))
    sizes = overlap.join(a.groupBy("known").agg(F.count(F.lit(1)).alias("_a")), "known").join(
        b.groupBy("tested").agg(F.count(F.lit(1)).alias("_b")), "tested"
    )
    pairs = sizes.withColumn(
        "jaccard", F.col("overlap") / (F.col("_a") + F.col("_b") - F.col("overlap"))
    ).filter(F.col("jaccard") > least_jaccard)
    x = known.select("sample", F.col("set_id").alias("known"), F.col(score).alias("_x"))
    y = tested.select("sample", F.col("set_id").alias("tested"), F.col(score).alias("_y"))
    both = pairs.join(x, "known").join(y, ["tested", "sample"])
    return both.groupBy("known", "tested").agg(
        F.max("overlap").alias("overlap"), F.max("jaccard").alias("jaccard"),
        correlation("_x", "_y").alias("correlation"),
    )
