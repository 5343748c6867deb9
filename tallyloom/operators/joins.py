"""Joins of measurements, mappings, attributes and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import quantiles
from tallyloom.session import broadcast_rows


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` when a bounded count proves it small, else leave it to
    the optimizer (sort-merge with adaptive skew splitting)."""
    limit = broadcast_rows(df.sparkSession)
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def map_features(
    values: DataFrame,
    mapping: DataFrame,
    keys: Sequence[str],
    feature: str = "feature",
    target: str = "target",
    value: str = "value",
    method: str = "mean",
) -> DataFrame:
    """Carry features over to their targets and combine rows that meet.

    ``mapping`` is (feature, target), many-to-many; ``method`` is ``mean``,
    ``max`` or ``median``.  Means and maxima are combined map-side.
    """
    joined = values.join(small_side(mapping.select(feature, target).distinct()), feature)
    moved = joined.select(*keys, F.col(target).alias(feature), value)
    if method == "median":
        return quantiles(moved, [*keys, feature], value, {value: 0.5})
    combine = {"mean": F.avg, "max": F.max}[method]
    return moved.groupBy(*keys, feature).agg(combine(value).alias(value))


def map_features_or_keep(
    values: DataFrame,
    mapping: DataFrame | None,
    keys: Sequence[str],
    feature: str = "feature",
    targets: str = "targets",
    value: str = "value",
) -> DataFrame:
    """One-to-many form: ``mapping`` holds an array of targets per feature.
    Without a mapping the features stand for themselves."""
    if mapping is None:
        return values.groupBy(*keys, feature).agg(F.avg(value).alias(value))
    flat = mapping.select(feature, F.explode(targets).alias("target"))
    return map_features(values, flat, keys, feature, "target", value)


def set_members(terms: DataFrame, term_features: DataFrame) -> DataFrame:
    """(set_id, term_id) joined with (term_id, feature): distinct (set_id, feature)."""
    return terms.join(term_features, "term_id").select("set_id", "feature").distinct()


def set_coverage(members: DataFrame, measured: DataFrame) -> DataFrame:
    """Per set: members, members that were measured, and their share."""
    present = measured.select("feature").distinct().withColumn("_hit", F.lit(1))
    return (
        members.select("set_id", "feature")
        .distinct()
        .join(present, "feature", "left")
        .groupBy("set_id")
        .agg(F.count(F.lit(1)).alias("members"), F.count("_hit").alias("matched"))
        .withColumn("coverage", F.col("matched") / F.col("members"))
    )


def covered_features(members: DataFrame, measured: DataFrame) -> DataFrame:
    """Per measured feature set: how many measured features any set claims."""
    claimed = members.select("feature").distinct().withColumn("_hit", F.lit(1))
    return (
        measured.select("feature")
        .distinct()
        .join(claimed, "feature", "left")
        .agg(F.count(F.lit(1)).alias("measured"), F.count("_hit").alias("classified"))
        .withColumn("unclassified", F.col("measured") - F.col("classified"))
        .withColumn("coverage", F.col("classified") / F.col("measured"))
    )


def enrich(
    rows: DataFrame, attributes: DataFrame, key: str, columns: Sequence[str], default: str = "Unknown"
) -> DataFrame:
    """Left join of attributes; unmatched or null attributes become ``default``."""
    joined = rows.join(attributes.select(key, *columns), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in columns})


def first_known(rows: DataFrame, sources: Sequence[DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """Attributes from the first source that has them, source by source."""
    out = rows
    for i, source in enumerate(sources):
        out = out.join(
            source.select(key, *[F.col(c).alias(f"_{i}_{c}") for c in columns]), key, "left"
        )
    return out.select(
        *rows.columns,
        *[F.coalesce(*[F.col(f"_{i}_{c}") for i in range(len(sources))]).alias(c) for c in columns],
    )


def without(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")


def compare_versions(
    current: DataFrame, previous: DataFrame, key: str, label: str, score: str
) -> DataFrame:
    """Per id: common, new or removed; changed label; change of score."""
    now = current.select(key, F.col(label).alias("label_now"), F.col(score).alias("score_now"))
    old = previous.select(key, F.col(label).alias("label_before"), F.col(score).alias("score_before"))
    now, old = now.withColumn("_now", F.lit(True)), old.withColumn("_old", F.lit(True))
    both = now.join(old, key, "full_outer")
    state = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_now").isNull(), "removed")
        .when(~F.col("label_now").eqNullSafe(F.col("label_before")), "changed")
        .otherwise("same")
    )
    return both.select(
        key,
        state.alias("state"),
        "label_now",
        "label_before",
        (F.col("score_now") - F.col("score_before")).alias("score_change"),
    )


def version_summary(compared: DataFrame) -> DataFrame:
    return compared.groupBy("state").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score_change").alias("mean_score_change"),
        F.count_if(F.col("score_change") > 0).alias("improved"),
        F.count_if(F.col("score_change") < 0).alias("declined"),
    )


def distribution_change(current: DataFrame, previous: DataFrame, label: str) -> DataFrame:
    """Counts and shares per label in both versions and their differences."""
    total_now, total_old = max(current.count(), 1), max(previous.count(), 1)
    tagged = current.select(label, F.lit(1).alias("_now"), F.lit(0).alias("_old")).unionByName(
        previous.select(label, F.lit(0).alias("_now"), F.lit(1).alias("_old"))
    )
    counts = tagged.groupBy(label).agg(F.sum("_now").alias("n_now"), F.sum("_old").alias("n_before"))
    return counts.select(
        label,
        "n_now",
        "n_before",
        (F.col("n_now") - F.col("n_before")).alias("n_change"),
        (F.col("n_now") / total_now - F.col("n_before") / total_old).alias("share_change"),
    )


def baseline_deltas(
    rows: DataFrame, subject: str, time: str, order: Sequence[Column], feature: str, value: str
) -> DataFrame:
    """Later rows of a subject minus the subject's baseline row, per feature.

    The baseline is the subject's first row in ``order``; it is found with an
    aggregate, so a subject's rows need not meet in one task.
    """
    first = rows.groupBy(subject, feature).agg(
        F.min_by(F.struct(time, value), F.struct(*order)).alias("_base")
    )
    joined = rows.join(first, [subject, feature])
    return joined.filter(F.col(time) != F.col(f"_base.{time}")).select(
        subject,
        feature,
        time,
        F.col(f"_base.{time}").alias("baseline_time"),
        (F.col(value) - F.col(f"_base.{value}")).alias("delta"),
    )


def phase_pairs(
    rows: DataFrame, pair: str, phase: str, order: Sequence[Column], feature: str, value: str
) -> DataFrame:
    """Pre and post value per pair and feature, last row of a phase wins; pairs
    that lack a phase drop out."""
    last = F.struct(*order)
    wide = rows.groupBy(pair, feature).agg(
        F.max_by(value, F.when(F.col(phase) == "pre", last)).alias("pre"),
        F.max_by(value, F.when(F.col(phase) == "post", last)).alias("post"),
    )
    return wide.filter(F.col("pre").isNotNull() & F.col("post").isNotNull()).withColumn(
        "delta", F.col("post") - F.col("pre")
    )


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both tables, the new row winning on equal keys."""
    kept = existing.join(new.select(key), key, "left_anti")
    return kept.unionByName(new)


def link_by_pattern(files: DataFrame, column: str, pattern: str, catalogue: DataFrame, key: str, any_other: bool = False) -> DataFrame:
    """Files joined to the catalogue row whose id appears in the file name.

    ``any_other`` gives a file without such a row the catalogue's first one
    (least id) instead, with ``matched`` telling which it is.
    """
    named = files.withColumn(key, F.nullif(F.regexp_extract(column, pattern, 1), F.lit("")))
    if not any_other:
        return named.join(catalogue, key, "left")
    joined = named.join(catalogue.withColumn("_hit", F.lit(True)), key, "left")
    others = [c for c in catalogue.columns if c != key]
    first = catalogue.agg(F.min_by(F.struct(*catalogue.columns), key).alias("_first"))  # one row
    filled = joined.join(F.broadcast(first), F.lit(True), "left")
    return filled.select(
        *[c for c in files.columns if c != key], F.when(F.col("_hit"), F.col(key)).otherwise(F.col(f"_first.{key}")).alias(key),
        *[F.when(F.col("_hit"), F.col(c)).otherwise(F.col(f"_first.{c}")).alias(c) for c in others], F.coalesce("_hit", F.lit(False)).alias("matched"))
