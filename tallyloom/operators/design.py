"""Study design from sample attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

# The five designs and what each needs.
TIME_SERIES = "time_series"
CASE_CONTROL = "case_control"
SUBTYPES = "subtype_comparison"
TRAIT = "continuous_trait_association"
UNSUPERVISED = "unsupervised_pattern_discovery"
LEAST_TIMED, LEAST_TIMES = 6, 3
LEAST_PER_ARM = 2
LEAST_SUBTYPES, LEAST_PER_SUBTYPE = 3, 2
LEAST_TRAIT, LEAST_SPREAD = 6, 1e-9
SMALL_STUDY = 8


def trait_values(samples: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, sample, priority, trait, value) of the samples that have it."""
    rows = samples.select(dataset, "sample", F.inline("traits"))
    return rows.filter(F.col("value").isNotNull())


def chosen_trait(samples: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Per dataset the first trait, in priority order, that enough samples have."""
    hits = trait_values(samples, dataset).groupBy(dataset, "priority", "trait").agg(
        F.count(F.lit(1)).alias("hits"), F.stddev_pop("value").alias("spread")
    )
    best = hits.filter(F.col("hits") >= LEAST_TRAIT).groupBy(dataset).agg(
        F.min_by(F.struct("trait", "hits", "spread"), "priority").alias("_t")
    )
    return best.select(dataset, "_t.*")


def design_signals(samples: DataFrame, dataset: str = "dataset") -> DataFrame:
    """One row per dataset: the counts the design decision rests on."""
    base = samples.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count("days").alias("timed"),
        F.count_distinct("days").alias("times"),
        F.count_if(F.col("group") == "control").alias("controls"),
        F.count_if(F.col("group") == "disease").alias("cases"),
    )
    sizes = samples.filter(F.col("subtype") != "unknown").groupBy(dataset, "subtype").agg(
        F.count(F.lit(1)).alias("_n")
    )
    subtypes = sizes.groupBy(dataset).agg(F.count_if(F.col("_n") >= LEAST_PER_SUBTYPE).alias("subtypes"))
    return base.join(subtypes, dataset, "left").join(chosen_trait(samples, dataset), dataset, "left").fillna(
        0, ["subtypes", "hits"]
    )


def infer_design(samples: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Design of every dataset at once: time series over case/control over
    subtypes over trait over none."""
    s = design_signals(samples, dataset)
    mode = (
        F.when((F.col("timed") >= LEAST_TIMED) & (F.col("times") >= LEAST_TIMES), TIME_SERIES)
        .when((F.col("controls") >= LEAST_PER_ARM) & (F.col("cases") >= LEAST_PER_ARM), CASE_CONTROL)
        .when(F.col("subtypes") >= LEAST_SUBTYPES, SUBTYPES)
        .when(F.col("trait").isNotNull() & (F.col("spread") > LEAST_SPREAD), TRAIT)
        .otherwise(UNSUPERVISED)
    )
    with_mode = s.withColumn("mode", mode)
    grouping = (
        F.when(F.col("mode") == TIME_SERIES, "timepoint")
        .when(F.col("mode") == CASE_CONTROL, "control_vs_disease")
        .when(F.col("mode") == SUBTYPES, "subtype")
        .when(F.col("mode") == TRAIT, F.col("trait"))
    )
    return with_mode.withColumns(
        {"primary_grouping": grouping, "small_study": F.col("samples") < SMALL_STUDY}
    )


def _long(rows: DataFrame, block: str, dataset: str, key: str | Column, metrics: list[str]) -> DataFrame:
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    key = F.col(key) if isinstance(key, str) else key
    return rows.select(dataset, F.lit(block).alias("block"), key.cast("string").alias("key"), F.inline(values))


#: Why a dataset's statistics are plain means, by what its own design lacked.
FALLBACK_REASONS = {
    CASE_CONTROL: "no feature with two samples in both arms",
    TIME_SERIES: "no feature with three timed samples",
    SUBTYPES: "no feature with three subtypes of two samples",
    TRAIT: "no feature with six samples and a trait that varies",
    UNSUPERVISED: "no design found",
}


def design_statistics(rows: DataFrame, dataset: str = "dataset") -> DataFrame:
    """``(dataset, block = mode, key = feature, metric, value)`` of each dataset's own design."""
    from tallyloom.operators import statistics as st

    keys = [dataset, "feature"]
    of = lambda mode: rows.filter(F.col("mode") == mode)
    pairs = st.case_control(st.enough(st.two_group_moments(of(CASE_CONTROL), keys, "group", "disease", "control")))
    times = st.time_summary(of(TIME_SERIES), keys, [dataset]).filter("n >= 3")
    subs = st.subtype_comparison(of(SUBTYPES), keys, "subtype").filter(F.col("groups") >= LEAST_SUBTYPES)
    subs = subs.groupBy(*keys).agg(F.max("spread").alias("spread"), F.max("groups").alias("groups"))
    named = of(TRAIT).withColumn(
        "_trait", F.try_element_at(F.filter("traits", lambda t: t["trait"] == F.col("trait")), F.lit(1))["value"])
    traits = st.trait_association(named, keys, "_trait")
    return (
        _long(pairs, CASE_CONTROL, dataset, "feature", ["n_a", "n_b", "mean_diff", "fold_change", "effect_size", "p_value"])
        .unionByName(_long(times, TIME_SERIES, dataset, "feature", ["n", "slope", "peak_time", "shift"]))
        .unionByName(_long(subs, SUBTYPES, dataset, "feature", ["spread", "groups"]))
        .unionByName(_long(traits, TRAIT, dataset, "feature", ["n", "r"]))
    )


def cross_cutting(rows: DataFrame, expected: DataFrame, systems: list[str], dataset: str = "dataset") -> DataFrame:
    """Results that every dataset has whatever its design: variance by feature
    and system, coordination of systems, expected against observed, pairs,
    response and severity."""
    from tallyloom.operators import statistics as st
    from tallyloom.operators.joins import phase_pairs

    keys = [dataset, "feature"]
    # one value for each sample and system, from which all system results follow
    by_system = rows.groupBy(dataset, "sample", "system").agg(F.avg("value").alias("value"))
    variance = st.heterogeneity(rows, keys)
    system_variance = st.heterogeneity(by_system, [dataset, "system"])
    together = st.pair_correlations(by_system, [dataset], "sample", "system", "value", systems).filter("n >= 3")
    means = by_system.groupBy(dataset, "system").agg(F.avg("value").alias("score"))
    seen = st.expected_against_observed(means, expected).withColumns(
        {c: F.size(c) for c in ("matched", "missing", "unexpected")})
    pairs = rows.filter("pair IS NOT NULL").withColumn("_pair", F.struct(dataset, "pair"))
    deltas = phase_pairs(pairs, "_pair", "phase", [F.col("sample")], "feature", "value") \
        .select(F.col(f"_pair.{dataset}").alias(dataset), "feature", "delta")
    response = st.enough(st.two_group_moments(rows, keys, "response", "responder", "non_responder")) \
        .withColumn("mean_diff", F.col("mean_a") - F.col("mean_b"))
    severity = st.trait_association(rows, keys, "severity")
    return (
        _long(variance, "heterogeneity", dataset, "feature", ["variance"])
        .unionByName(_long(system_variance, "system_heterogeneity", dataset, "system", ["variance"]))
        .unionByName(_long(together, "coordination", dataset, F.concat_ws("|", "a", "b"), ["n", "r"]))
        .unionByName(_long(seen, "expected", dataset, F.lit("all"), ["matched", "missing", "unexpected"]))
        .unionByName(_long(st.paired_change(deltas, keys), "pairs", dataset, "feature", ["pairs", "mean_delta", "sd_delta"]))
        .unionByName(_long(response, "response", dataset, "feature", ["n_a", "n_b", "mean_diff"]))
        .unionByName(_long(severity, "severity", dataset, "feature", ["n", "r"]))
    )


def run_statistics(values: DataFrame, samples: DataFrame, expected: DataFrame, systems: list[str], system_of,
                   dataset: str = "dataset") -> DataFrame:
    """``(dataset, block, key, metric, value, note)``: everything a run reports, in long form.

    The rows with their design are written once and read by every block.  A
    dataset whose scores do not support its design falls back to plain means;
    the block ``status`` has one row for each dataset with its design and, in
    ``note``, the reason of a fallback.
    """
    designs = infer_design(samples, dataset).select(dataset, "mode", "trait")
    rows = cut(values.join(samples, [dataset, "sample"]).join(F.broadcast(designs), dataset)
               .withColumn("system", system_of(F.col("feature"))))
    own = cut(design_statistics(rows, dataset))
    done = own.select(dataset).distinct().withColumn("_done", F.lit(True))
    states = rows.select(dataset, "mode").distinct().join(done, dataset, "left")
    reason = F
    for mode, text in FALLBACK_REASONS.items():
        reason = reason.when(F.col("mode") == mode, text)
    status = states.select(dataset, F.lit("status").alias("block"), F.col("mode").alias("key"), F.lit("fallback").alias("metric"),
                           F.when(F.col("_done"), 0.0).otherwise(1.0).alias("value"),
                           F.when(F.col("_done").isNull(), reason).alias("note"))
    left = rows.join(F.broadcast(states.filter(F.col("_done").isNull()).select(dataset)), dataset)
    means = left.groupBy(dataset, "feature").agg(F.avg("value").alias("mean"))
    results = own.unionByName(_long(means, UNSUPERVISED, dataset, "feature", ["mean"])) \
        .unionByName(cross_cutting(rows, expected, systems, dataset))
    return results.withColumn("note", F.lit(None).cast("string")).unionByName(status)


# The tables a report of each design is made of.
BASE_TABLES = ["radar", "barplot"]
MODE_TABLES = {
    CASE_CONTROL: ["boxplot", "heatmap", "expected_vs_observed_barplot"],
    TIME_SERIES: ["time_series_system", "time_series_subcategory", "heatmap"],
    SUBTYPES: ["grouped_subtype_boxplot", "heatmap", "correlation"],
    TRAIT: ["trait_scatter_plot", "correlation", "heatmap"],
    UNSUPERVISED: ["heatmap", "correlation", "heterogeneity_heatmap"],
}
EXTRA_TABLES = {
    "has_expected": "expected_vs_observed_barplot", "has_coordination": "system_correlation_matrix",
    "has_heterogeneity": "heterogeneity_heatmap",
}


def table_plan(designs: DataFrame) -> DataFrame:
    """(…, tables): ordered distinct tables to write for each dataset, by its
    ``mode`` and the optional flags ``has_expected``, ``has_coordination``,
    ``has_heterogeneity``."""
    by_mode = F
    for mode, names in MODE_TABLES.items():
        by_mode = by_mode.when(F.col("mode") == mode, F.array(*[F.lit(n) for n in names]))
    extra = F.array_compact(F.array(*[
        F.when(F.col(flag), F.lit(name)) for flag, name in EXTRA_TABLES.items() if flag in designs.columns
    ])) if any(f in designs.columns for f in EXTRA_TABLES) else F.array().cast("array<string>")
    listed = F.concat(F.array(*[F.lit(n) for n in BASE_TABLES]), by_mode.otherwise(F.array(F.lit("heatmap"), F.lit("correlation"))), extra)
    return designs.withColumn("tables", F.array_distinct(listed))


# How the simple form tells times and groups, and the words of a disease study.
SHORT_TIME = r"(\d+)\s*(day|hour|h|d)"
TIME_WORDS = ["time", "day", "hour"]
GROUP_WORDS = ["control", "treatment", "disease", "normal", "patient", "group"]
DISEASE_STUDY_WORDS = ["disease", "patient", "control", "normal", "treatment"]


def simple_labels(items: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, sample, time, group) of attribute rows (dataset, sample, pos, text).

    The last attribute that speaks of time gives the time, as number and unit
    letter where it has them; the last other one with a group word is the group.
    """
    lower = F.lower("text")
    timed = F.lit(False)
    for word in TIME_WORDS:
        timed = timed | lower.contains(word)
    grouped = F.lit(False)
    for word in GROUP_WORDS:
        grouped = grouped | lower.contains(word)
    short = F.concat(F.regexp_extract(lower, SHORT_TIME, 1), F.substring(F.regexp_extract(lower, SHORT_TIME, 2), 1, 1))
    return items.groupBy(dataset, "sample").agg(
        F.max_by(F.when(short != "", short).otherwise(F.col("text")), F.when(timed, F.col("pos"))).alias("time"),
        F.max_by("text", F.when(grouped & ~timed, F.col("pos"))).alias("group"))


def dataset_types(labels: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, times, groups, type): three distinct times make a time series,
    two groups with a disease word among them a disease study."""
    word = F.lit(False)
    for w in DISEASE_STUDY_WORDS:
        word = word | F.lower("group").contains(w)
    out = labels.groupBy(dataset).agg(
        F.count_distinct("time").alias("times"), F.count_distinct("group").alias("groups"), F.coalesce(F.bool_or(word), F.lit(False)).alias("_word"))
    kind = F.when(F.col("times") >= 3, TIME_SERIES).when((F.col("groups") >= 2) & F.col("_word"), "disease_control").otherwise("other")
    return out.withColumn("type", kind).drop("_word")
