"""Rules held in a table and joined at run time: title rules, thresholds, alerts.

A rule names the scope it is for (``*`` is any), its priority, what it looks
for and what follows from it.  Rules are rows, so a deployment changes them
without a new plan; the table is small, and is sent to the rows while a bounded
count says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.joins import small_side

ANY = "*"

# The shipped thresholds as (scope, metric, op, limit, code, severity, priority); a share is of all entries.
SHIPPED_THRESHOLDS = (
    ("terms", "process_terms", "=", 0.0, "no_process_terms", "error", 1),
    ("terms", "process_terms", "<", 1000.0, "few_process_terms", "warning", 2),
    ("terms", "obsolete_share", ">", 0.1, "many_obsolete_terms", "warning", 1),
    ("terms", "missing_definition_share", ">", 0.05, "many_missing_definitions", "warning", 1),
    ("pathways", "pathways", "<", 100.0, "few_pathways", "warning", 1),
    ("pathways", "pathways", ">", 1000.0, "many_pathways", "info", 1),
    ("pathways", "metabolism_pathways", "=", 0.0, "no_metabolism_pathways", "warning", 1),
    ("*", "errors", ">", 0.0, "repair_errors", "error", 1),
    ("*", "warnings", ">", 0.0, "repair_warnings", "warning", 1),
    ("coverage", "coverage", "<", 0.8, "low_coverage", "error", 1),
    ("coverage", "coverage", "<", 0.9, "medium_coverage", "warning", 2),
    ("coverage", "coverage", ">=", 0.9, "good_coverage", "info", 3),
    ("coverage", "largest_to_smallest_system", ">", 5.0, "uneven_systems", "warning", 1),
)
# What mending is reckoned to bring.
GAIN_BY_ERROR, MOST_ERROR_GAIN, COVERAGE_GAIN_WEIGHT, HARD_ERRORS = 2.0, 20.0, 0.6, 10
PRIORITY_ORDER = {"high": 3, "medium": 2, "low": 1}


def rule_frame(spark: SparkSession, rules: Sequence[tuple]) -> DataFrame:
    """``(scope, priority, pattern, effect)`` of rows in that order."""
    return spark.createDataFrame(list(rules), "scope string, priority int, pattern string, effect string")


def threshold_frame(spark: SparkSession, rules: Sequence[tuple] = SHIPPED_THRESHOLDS) -> DataFrame:
    return spark.createDataFrame(list(rules), "scope string, metric string, op string, limit double, code string, severity string, priority int")


def first_by_rule(rows: DataFrame, rules: DataFrame, keys: Sequence[str], scope: str, text: str, name: str = "effect", otherwise: str | None = None) -> DataFrame:
    """``rows`` with the effect of the first rule (by priority, then effect) of its scope, or of any, whose pattern its text holds.

    ``keys`` name a row.  Without a rule that fits it has ``otherwise``.
    """
    asked = rows.select(*keys, F.col(text).alias("_text"), F.explode(F.array(F.col(scope).cast("string"), F.lit(ANY))).alias("_scope"))
    fitting = asked.join(small_side(rules.withColumnRenamed("scope", "_scope")), "_scope").filter(F.rlike("_text", F.col("pattern")))
    # a scope's own rule comes before one for any scope
    order = F.struct((F.col("_scope") == ANY).alias("any"), "priority", "effect")
    best = fitting.groupBy(*keys).agg(F.min_by("effect", order).alias(name))
    return rows.join(best, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(otherwise)))


def broken_thresholds(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """``(scope, metric, value, code, severity)``: of each metric's rules that hold, the one of least priority.

    ``metrics (scope, metric, value double)``; a rule for any scope is for every scope that has the metric.
    """
    value, limit = F.col("value"), F.col("limit")
    holds = (F.when(F.col("op") == "<", value < limit).when(F.col("op") == "<=", value <= limit).when(F.col("op") == ">", value > limit)
             .when(F.col("op") == ">=", value >= limit).otherwise(value == limit))
    asked = metrics.select("scope", "metric", "value", F.explode(F.array("scope", F.lit(ANY))).alias("_scope"))
    fitting = asked.join(small_side(rules.withColumnRenamed("scope", "_scope")), ["_scope", "metric"]).filter(holds)
    best = fitting.groupBy("scope", "metric", "value").agg(F.min_by(F.struct("code", "severity"), F.struct("priority", "code")).alias("r"))
    return best.select("scope", "metric", "value", "r.code", "r.severity")


def issue_priorities(counts: DataFrame) -> DataFrame:
    """``(category, priority, count, impact, place)`` of ``counts (category, count)``: errors and low coverage first, then by count.

    Categories: ``errors``, ``warnings``, ``low_coverage`` and, with its own
    name, each kind of failure.
    """
    category = F.col("category")
    priority = F.when(category.isin("errors", "low_coverage", "system_error"), "high").otherwise("medium")
    impact = F.when(category == "errors", "critical").when(category == "low_coverage", "high").otherwise("moderate")
    rated = counts.filter("count > 0").select("category", priority.alias("priority"), "count", impact.alias("impact"))
    from tallyloom.operators.ordering import running

    order = F.create_map(*[F.lit(x) for item in PRIORITY_ORDER.items() for x in item])[F.col("priority")]
    return running(rated.withColumn("_all", F.lit(0)), ["_all"], [order.desc(), F.col("count").desc(), category], position="place", small=True).drop("_all")


def estimated_gain(figures: DataFrame) -> DataFrame:
    """``figures (.., errors, recoverable, entries)`` with the points that mending errors and rules would bring, and the effort."""
    errors = F.least(F.lit(MOST_ERROR_GAIN), F.col("errors") * GAIN_BY_ERROR)
    coverage = F.coalesce(F.try_divide(F.col("recoverable"), F.col("entries")), F.lit(0.0)) * 100
    steps = (F.col("errors") > 0).cast("int") + (F.col("recoverable") > 0).cast("int")
    return figures.withColumns({
        "error_gain": errors.cast("double"), "coverage_gain": coverage,
        "total_gain": errors + coverage * COVERAGE_GAIN_WEIGHT,
        "error_effort": F.when(F.col("errors") > HARD_ERRORS, "high").when(F.col("errors") > 0, "medium"),
        "effort": F.when(steps == 0, "minimal").when(steps <= 2, "low").when(steps <= 4, "medium").otherwise("high")})
