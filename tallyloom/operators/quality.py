"""Issue tables, quality scores and coverage reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.labels import quality_level

# Penalties, weights and thresholds of the quality reports.
ERROR_PENALTY, WARNING_PENALTY = 5.0, 2.0
QUALITY_WEIGHT, COVERAGE_WEIGHT = 0.4, 0.6
SCORE_GAP = 20.0
SUGGESTION_STEP, SUGGESTION_CAP = 0.2, 0.8


def issues(rows: DataFrame, key: str, checks: Sequence[tuple[str, str, str, Column]]) -> DataFrame:
    """One row per failed check: (key, type, severity, field).

    ``checks`` are (type, severity, field, failing condition).
    """
    failed = F.array_compact(F.array(*[
        F.when(F.coalesce(condition, F.lit(False)),
               F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(name).alias("field")))
        for kind, severity, name, condition in checks
    ]))
    return rows.select(key, F.inline(failed))


def quality_score(rows: DataFrame, found: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """``100 * valid / total - 5 * errors - 2 * warnings``, kept in 0..100.

    An entry with an error is not valid.
    """
    marks = found.groupBy(key).agg(
        F.count_if(F.col("severity") == "error").alias("_e"), F.count_if(F.col("severity") == "warning").alias("_w"))
    joined = rows.select(key, *by).join(marks, key, "left").fillna(0, ["_e", "_w"])
    out = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_e") == 0).alias("valid"),
        F.sum("_e").alias("errors"), F.sum("_w").alias("warnings"))
    raw = (100.0 * F.col("valid") / F.col("total") - ERROR_PENALTY * F.col("errors")
           - WARNING_PENALTY * F.col("warnings"))
    return out.withColumns({
        "score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)),
        "completeness": F.col("valid") / F.col("total")})


def classification_checks(rows: DataFrame) -> DataFrame:
    band = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    return rows.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("subsystem").isNotNull() & (F.substring("subsystem", 1, 1) != F.col("system"))).alias("inconsistent"),
        F.count_if(F.col("system").isNull()).alias("incomplete"))


def coverage(entries: DataFrame, results: DataFrame, key: str, by: str) -> DataFrame:
    """Classified share per value of ``by`` and overall (``all``)."""
    marked = entries.select(key, by).join(results.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return marked.rollup(by).agg(
        F.count(F.lit(1)).alias("total"), F.count("_hit").alias("classified"),
        (F.count("_hit") / F.count(F.lit(1))).alias("coverage"),
    ).withColumn(by, F.coalesce(by, F.lit("all")))


def failure_reasons(missed: DataFrame, text: Column, words: Mapping[str, Sequence[str]]) -> DataFrame:
    """Why an entry stayed unclassified, and the system its words suggest.

    The system with most words wins (first declared on ties) with confidence
    0.2 per word, at most 0.8.
    """
    from tallyloom.operators.classification import best_of, how_many, with_found

    rows = with_found(missed.withColumn("_t", text), F.lower("_t"), [w for ws in words.values() for w in ws])
    counts = {label: how_many(ws) for label, ws in words.items()}
    most = F.greatest(*counts.values())
    reason = (
        F.when(F.coalesce(F.length(F.trim("_t")), F.lit(0)) == 0, "no_text")
        .when(F.length("_t") < 20, "short_text").when(most == 0, "no_keyword").otherwise("ambiguous"))
    return rows.withColumns({
        "reason": reason, "suggested": best_of(counts),
        "suggestion_confidence": F.least(F.lit(SUGGESTION_CAP), most * SUGGESTION_STEP),
    }).drop("_t", "_found")


def shares_of(rows: DataFrame, label: str) -> DataFrame:
    total = rows.count() or 1
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(total)).alias("share"))


def inconsistent_results(rows: DataFrame, key: str, primary: str, every: str) -> DataFrame:
    """Results whose primary label is missing from the list of all labels."""
    return rows.filter(~F.array_contains(every, F.col(primary))).select(key, primary, every)


def overall_quality(score: Column, coverage_share: Column) -> dict[str, Column]:
    total = QUALITY_WEIGHT * score + COVERAGE_WEIGHT * coverage_share * 100
    return {"overall": total, "level": quality_level(total)}


def threshold_codes(metrics: DataFrame, rules: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """Codes of the rules a metric breaks: (metric, ``<`` or ``>``, limit, code)."""
    out = None
    rule = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(op).alias("op"), F.lit(float(limit)).alias("limit"), F.lit(code).alias("code"))
        for code, m, op, limit in rules
    ])
    matching = F.filter(rule, lambda r: (r["metric"] == F.col("metric")) & F.when(
        r["op"] == "<", F.col("value") < r["limit"]).otherwise(F.col("value") > r["limit"]))
    return metrics.select("metric", "value", F.explode(F.transform(matching, lambda r: r["code"])).alias("code"))


def source_consistency(issue_table: DataFrame, source: str) -> DataFrame:
    """Issues per type in both sources, to be compared side by side."""
    return issue_table.groupBy("type", "severity").pivot(source, ["GO", "KEGG"]).agg(F.count(F.lit(1))).fillna(0)
