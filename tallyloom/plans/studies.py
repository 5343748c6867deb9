"""Samples with free-text attributes, read out of the customer and order tables.

dataset = nation, sample = customer, feature = order priority and status, value
= mean log price.  The attribute texts are put together from the customer row,
so that nations differ in their study design.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.metadata import sample_design, sample_items
from tallyloom.session import cut, table

# (condition on the nation, text) per attribute line, valid in Spark and DuckDB
LINES = [
    ("c_nationkey % 5 = 0", "'time: ' || ((c_custkey // 25) % 4 * 12) || ' hours'"),
    ("c_nationkey % 5 = 1", "'condition: ' || CASE WHEN c_custkey % 3 = 0 THEN 'healthy control' ELSE 'Patient' END"),
    ("c_nationkey % 5 = 2", "'Subtype = Type ' || (c_custkey % 4)"),
    ("c_nationkey % 5 = 3", "'age: ' || CAST(18 + c_custkey % 60 AS VARCHAR(10)) || ' years'"),
    ("true", "'tissue: ' || lower(c_mktsegment)"),
    ("c_nationkey % 5 <> 1", "'subject: P' || (c_custkey // 50)"),
    ("c_nationkey % 5 <> 1", "'phase: ' || CASE WHEN c_custkey % 2 = 0 THEN 'baseline visit' ELSE 'follow-up visit' END"),
    ("true", "'response: ' || CASE c_custkey % 3 WHEN 0 THEN 'non-responder' WHEN 1 THEN 'complete response' ELSE 'stable' END"),
    ("c_custkey % 7 <> 0 AND c_nationkey % 5 <> 4", "'stage: ' || (1 + c_custkey % 4)"),
]

ATTRS = "attrs AS (" + " UNION ALL ".join(
    f"SELECT c_nationkey AS dataset, c_custkey AS sample, {i} AS pos, {text} AS text FROM customer WHERE {when}"
    for i, (when, text) in enumerate(LINES)
) + ")"

FIRST = "min(CASE WHEN {key} THEN value END)"

# every key occurs once per sample in these lines, so min() picks its value
DESIGN = ATTRS + r""",
kv AS (SELECT *, lower(trim(regexp_extract(text, '^([^:=]*)[:=](.*)$', 1))) AS key,
  trim(regexp_extract(text, '^([^:=]*)[:=](.*)$', 2)) AS value FROM attrs),
raw AS (SELECT dataset, sample, string_agg(text, ' ' ORDER BY pos) AS merged,
  coalesce(min(CASE WHEN key = 'condition' THEN value END), string_agg(text, ' ' ORDER BY pos)) AS g,
  min(CASE WHEN key = 'subtype' THEN value END) AS st, min(CASE WHEN key = 'time' THEN value END) AS tm,
  min(CASE WHEN key = 'age' THEN value END) AS age, min(CASE WHEN key = 'subject' THEN value END) AS pair,
  lower(coalesce(min(CASE WHEN key = 'phase' THEN value END), min(CASE WHEN key = 'condition' THEN value END))) AS ph,
  min(CASE WHEN key = 'response' THEN value END) AS rs, min(CASE WHEN key = 'stage' THEN value END) AS sv
  FROM kv GROUP BY 1, 2),
design AS (SELECT dataset, sample, merged,
  CASE WHEN regexp_matches(lower(g), '\b(control|healthy|normal|wt|wild type)s?\b') THEN 'control'
    WHEN regexp_matches(lower(g), '\b(disease|patient|tumor|case)s?\b') THEN 'disease'
    ELSE substr(regexp_replace(lower(g), '\s+', '_', 'g'), 1, 40) END AS "group",
  coalesce(substr(regexp_replace(lower(st), '\s+', '_', 'g'), 1, 40), 'unknown') AS subtype,
  CAST(nullif(regexp_extract(tm, '(-?[0-9]+)', 1), '') AS DOUBLE) / 24 AS days,
  CAST(nullif(regexp_extract(age, '(-?[0-9]+)', 1), '') AS DOUBLE) AS age,
  pair, CASE WHEN regexp_matches(ph, 'pre|before|baseline') THEN 'pre'
    WHEN regexp_matches(ph, 'post|after|followup|follow-up') THEN 'post' ELSE ph END AS phase,
  CASE WHEN regexp_matches(lower(rs), 'non-responder|refractory|resistant|progression') THEN 'non_responder'
    WHEN regexp_matches(lower(rs), 'responder|response|sensitive|remission') THEN 'responder' ELSE 'unknown' END AS response,
  CAST(nullif(regexp_extract(sv, '([0-9]+)', 1), '') AS DOUBLE) AS severity FROM raw)"""

# counts and design of each dataset, from the CTE above
MODES = """b AS (SELECT dataset, count(*) AS samples, count(days) AS timed, count(DISTINCT days) AS times,
  count_if("group" = 'control') AS controls, count_if("group" = 'disease') AS cases,
  count(age) AS ages, stddev_pop(age) AS age_spread, count(severity) AS grades, stddev_pop(severity) AS grade_spread FROM design GROUP BY 1),
s AS (SELECT dataset, count_if(n >= 2) AS subtypes FROM (SELECT dataset, subtype, count(*) AS n FROM design
  WHERE subtype <> 'unknown' GROUP BY 1, 2) GROUP BY 1),
modes AS (SELECT dataset, samples, timed, times, controls, cases, coalesce(subtypes, 0) AS subtypes,
  CASE WHEN ages >= 6 THEN 'age' WHEN grades >= 6 THEN 'severity' END AS trait,
  CASE WHEN timed >= 6 AND times >= 3 THEN 'time_series' WHEN controls >= 2 AND cases >= 2 THEN 'case_control'
  WHEN subtypes >= 3 THEN 'subtype_comparison' WHEN ages >= 6 AND age_spread > 1e-9 OR ages < 6 AND grades >= 6 AND grade_spread > 1e-9 THEN 'continuous_trait_association'
  ELSE 'unsupervised_pattern_discovery' END AS mode FROM b LEFT JOIN s USING (dataset))"""

VALUES = """vals AS (SELECT c_nationkey AS dataset, o_custkey AS sample, o_orderpriority || '/' || o_orderstatus AS feature,
  avg(ln(o_totalprice)) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""


def attributes(spark: SparkSession, sf: str) -> DataFrame:
    """(dataset, sample, pos, text); all lines of a customer come from one scan."""
    lines = ", ".join(
        f"named_struct('pos', {i}, 'text', CASE WHEN {when} THEN {text.replace('//', 'div')} END)"
        for i, (when, text) in enumerate(LINES)
    )
    rows = table(spark, sf, "customer").selectExpr(
        "c_nationkey AS dataset", "c_custkey AS sample", f"inline(array({lines}))"
    )
    return rows.filter("text IS NOT NULL")


def design(spark: SparkSession, sf: str) -> DataFrame:
    """Design columns per sample, written once: every signal reads them."""
    items = cut(sample_items(attributes(spark, sf), ["dataset", "sample"]))
    return cut(sample_design(items))


def values(spark: SparkSession, sf: str) -> DataFrame:
    """(dataset, sample, feature, value)."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return (
        table(spark, sf, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("c_nationkey").alias("dataset"), F.col("o_custkey").alias("sample"),
            F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("feature"),
        )
        .agg(F.avg(F.ln("o_totalprice")).alias("value"))
    )
