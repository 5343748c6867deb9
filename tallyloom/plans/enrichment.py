"""Enrichment scores and their summaries over the line-item measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import aggregates as agg
from tallyloom.operators import enrichment as en
from tallyloom.operators import joins as jn
from tallyloom.operators.ordering import quantiles
from tallyloom.plans.common import (MEAS, SCORES, SETS, SYS_SCORES, SYSTEM, hierarchy, measurements,
                                    r6, score_ctes, scores, sets, system_of)
from tallyloom.plans.registry import query
from tallyloom.session import table


@query("e1_set_scores", f"WITH {SCORES} SELECT sample, set_id, round(es, 6) AS es FROM scores")
def e1_set_scores(spark, sf):
    es = en.running_extreme_scores(measurements(spark, sf), sets(spark, sf))
    return es.select("sample", "set_id", r6("es", "es"))


@query("e3_rank_percentile", f"""WITH {MEAS}, {SETS},
ranked AS (SELECT *, rank() OVER (PARTITION BY sample ORDER BY value DESC)
    + (count(*) OVER (PARTITION BY sample, value) - 1) / 2.0 AS rk,
    count(*) OVER (PARTITION BY sample) AS n FROM meas),
m AS (SELECT sample, set_id, (max(n) - avg(rk)) / max(n) AS score FROM ranked JOIN sets USING (feature) GROUP BY 1, 2),
grid AS (SELECT * FROM (SELECT DISTINCT sample FROM meas), (SELECT DISTINCT set_id FROM sets))
SELECT sample, set_id, round(coalesce(score, 0.5), 6) AS score FROM grid LEFT JOIN m USING (sample, set_id)""")
def e3_rank_percentile(spark, sf):
    out = en.rank_percentile_scores(measurements(spark, sf), sets(spark, sf), form=1)
    return out.select("sample", "set_id", r6("score", "score"))


@query("e4_rank_percentile_plus_one", f"""WITH {MEAS}, {SETS},
ranked AS (SELECT *, rank() OVER (PARTITION BY sample ORDER BY value DESC)
    + (count(*) OVER (PARTITION BY sample, value) - 1) / 2.0 AS rk,
    count(*) OVER (PARTITION BY sample) AS n FROM meas),
m AS (SELECT sample, set_id, (max(n) - avg(rk) + 1) / max(n) AS score FROM ranked JOIN sets USING (feature) GROUP BY 1, 2),
grid AS (SELECT * FROM (SELECT DISTINCT sample FROM meas), (SELECT DISTINCT set_id FROM sets))
SELECT sample, set_id, round(coalesce(score, 0.0), 6) AS score FROM grid LEFT JOIN m USING (sample, set_id)""")
def e4_rank_percentile_plus_one(spark, sf):
    out = en.rank_percentile_scores(measurements(spark, sf), sets(spark, sf), form=2)
    return out.select("sample", "set_id", r6("score", "score"))


@query("e5_z_scores", f"""WITH {MEAS}, {SETS},
z AS (SELECT *, avg(value) OVER (PARTITION BY sample) AS m, stddev_samp(value) OVER (PARTITION BY sample) AS sd FROM meas),
s AS (SELECT sample, set_id, CASE WHEN max(sd) > 0 THEN avg((value - m) / sd) ELSE 0 END AS score
  FROM z JOIN sets USING (feature) GROUP BY 1, 2),
grid AS (SELECT * FROM (SELECT DISTINCT sample FROM meas), (SELECT DISTINCT set_id FROM sets))
SELECT sample, set_id, round(coalesce(score, 0.0), 6) AS score FROM grid LEFT JOIN s USING (sample, set_id)""")
def e5_z_scores(spark, sf):
    out = en.z_scores(measurements(spark, sf), sets(spark, sf))
    return out.select("sample", "set_id", r6("score", "score"))


@query("e6_mean_value_scores", f"""WITH {MEAS}, {SETS}
SELECT sample, set_id, round(avg(log2(value)), 6) AS score FROM meas JOIN sets USING (feature) GROUP BY 1, 2""")
def e6_mean_value_scores(spark, sf):
    values = measurements(spark, sf).withColumn("value", F.log2("value"))
    out = en.mean_value_scores(values, sets(spark, sf))
    return out.select("sample", "set_id", r6("score", "score"))


@query("e7_rank_area_scores", f"""WITH {MEAS}, {SETS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value DESC, feature) AS r,
    rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2.0 AS low,
    count(*) OVER (PARTITION BY sample) AS n FROM meas),
hits AS (SELECT *, pow(10000.0 * low / n, 0.25) AS w FROM ranked JOIN sets USING (feature)),
found AS (SELECT sample, set_id, sum(w * (n - r + 1)) / sum(w)
    - CASE WHEN max(n) > count(*) THEN (max(n) * (max(n) + 1) / 2.0 - sum(n - r + 1)) / (max(n) - count(*)) ELSE 0 END AS es
  FROM hits GROUP BY 1, 2),
es AS (SELECT sample, set_id, coalesce(es, 0) AS es FROM (SELECT DISTINCT sample FROM meas) CROSS JOIN (SELECT DISTINCT set_id FROM sets) LEFT JOIN found USING (sample, set_id))
SELECT sample, set_id, round(es, 5) AS es, round(es / (SELECT max(es) - min(es) FROM es), 6) AS nes FROM es""")
def e7_rank_area_scores(spark, sf):
    out = en.rank_area_scores(measurements(spark, sf), sets(spark, sf))
    return out.select("sample", "set_id", F.round("es", 5).alias("es"), r6("nes", "nes"))


BY_FLAG = """meas AS (SELECT l_returnflag AS dataset, l_suppkey AS sample, l_partkey AS feature,
  avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3)"""


@query("e8_scores_of_all_datasets", f"""WITH {score_ctes(BY_FLAG, 'dataset, sample')}
SELECT dataset, sample, set_id, round(es, 6) AS es FROM scores""")
def e8_scores_of_all_datasets(spark, sf):
    values = measurements(spark, sf, ("l_returnflag",)).withColumnRenamed("l_returnflag", "dataset")
    es = en.running_extreme_scores(values, sets(spark, sf), ["dataset", "sample"])
    return es.select("dataset", "sample", "set_id", r6("es", "es"))


BY_YEAR = """meas AS (SELECT year(l_shipdate) AS day, l_suppkey AS sample, l_partkey AS feature,
  avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3)"""


@query("e9_scores_by_timepoint", f"""WITH {score_ctes(BY_YEAR, 'day, sample')}
SELECT day, set_id, count(*) AS n, round(avg(es), 6) AS mean_es FROM scores GROUP BY 1, 2""")
def e9_scores_by_timepoint(spark, sf):
    values = measurements(spark, sf, (F.year("l_shipdate").alias("day"),))
    es = en.running_extreme_scores(values, sets(spark, sf), ["day", "sample"])
    return es.groupBy("day", "set_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("es"), "mean_es")
    )


@query("e11_matched_features", f"""WITH {MEAS}, {SETS}
SELECT count(*) AS matched FROM sets WHERE feature IN (SELECT feature FROM meas)""")
def e11_matched_features(spark, sf):
    cover = jn.set_coverage(sets(spark, sf), measurements(spark, sf))
    en.require_matches(cover)
    return cover.agg(F.sum("matched").alias("matched"))


SUMMARY = f"""WITH {SCORES},
cov AS (SELECT set_id, count(*) AS members, count(m.feature) AS matched
  FROM sets LEFT JOIN (SELECT DISTINCT feature FROM meas) m USING (feature) GROUP BY 1)"""


@query("g1_set_summary", SUMMARY + """
SELECT set_id, round(avg(es), 6) AS mean_es, round(stddev_pop(es), 6) AS std_es,
  round(quantile_cont(es, 0.5), 6) AS median_es, max(members) AS members, max(matched) AS matched
FROM scores JOIN cov USING (set_id) GROUP BY 1""")
def g1_set_summary(spark, sf):
    values = measurements(spark, sf)
    es = scores(spark, sf, values)
    cover = jn.set_coverage(sets(spark, sf), values)
    out = agg.set_summary(es, cover)
    return out.select("set_id", r6("mean", "mean_es"), r6("std", "std_es"),
                      r6("median", "median_es"), "members", "matched")


@query("g2_set_summary_with_range", SUMMARY + """
SELECT set_id, round(avg(es), 6) AS mean_es, round(min(es), 6) AS min_es, round(max(es), 6) AS max_es,
  round(100.0 * max(matched) / max(members), 6) AS overlap_pct
FROM scores JOIN cov USING (set_id) GROUP BY 1""")
def g2_set_summary_with_range(spark, sf):
    values = measurements(spark, sf)
    es = scores(spark, sf, values)
    cover = jn.set_coverage(sets(spark, sf), values)
    out = agg.set_summary(es, cover)
    return out.select("set_id", r6("mean", "mean_es"), r6("min", "min_es"), r6("max", "max_es"),
                      r6(F.col("coverage") * 100, "overlap_pct"))


@query("g3_system_means", f"""WITH {SCORES}, m AS (SELECT set_id, avg(es) AS me FROM scores GROUP BY 1)
SELECT {SYSTEM} AS system, round(avg(me), 6) AS score, count(*) AS sets FROM m GROUP BY 1""")
def g3_system_means(spark, sf):
    out = agg.system_means(scores(spark, sf), hierarchy(spark, sf))
    return out.select("system", r6("score", "score"), "sets")


@query("g4_sample_system_scores", f"""WITH {SYS_SCORES}
SELECT sample, system, round(score, 6) AS score FROM sys""")
def g4_sample_system_scores(spark, sf):
    out = agg.sample_system_scores(scores(spark, sf), hierarchy(spark, sf))
    return out.select("sample", "system", r6("score", "score"))


@query("j4_set_coverage", f"""WITH {SETS}
SELECT set_id, count(*) AS members, count(m.feature) AS matched, round(count(m.feature) * 1.0 / count(*), 6) AS coverage
FROM sets LEFT JOIN (SELECT DISTINCT l_partkey AS feature FROM lineitem) m USING (feature) GROUP BY 1""")
def j4_set_coverage(spark, sf):
    measured = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("feature"))
    return jn.set_coverage(sets(spark, sf), measured).withColumn("coverage", F.round("coverage", 6))


@query("j4_classified_features", """WITH c AS (SELECT DISTINCT l_partkey AS f FROM lineitem WHERE l_returnflag <> 'R')
SELECT count(*) AS measured, count(c.f) AS classified, count(*) - count(c.f) AS unclassified,
  round(count(c.f) * 1.0 / count(*), 6) AS coverage FROM part LEFT JOIN c ON p_partkey = f""")
def j4_classified_features(spark, sf):
    """All parts, against the sets of those that were sold and kept, by supplier."""
    measured = table(spark, sf, "part").select(F.col("p_partkey").alias("feature"))
    members = table(spark, sf, "lineitem").filter("l_returnflag <> 'R'").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("feature"))
    return jn.covered_features(members, measured).withColumn("coverage", F.round("coverage", 6))


@query("e10_score_agreement", f"""WITH {SCORES},
o AS (SELECT a.set_id AS known, b.set_id AS tested, count(*) AS overlap FROM sets a JOIN sets b USING (feature)
  WHERE starts_with(a.set_id, 'Brand#') AND starts_with(b.set_id, 'Type#') GROUP BY 1, 2),
n AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1),
j AS (SELECT known, tested, overlap, overlap * 1.0 / (a.n + b.n - overlap) AS jaccard
  FROM o JOIN n a ON a.set_id = known JOIN n b ON b.set_id = tested)
SELECT known, tested, max(overlap) AS overlap, round(max(jaccard), 6) AS jaccard, round(corr(x.es, y.es), 6) AS correlation
FROM j JOIN scores x ON x.set_id = known JOIN scores y ON y.set_id = tested AND y.sample = x.sample
WHERE jaccard > 0.02 GROUP BY 1, 2""")
def e10_score_agreement(spark, sf):
    members = sets(spark, sf)
    es = scores(spark, sf)
    known, tested = F.col("set_id").startswith("Brand#"), F.col("set_id").startswith("Type#")
    out = agg.score_agreement(es.filter(known), es.filter(tested), members.filter(known),
                              members.filter(tested), least_jaccard=0.02)
    return out.select("known", "tested", "overlap", r6("jaccard", "jaccard"),
                      r6("correlation", "correlation"))


@query("e12_measured_features", f"""WITH {MEAS} SELECT count(DISTINCT feature) AS features FROM meas""")
def e12_measured_features(spark, sf):
    """The guard counts the features and stops where there are none, or too few of a probe-like kind."""
    rows = measurements(spark, sf)
    n = en.require_features(rows, 0.0)
    return rows.limit(1).select(F.lit(n).cast("long").alias("features"))
