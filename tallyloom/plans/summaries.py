"""Group summaries, windows, top lists and set operations on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.distributions import t_quantile
from tallyloom.operators import aggregates as agg
from tallyloom.operators import windows as win
from tallyloom.operators.enrichment import running_extreme_scores
from tallyloom.operators.ordering import running, tie_ranks, top_rows
from tallyloom.plans.common import (SCORES, SETS, SYS_SCORES, SYSTEM, hierarchy, measurements, r6,
                                    score_ctes, scores, sets, system_of, system_scores)
from tallyloom.plans.enrichment import BY_FLAG, BY_YEAR
from tallyloom.plans.registry import query
from tallyloom.session import spread, table

#: Words left out of word counts.
STOP_WORDS = ["the", "and", "for", "with", "from", "that", "this", "into", "process", "regulation",
              "positive", "negative", "activity", "pathway", "cell", "cellular"]


def monthly(spark, sf, *by):
    """Log line price per month and further columns of the line or its part."""
    lines = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")
    )
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("t")
    return lines.select(*by, month, F.col("p_type").alias("feature"), F.ln("l_extendedprice").alias("value"))


MONTHLY = """m AS (SELECT l_returnflag, year(l_shipdate) * 12 + month(l_shipdate) AS t, p_type AS feature,
  ln(l_extendedprice) AS value FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("g5_group_profiles", """SELECT c_mktsegment AS segment, o_orderpriority AS priority,
  round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) >= 5""")
def g5_group_profiles(spark, sf):
    rows = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    out = agg.group_profiles(rows, ["segment", "priority"], "o_totalprice", 5)
    return out.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


@query("g6_distribution_statistics", """WITH s AS (SELECT l_returnflag AS flag, l_extendedprice AS v FROM lineitem)
SELECT flag, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, min(v) AS min, max(v) AS max,
  round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS kurtosis,
  round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3,
  round(max(v) - min(v), 4) AS range, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr,
  round(stddev_samp(v) / abs(avg(v)), 6) AS cv FROM s GROUP BY 1""")
def g6_distribution_statistics(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v"))
    out = agg.distribution_statistics(rows, ["flag"], "v")
    four = ["mean", "sd", "q1", "median", "q3", "range", "iqr"]
    return out.withColumns({**{c: F.round(c, 4) for c in four},
                            **{c: F.round(c, 6) for c in ("skewness", "kurtosis", "cv")}})


@query("g7_system_variability", f"""WITH {SYS_SCORES}
SELECT system, round(stddev_samp(score) / abs(avg(score)), 5) AS cv, round(max(score) - min(score), 6) AS range,
  round(stddev_samp(score), 6) AS sd FROM sys GROUP BY 1""")
def g7_system_variability(spark, sf):
    out = agg.variability(system_scores(spark, sf), ["system"], "score")
    return out.select("system", F.round("cv", 5).alias("cv"), r6("range", "range"), r6("sd", "sd"))


@query("g17_contingency", """WITH c AS (SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT segment, status, n, round(100.0 * n / sum(n) OVER (PARTITION BY segment), 6) AS pct_of_parent,
  round(100.0 * n / sum(n) OVER (), 6) AS pct_of_total FROM c""")
def g17_contingency(spark, sf):
    rows = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = agg.shares(rows.select(F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status")),
                     ["segment"], ["status"])
    return out.withColumns({c: F.round(c, 6) for c in ("pct_of_parent", "pct_of_total")})


@query("g18_feature_assignment", """WITH x AS (SELECT o_custkey AS feature, count(DISTINCT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END) AS s FROM orders GROUP BY 1)
SELECT CASE WHEN coalesce(s, 0) = 0 THEN 'unassigned' WHEN s = 1 THEN 'single' ELSE 'multi' END AS assignment,
  count(*) AS n FROM customer LEFT JOIN x ON c_custkey = feature GROUP BY 1""")
def g18_feature_assignment(spark, sf):
    """Customers as features, the priorities of their orders as sets, in two systems."""
    members = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("set_id"), F.col("o_custkey").alias("feature"))
    above = members.select("set_id").distinct().withColumn("system", F.when(F.col("set_id").isin("1-URGENT", "2-HIGH"), "fast").otherwise("slow"))
    features = table(spark, sf, "customer").select(F.col("c_custkey").alias("feature"))
    return agg.assignment_counts(features, members, above)


@query("g19_top_words", f"""WITH w AS (SELECT lang, unnest(regexp_split_to_array(
    regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g'), '\\s+')) AS word FROM documents),
c AS (SELECT lang, word, count(*) AS n FROM w WHERE length(word) >= 4
  AND word NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)}) GROUP BY 1, 2)
SELECT lang, word, n, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM c)
WHERE place <= 15""")
def g19_top_words(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    return agg.top_words(docs, "lang", "text", STOP_WORDS)


@query("g20_leading_system", f"""WITH {SYS_SCORES},
f AS (SELECT sample, system FROM sys QUALIFY row_number() OVER (PARTITION BY sample ORDER BY score DESC, system) = 1)
SELECT system, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM f), 6) AS share FROM f GROUP BY 1""")
def g20_leading_system(spark, sf):
    out = agg.leader_shares(system_scores(spark, sf), ["sample"], "system", "score")
    return out.withColumn("share", F.round("share", 6))


@query("g21_multiplicity", """SELECT features, count(*) AS targets FROM
(SELECT l_partkey, count(DISTINCT l_suppkey) AS features FROM lineitem GROUP BY 1) GROUP BY 1""")
def g21_multiplicity(spark, sf):
    return agg.multiplicity(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query("g22_timepoint_means", f"""WITH {MONTHLY} SELECT t, feature, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS sd, count(*) AS n FROM m GROUP BY 1, 2""")
def g22_timepoint_means(spark, sf):
    out = agg.group_profiles(monthly(spark, sf), ["t", "feature"], "value")
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("g23_trajectory_interval")
def g23_trajectory_interval(spark, sf):
    """Mean with a 95 % t interval per month (no t quantile in SQL)."""
    out = agg.group_profiles(monthly(spark, sf), ["t", "feature"], "value", 2)
    sem = F.col("sd") / F.sqrt("n")
    half = t_quantile(F.lit(0.975), (F.col("n") - 1).cast("double")) * sem
    return out.select("t", "feature", "n", F.round("mean", 6).alias("mean"), F.round(sem, 6).alias("sem"),
                      F.round(F.col("mean") - half, 6).alias("low"), F.round(F.col("mean") + half, 6).alias("high"))


@query("g23_trajectory_sem", f"""WITH {MONTHLY} SELECT t, feature, count(*) AS n,
  round(stddev_samp(value) / sqrt(count(*)), 6) AS sem FROM m GROUP BY 1, 2 HAVING count(*) >= 2""")
def g23_trajectory_sem(spark, sf):
    out = agg.group_profiles(monthly(spark, sf), ["t", "feature"], "value", 2)
    return out.select("t", "feature", "n", F.round(F.col("sd") / F.sqrt("n"), 6).alias("sem"))


@query("g24_pooled_timepoints", f"""WITH {MONTHLY},
d AS (SELECT l_returnflag, t, feature, avg(value) AS x FROM m GROUP BY 1, 2, 3),
p AS (SELECT t, feature, avg(x) AS mean, count(*) AS datasets FROM d GROUP BY 1, 2)
SELECT t, feature, round(mean, 6) AS mean, datasets, rank() OVER (PARTITION BY t ORDER BY mean DESC) AS rank FROM p""")
def g24_pooled_timepoints(spark, sf):
    pooled = agg.pooled_timepoints(monthly(spark, sf, "l_returnflag"), "l_returnflag", "t", "feature", "value")
    out = tie_ranks(pooled, ["t"], "mean", descending=True, method="min")
    return out.select("t", "feature", F.round("mean", 6).alias("mean"), "datasets", "rank")


@query("g25_mean_imputation", """WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(v, avg(v) OVER (PARTITION BY l_partkey)), 6) AS v FROM q""")
def g25_mean_imputation(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("v"))
    return agg.impute_with_mean(rows, ["l_partkey"], "v").withColumn("v", F.round("v", 6))


@query("g26_systems_across_datasets", f"""WITH {score_ctes(BY_FLAG, 'dataset, sample')},
m AS (SELECT dataset, set_id, avg(es) AS x FROM scores GROUP BY 1, 2)
SELECT dataset, {SYSTEM} AS system, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, count(*) AS n
FROM m GROUP BY 1, 2""")
def g26_systems_across_datasets(spark, sf):
    values = measurements(spark, sf, ("l_returnflag",)).withColumnRenamed("l_returnflag", "dataset")
    es = running_extreme_scores(values, sets(spark, sf), ["dataset", "sample"])
    means = es.groupBy("dataset", "set_id").agg(F.avg("es").alias("x"))
    out = agg.group_profiles(means.withColumn("system", system_of()), ["dataset", "system"], "x")
    return out.select("dataset", "system", r6("mean", "mean"), r6("sd", "sd"), "n")


@query("g27_timepoint_rankings", f"""WITH {score_ctes(BY_YEAR, 'day, sample')},
m AS (SELECT day, {SYSTEM} AS system, avg(es) AS mean, stddev_samp(es) AS sd, count(*) AS n FROM scores GROUP BY 1, 2)
SELECT day, system, round(mean, 6) AS mean, round(sd, 6) AS sd, n,
  row_number() OVER (PARTITION BY day ORDER BY mean DESC, system) AS place FROM m QUALIFY place <= 10""")
def g27_timepoint_rankings(spark, sf):
    values = measurements(spark, sf, (F.year("l_shipdate").alias("day"),))
    es = running_extreme_scores(values, sets(spark, sf), ["day", "sample"]).withColumn("system", system_of())
    means = agg.group_profiles(es, ["day", "system"], "es")
    out = top_rows(means, ["day"], [F.col("mean").desc(), F.col("system")], 10)
    return out.select("day", "system", r6("mean", "mean"), r6("sd", "sd"), "n", "place")


@query("w1_average_tie_rank", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS v,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC)
  + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rank FROM lineitem""")
def w1_average_tie_rank(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag",
                                               F.col("l_quantity").alias("v"))
    return tie_ranks(rows, ["l_returnflag"], "v", descending=True).drop("l_returnflag")


@query("w2_rank_within_parent", """WITH m AS (SELECT p_type AS type, p_brand AS brand, avg(p_retailprice) AS m FROM part GROUP BY 1, 2)
SELECT type, brand, round(m, 4) AS m, rank() OVER (PARTITION BY type ORDER BY m DESC) AS within,
  rank() OVER (ORDER BY m DESC) AS overall FROM m""")
def w2_rank_within_parent(spark, sf):
    means = table(spark, sf, "part").groupBy(F.col("p_type").alias("type"), F.col("p_brand").alias("brand")).agg(
        F.avg("p_retailprice").alias("m"))
    inside = tie_ranks(means, ["type"], "m", "within", descending=True, method="min")
    every = tie_ranks(inside.withColumn("_all", F.lit(0)), ["_all"], "m", "overall", descending=True, method="min")
    return every.drop("_all").withColumn("m", F.round("m", 4))


@query("w3_running_extremes", """WITH r AS (SELECT o_custkey, sum(o_totalprice - 250000) OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM orders)
SELECT o_custkey, round(greatest(0, max(s)), 3) AS high, round(least(0, min(s)), 3) AS low FROM r GROUP BY 1""")
def w3_running_extremes(spark, sf):
    rows = table(spark, sf, "orders").withColumn("step", F.col("o_totalprice") - 250000)
    out = win.running_extremes(rows.select("o_custkey", "o_orderdate", "o_orderkey", "step"), ["o_custkey"],
                               [F.col("o_orderdate"), F.col("o_orderkey")], "step")
    return out.select("o_custkey", F.round("high", 3).alias("high"), F.round("low", 3).alias("low"))


@query("w4_largest_step", f"""WITH {MONTHLY}, p AS (SELECT feature, t, avg(value) AS v FROM m GROUP BY 1, 2),
s AS (SELECT *, v - lag(v) OVER (PARTITION BY feature ORDER BY t) AS step FROM p)
SELECT feature, t AS change_point, round(step, 6) AS step FROM s WHERE step IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY feature ORDER BY abs(step) DESC, t) = 1""")
def w4_largest_step(spark, sf):
    points = monthly(spark, sf).groupBy("feature", "t").agg(F.avg("value").alias("v"))
    return win.largest_step(points, ["feature"], "t", "v").withColumn("step", F.round("step", 6))


@query("w6_cumulative_share", """WITH p AS (SELECT l_partkey, sum(l_extendedprice) AS w FROM lineitem GROUP BY 1),
c AS (SELECT l_partkey, w, sum(w) OVER (ORDER BY w DESC, l_partkey) / sum(w) OVER () AS c,
  row_number() OVER (ORDER BY w DESC, l_partkey) AS i FROM p)
SELECT min(CASE WHEN c >= 0.5 THEN i END) AS half, min(CASE WHEN c >= 0.8 THEN i END) AS eighty,
  min(CASE WHEN c >= 0.95 THEN i END) AS ninetyfive FROM c""")
def w6_cumulative_share(spark, sf):
    weights = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("w"))
    placed = win.cumulative_share(weights.withColumn("_all", F.lit(0)), ["_all"],
                                  [F.col("w").desc(), F.col("l_partkey")], "w")
    reach = lambda t: F.min(F.when(F.col("cumulative") >= t, F.col("position")))
    return placed.agg(reach(0.5).alias("half"), reach(0.8).alias("eighty"), reach(0.95).alias("ninetyfive"))


@query("w7_share_of_parent", """WITH c AS (SELECT p_type AS type, p_brand AS brand, count(*) AS n FROM part GROUP BY 1, 2)
SELECT type, brand, n, round(100.0 * n / sum(n) OVER (PARTITION BY type), 6) AS pct_of_parent,
  round(100.0 * n / sum(n) OVER (), 6) AS pct_of_total FROM c""")
def w7_share_of_parent(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))
    out = agg.shares(rows, ["type"], ["brand"])
    return out.withColumns({c: F.round(c, 6) for c in ("pct_of_parent", "pct_of_total")})


@query("o1_mixed_sort", """SELECT c_mktsegment, c_custkey, c_acctbal FROM customer
ORDER BY c_mktsegment, c_acctbal DESC, c_custkey""")
def o1_mixed_sort(spark, sf):
    rows = table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return rows.orderBy(F.col("c_mktsegment").asc(), F.col("c_acctbal").desc(), F.col("c_custkey"))


@query("o2_top_and_bottom", f"""WITH {SCORES}, m AS (SELECT set_id, avg(es) AS v FROM scores GROUP BY 1)
SELECT * FROM (SELECT set_id, round(v, 6) AS v, 'top' AS side, row_number() OVER (ORDER BY v DESC, set_id) AS place FROM m QUALIFY place <= 5)
UNION ALL SELECT * FROM (SELECT set_id, round(v, 6) AS v, 'bottom' AS side, row_number() OVER (ORDER BY v, set_id DESC) AS place FROM m QUALIFY place <= 5)""")
def o2_top_and_bottom(spark, sf):
    means = scores(spark, sf).groupBy("set_id").agg(F.avg("es").alias("v"))
    return win.top_and_bottom(means, "v", "set_id").withColumn("v", F.round("v", 6))


@query("o3_first_per_group", """SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3""")
def o3_first_per_group(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_rows(rows, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@query("o4_natural_order", """WITH l AS (SELECT DISTINCT 'day ' || extract(day FROM ts) AS label FROM events)
SELECT label, row_number() OVER (ORDER BY CAST(regexp_extract(label, '(\\d+)', 1) AS INT), label) AS place FROM l""")
def o4_natural_order(spark, sf):
    labels = table(spark, sf, "events").select(
        F.concat(F.lit("day "), F.dayofmonth("ts").cast("string")).alias("label")).distinct()
    keyed = labels.select("label", win.label_number("label").alias("_n"), F.lit(0).alias("_all"))
    return running(keyed, ["_all"], [F.col("_n"), F.col("label")], position="place").select("label", "place")


@query("o5_seeded_sample", """SELECT p_brand AS set_id, p_partkey AS id FROM part QUALIFY row_number() OVER
  (PARTITION BY p_brand ORDER BY md5(p_partkey || '|42'), p_partkey) <= 20""")
def o5_seeded_sample(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("id"))
    return win.seeded_sample(rows, ["set_id"], "id", 20)


@query("u1_union_of_members", """SELECT DISTINCT p_partkey AS feature FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')
UNION SELECT p_partkey FROM part WHERE p_type = 'SMALL'""")
def u1_union_of_members(spark, sf):
    members = sets(spark, sf)
    brands = members.filter(F.col("set_id").isin("Brand#1", "Brand#2")).select("feature")
    return brands.unionByName(members.filter("set_id = 'Type#SMALL'").select("feature")).distinct()


@query("u2_intersection", """SELECT p_partkey AS feature FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'""")
def u2_intersection(spark, sf):
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("feature"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("feature")).intersect(returned)


@query("u3_difference", "SELECT l_partkey AS part, l_suppkey AS supplier FROM lineitem EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def u3_difference(spark, sf):
    sold = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), "l_returnflag")
    return sold.select("part", "supplier").subtract(sold.filter("l_returnflag = 'R'").select("part", "supplier"))


@query("u4_append_new", """SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' OR o_orderstatus = 'none'""")
def u4_append_new(spark, sf):
    from tallyloom.operators.joins import without
    orders = table(spark, sf, "orders")
    old = orders.filter("o_orderdate < timestamp'1998-01-01'").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    fresh = orders.select(F.col("o_orderkey").alias("id"), F.lit("new").alias("status"))
    return old.unionByName(without(fresh, old, "id"))
