"""Design inference and the statistics of each design."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import labels
from tallyloom.functions.distributions import t_quantile
from tallyloom.operators import correlation as co
from tallyloom.operators import design as dz
from tallyloom.operators import statistics as st
from tallyloom.operators import windows as win
from tallyloom.operators.aggregates import group_profiles
from tallyloom.operators.joins import baseline_deltas, phase_pairs
from tallyloom.operators.ordering import running, top_rows
from tallyloom.plans.common import MEAS, ROUND, SYS_SCORES, measurements, r6, system_scores
from tallyloom.plans.registry import query
from tallyloom.plans.studies import DESIGN, MODES, VALUES, design, values
from tallyloom.plans.summaries import MONTHLY, monthly
from tallyloom.session import table

KEYS = ["dataset", "feature"]
ROWS = DESIGN + f', {VALUES}, rows AS (SELECT * FROM vals JOIN design USING (dataset, sample))'

#: two-sided normal tail in SQL: a published rational approximation, good to 1e-7
TAIL = """((0.254829592 * {t} - 0.284496736 * {t}*{t} + 1.421413741 * {t}*{t}*{t} - 1.453152027 * {t}*{t}*{t}*{t}
 + 1.061405429 * {t}*{t}*{t}*{t}*{t}) * exp(-({z}) * ({z}) / 2))"""


def tail_sql(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * ({z}) / sqrt(2)))"
    return TAIL.replace("{t}", t).replace("{z}", z)


#: two-sided p of Student's t for whole degrees of freedom, by its finite series in the angle atan(t / sqrt(df))
T_SERIES = """CASE WHEN {df} % 2 = 1 THEN 1 - 2 / pi() * ({a} + CASE WHEN {df} = 1 THEN 0 ELSE sin({a}) * {sum} END) ELSE 1 - sin({a}) * {sum} END"""


def t_tail_sql(t: str, df: str) -> str:
    angle = f"atan(abs({t}) / sqrt({df}))"
    # terms cos, cos^3 2/3, cos^5 2*4/(3*5) .. for odd, 1, cos^2 1/2, cos^4 1*3/(2*4) .. for even degrees
    product = "list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(1, j + 1), lambda q: CASE WHEN {df} % 2 = 1 THEN 2.0 * q / (2 * q + 1) ELSE (2.0 * q - 1) / (2 * q) END)), lambda u, v: u * v)"
    terms = ("list_sum(list_transform(range(0, CAST(({df} - CASE WHEN {df} % 2 = 1 THEN 1 ELSE 0 END) // 2 AS BIGINT)), lambda j: " + product
             + " * power(cos({a}), 2 * j + CASE WHEN {df} % 2 = 1 THEN 1 ELSE 0 END)))")
    return T_SERIES.replace("{sum}", terms).replace("{a}", angle).replace("{df}", df)


def rows(spark, sf):
    return values(spark, sf).join(design(spark, sf), ["dataset", "sample"])


def rounded(df, *columns, digits=ROUND):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("t1_study_design", f"WITH {DESIGN}, {MODES} SELECT dataset, samples, timed, times, controls, cases, subtypes, mode FROM modes")
def t1_study_design(spark, sf):
    out = dz.infer_design(design(spark, sf))
    return out.select("dataset", "samples", "timed", "times", "controls", "cases", "subtypes", "mode")


TWO = ROWS + """,
m AS (SELECT dataset, feature, count(CASE WHEN "group" = 'disease' THEN value END) AS n_a, count(CASE WHEN "group" = 'control' THEN value END) AS n_b,
  avg(CASE WHEN "group" = 'disease' THEN value END) AS mean_a, avg(CASE WHEN "group" = 'control' THEN value END) AS mean_b,
  var_samp(CASE WHEN "group" = 'disease' THEN value END) AS var_a, var_samp(CASE WHEN "group" = 'control' THEN value END) AS var_b
  FROM rows GROUP BY 1, 2),
e AS (SELECT *, sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) AS sd, mean_a - mean_b AS diff,
  sqrt(var_a / n_a + var_b / n_b) AS se FROM m WHERE n_a >= 2 AND n_b >= 2)"""


def two_groups(spark, sf):
    return st.enough(st.two_group_moments(rows(spark, sf), KEYS, "group", "disease", "control"))


@query("t2_case_control", f"""WITH {TWO} SELECT dataset, feature, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
  round(diff, 6) AS mean_diff, round((mean_a + 1e-6) / (mean_b + 1e-6), 6) AS fold_change, round(diff / sd, 6) AS effect_size FROM e""")
def t2_case_control(spark, sf):
    out = st.case_control(two_groups(spark, sf))
    return rounded(out, "mean_a", "mean_b", "mean_diff", "fold_change", "effect_size").select(
        *KEYS, "n_a", "n_b", "mean_a", "mean_b", "mean_diff", "fold_change", "effect_size")


@query("t2_top_and_bottom_differences", f"""WITH {TWO} SELECT dataset, feature, round(diff, 6) AS mean_diff, 'up' AS side,
  row_number() OVER (PARTITION BY dataset ORDER BY diff DESC, feature) AS place FROM e QUALIFY place <= 5
UNION ALL SELECT dataset, feature, round(diff, 6), 'down', row_number() OVER (PARTITION BY dataset ORDER BY diff, feature DESC) AS place FROM e QUALIFY place <= 5""")
def t2_top_and_bottom_differences(spark, sf):
    out = st.case_control(two_groups(spark, sf)).select(*KEYS, "mean_diff")
    up = top_rows(out, ["dataset"], [F.col("mean_diff").desc(), F.col("feature")], 5)
    down = top_rows(out, ["dataset"], [F.col("mean_diff"), F.col("feature").desc()], 5)
    return rounded(up.withColumn("side", F.lit("up")).unionByName(down.withColumn("side", F.lit("down"))), "mean_diff")


@query("t3_welch_p_values", f"WITH {TWO} SELECT dataset, feature, round({tail_sql('abs(diff) / se')}, 4) AS p_value FROM e")
def t3_welch_p_values(spark, sf):
    return st.case_control(two_groups(spark, sf)).select(*KEYS, F.round("p_value", 4).alias("p_value"))


@query("t4_pooled_t", f"""WITH {TWO} SELECT dataset, feature, n_a + n_b - 2 AS df, round(diff / (sd * sqrt(1.0 / n_a + 1.0 / n_b)), 6) AS t,
  round(diff / sd, 6) AS d FROM e""")
def t4_pooled_t(spark, sf):
    return rounded(st.pooled_t(two_groups(spark, sf)), "t", "d").select(*KEYS, "df", "t", "d")


@query("t4_mean_variance_d", f"WITH {TWO} SELECT dataset, feature, round(diff / sqrt((var_a + var_b) / 2), 6) AS d FROM e")
def t4_mean_variance_d(spark, sf):
    return rounded(st.pooled_t(two_groups(spark, sf), d_by="mean"), "d").select(*KEYS, "d")


@query("t4_pooled_t_p_values", f"""WITH {TWO}, t AS (SELECT dataset, feature, n_a + n_b - 2 AS df, diff / (sd * sqrt(1.0 / n_a + 1.0 / n_b)) AS t, diff / sd AS d FROM e),
p AS (SELECT *, round({t_tail_sql('t', 'df')}, 6) + 0 AS p FROM t)
SELECT dataset, feature, p AS p_value, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars,
  CASE WHEN abs(d) >= 0.8 THEN 'Large' WHEN abs(d) >= 0.5 THEN 'Medium' WHEN abs(d) >= 0.2 THEN 'Small' ELSE 'Negligible' END AS effect FROM p""")
def t4_pooled_t_p_values(spark, sf):
    out = st.pooled_t(two_groups(spark, sf))
    return rounded(out, "p_value").select(*KEYS, "p_value", labels.stars(F.col("p_value")).alias("stars"),
                                          labels.effect_word(F.col("d")).alias("effect"))


@query("t5_fold_change", f"""WITH {TWO} SELECT dataset, feature, CASE WHEN mean_a > 0 AND mean_b > 0 THEN round(log2(mean_a / mean_b), 6) END AS log2_fold_change,
  round(diff / sd, 6) AS d FROM e""")
def t5_fold_change(spark, sf):
    return rounded(st.disease_control(two_groups(spark, sf)), "log2_fold_change", "d").select(*KEYS, "log2_fold_change", "d")


@query("t6_difference_interval", f"""WITH {TWO}, i AS (SELECT *, sd * sqrt(1.0 / n_a + 1.0 / n_b) AS s FROM e)
SELECT dataset, feature, round(diff, 6) AS mean_diff, round(diff - 1.96 * s, 6) AS low, round(diff + 1.96 * s, 6) AS high FROM i""")
def t6_difference_interval(spark, sf):
    return rounded(st.mean_difference_interval(two_groups(spark, sf)), "mean_diff", "low", "high").select(
        *KEYS, "mean_diff", "low", "high")


@query("t6_difference_t_interval")
def t6_difference_t_interval(spark, sf):
    """Interval with the t quantile of the pooled degrees of freedom."""
    q = t_quantile(F.lit(0.975), F.col("n_a") + F.col("n_b") - 2)
    return rounded(st.mean_difference_interval(two_groups(spark, sf), q), "low", "high").select(*KEYS, "low", "high")


@query("t7_one_way_anova", f"""WITH {ROWS}, g AS (SELECT feature, response, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM rows GROUP BY 1, 2),
o AS (SELECT feature, sum(n * m) / sum(n) AS grand FROM g GROUP BY 1),
p AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(n * (m - grand) * (m - grand)) AS ssb, sum((n - 1) * coalesce(v, 0)) AS ssw FROM g JOIN o USING (feature) GROUP BY 1)
SELECT feature, k AS groups, CAST(n AS BIGINT) AS n, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f, round(ssb / (ssb + ssw), 6) AS eta2 FROM p""")
def t7_one_way_anova(spark, sf):
    out = st.anova(st.group_moments(rows(spark, sf), ["feature"], "response"), ["feature"])
    return rounded(out, "f", "eta2").select("feature", "groups", "n", "f", "eta2")


@query("t7_anova_p_values", f"""WITH {ROWS}, g AS (SELECT feature, response, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM rows GROUP BY 1, 2),
o AS (SELECT feature, sum(n * m) / sum(n) AS grand FROM g GROUP BY 1),
p AS (SELECT feature, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * (m - grand) * (m - grand)) AS ssb, sum((n - 1) * coalesce(v, 0)) AS ssw FROM g JOIN o USING (feature) GROUP BY 1),
f AS (SELECT feature, k - 1 AS df1, n - k AS df2, (ssb / (k - 1)) / (ssw / (n - k)) AS f, ssb / (ssb + ssw) AS eta2 FROM p)
SELECT feature, df1, df2, round(CASE df1 WHEN 2 THEN power(1 + 2 * f / df2, -df2 / 2.0) WHEN 1 THEN {t_tail_sql('sqrt(f)', 'df2')} END, 6) + 0 AS p_value,
  CASE WHEN eta2 >= 0.14 THEN 'Large' WHEN eta2 >= 0.06 THEN 'Medium' ELSE 'Small' END AS size FROM f""")
def t7_anova_p_values(spark, sf):
    out = st.anova(st.group_moments(rows(spark, sf), ["feature"], "response"), ["feature"])
    return rounded(out, "p_value").select("feature", "df1", "df2", "p_value", labels.eta_word(F.col("eta2")).alias("size"))


RANKS = """r AS (SELECT p_type AS feature, l_returnflag AS g, l_quantity AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R')),
k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rk FROM r),
u AS (SELECT feature, count_if(g = 'A') AS n_a, count_if(g = 'R') AS n_b,
  sum(CASE WHEN g = 'A' THEN rk END) - count_if(g = 'A') * (count_if(g = 'A') + 1) / 2.0 AS u FROM k GROUP BY 1),
t AS (SELECT feature, sum(c * c * c - c) AS t FROM (SELECT feature, v, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT *, n_a * n_b AS p, n_a + n_b AS n FROM u JOIN t USING (feature)),
y AS (SELECT *, greatest(abs(u - p / 2.0) - 0.5, 0) / sqrt(p / 12.0 * (n + 1 - t / (n * (n - 1)))) AS z FROM z)"""


def ranked_lines(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("p_type").alias("feature"), F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("value"))


@query("t8_rank_sum_test", f"WITH {RANKS} SELECT feature, u, round(z, 6) AS z, round({tail_sql('z')}, 4) AS p_value FROM y")
def t8_rank_sum_test(spark, sf):
    out = st.rank_sum(ranked_lines(spark, sf), ["feature"], "g", "A", "R")
    return out.select("feature", "u", F.round("z", 6).alias("z"), F.round("p_value", 4).alias("p_value"))


@query("t15_area_under_roc", f"WITH {RANKS} SELECT feature, n_a, n_b, round(u / p, 6) AS auc FROM y")
def t15_area_under_roc(spark, sf):
    return rounded(st.rank_sum(ranked_lines(spark, sf), ["feature"], "g", "A", "R"), "auc").select("feature", "n_a", "n_b", "auc")


@query("t9_chi_square", f"""WITH {DESIGN}, c AS (SELECT response, severity, count(*) AS o FROM design WHERE severity IS NOT NULL GROUP BY 1, 2),
f AS (SELECT *, sum(o) OVER (PARTITION BY response) AS r, sum(o) OVER (PARTITION BY severity) AS c, sum(o) OVER () AS n FROM c)
SELECT CAST(max(n) AS BIGINT) AS n, (count(DISTINCT response) - 1) * (count(DISTINCT severity) - 1) AS df,
  round(max(n) * (sum(o * o * 1.0 / (r * c)) - 1), 6) AS chi2 FROM f""")
def t9_chi_square(spark, sf):
    known = design(spark, sf).filter("severity IS NOT NULL").withColumn("_all", F.lit(0))
    return rounded(st.chi_square(known, ["_all"], "response", "severity"), "chi2").select("n", "df", "chi2")


@query("t9_chi_square_two_by_two", """WITH q AS (SELECT p_type AS feature, l_quantity > 25 AS big, l_discount > 0.05 AS cheap
  FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT feature, CAST(count_if(big AND cheap) AS DOUBLE) AS a, CAST(count_if(big AND NOT cheap) AS DOUBLE) AS b,
  CAST(count_if(NOT big AND cheap) AS DOUBLE) AS c, CAST(count_if(NOT big AND NOT cheap) AS DOUBLE) AS d FROM q GROUP BY 1)
SELECT feature, CAST(a + b + c + d AS BIGINT) AS n, 1 AS df, round(pow(greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0), 2) * (a + b + c + d)
  / ((a + b) * (c + d) * (a + c) * (b + d)), 6) AS chi2 FROM c""")
def t9_chi_square_two_by_two(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    marked = lines.select(F.col("p_type").alias("feature"), (F.col("l_quantity") > 25).alias("big"),
                          (F.col("l_discount") > 0.05).alias("cheap"))
    return rounded(st.chi_square(marked, ["feature"], "big", "cheap"), "chi2").select("feature", "n", "df", "chi2")


@query("t10_one_sample_t", f"""WITH {SYS_SCORES} SELECT system, count(*) AS n, round(avg(score) / (stddev_samp(score) / sqrt(count(*))), 5) AS t
FROM sys GROUP BY 1 HAVING count(*) >= 2""")
def t10_one_sample_t(spark, sf):
    out = st.one_sample_t(system_scores(spark, sf), ["system"], "score")
    return out.select("system", "n", F.round("t", 5).alias("t"))


PAIRS = ROWS + """,
pp AS (SELECT dataset, pair, feature, max_by(value, sample) FILTER (phase = 'pre') AS pre, max_by(value, sample) FILTER (phase = 'post') AS post
  FROM rows WHERE pair IS NOT NULL GROUP BY 1, 2, 3),
dl AS (SELECT dataset, pair, feature, post - pre AS delta FROM pp WHERE pre IS NOT NULL AND post IS NOT NULL)"""


def paired(spark, sf):
    base = rows(spark, sf).filter("pair IS NOT NULL").withColumn("_pair", F.struct("dataset", "pair"))
    return phase_pairs(base, "_pair", "phase", [F.col("sample")], "feature", "value").select(
        "_pair.dataset", "_pair.pair", "feature", "delta")


@query("j10_phase_pairs", f"WITH {PAIRS} SELECT dataset, pair, feature, round(delta, 6) AS delta FROM dl")
def j10_phase_pairs(spark, sf):
    return rounded(paired(spark, sf), "delta")


@query("t11_paired_t", f"""WITH {PAIRS} SELECT feature, count(*) AS n, round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 5) AS t,
  round(avg(delta) / stddev_samp(delta), 6) AS d FROM dl GROUP BY 1 HAVING count(*) >= 2""")
def t11_paired_t(spark, sf):
    out = st.one_sample_t(paired(spark, sf), ["feature"], "delta")
    return out.select("feature", "n", F.round("t", 5).alias("t"), r6("d", "d"))


@query("t28_paired_change", f"""WITH {PAIRS} SELECT dataset, feature, count(*) AS pairs, round(avg(delta), 6) AS mean_delta,
  round(coalesce(stddev_samp(delta), 0), 6) AS sd_delta FROM dl GROUP BY 1, 2 HAVING count(*) >= 2""")
def t28_paired_change(spark, sf):
    return rounded(st.paired_change(paired(spark, sf), KEYS), "mean_delta", "sd_delta")


@query("j9_baseline_deltas", f"""WITH o AS (SELECT o_custkey AS subject, o_orderpriority AS feature, o_orderkey AS t, ln(o_totalprice) AS v, o_orderdate AS d FROM orders),
b AS (SELECT subject, feature, t AS bt, v AS bv FROM o QUALIFY row_number() OVER (PARTITION BY subject, feature ORDER BY d, t) = 1)
SELECT subject, feature, t, bt AS baseline_time, round(v - bv, 6) AS delta FROM o JOIN b USING (subject, feature) WHERE t <> bt""")
def j9_baseline_deltas(spark, sf):
    base = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("feature"), F.col("o_orderkey").alias("t"),
        F.ln("o_totalprice").alias("v"), F.col("o_orderdate").alias("d"))
    return rounded(baseline_deltas(base, "subject", "t", [F.col("d"), F.col("t")], "feature", "v"), "delta")


@query("t12_time_series", f"""WITH {ROWS}, s AS (SELECT dataset, min(days) AS lo, max(days) AS hi FROM rows WHERE days IS NOT NULL GROUP BY 1)
SELECT dataset, feature, round(regr_slope(value, days), 6) AS slope,
  CASE WHEN regr_slope(value, days) > 0 THEN 'up' WHEN regr_slope(value, days) < 0 THEN 'down' ELSE 'flat' END AS direction,
  arg_min(days, struct_pack(a := -value, b := sample)) AS peak_time,
  round(coalesce(avg(CASE WHEN days = hi THEN value END), 0) - coalesce(avg(CASE WHEN days = lo THEN value END), 0), 6) AS shift
FROM rows JOIN s USING (dataset) WHERE days IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3""")
def t12_time_series(spark, sf):
    out = st.time_summary(rows(spark, sf), KEYS, ["dataset"]).filter("n >= 3")
    return rounded(out, "slope", "shift").select(*KEYS, "slope", "direction", "peak_time", "shift")


POINTS = f"""{MONTHLY}, pt AS (SELECT feature, t, avg(value) AS mean, row_number() OVER (PARTITION BY feature ORDER BY t) - 1 AS i FROM m GROUP BY 1, 2),
sp AS (SELECT *, mean - lag(mean) OVER (PARTITION BY feature ORDER BY t) AS step FROM pt)"""


@query("t13_trend", f"""WITH {POINTS}, c AS (SELECT feature, t AS change_point, step FROM sp WHERE step IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY feature ORDER BY abs(step) DESC, i) = 1)
SELECT feature, count(*) AS times, round(corr(i, mean), 6) AS r, round(max(mean) - min(mean), 6) AS range,
  round(stddev_pop(mean) / avg(mean), 6) AS cv, max(c.change_point) AS change_point, round(max(c.step), 6) AS change
FROM sp JOIN c USING (feature) GROUP BY 1""")
def t13_trend(spark, sf):
    out = st.trend(st.time_points(monthly(spark, sf), ["feature"], "t"), ["feature"], "t")
    return rounded(out, "r", "range", "cv", "change").select("feature", "times", "r", "range", "cv", "change_point", "change")


@query("t13_trend_classes", f"""WITH {POINTS}, c AS (SELECT feature, count(*) AS n, corr(i, mean) AS r FROM pt GROUP BY 1), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df FROM c),
p AS (SELECT *, {t_tail_sql('t', 'df')} AS p FROM t)
SELECT feature, CASE WHEN r > 0.3 AND p < 0.05 THEN 'increasing' WHEN r < -0.3 AND p < 0.05 THEN 'decreasing' ELSE 'stable' END AS trend, round(p, 6) + 0 AS p_value FROM p""")
def t13_trend_classes(spark, sf):
    out = st.trend(st.time_points(monthly(spark, sf), ["feature"], "t"), ["feature"], "t")
    return rounded(out, "p_value").select("feature", "trend", "p_value")


@query("t14_mann_kendall", f"""WITH {POINTS}, k AS (SELECT a.feature, max(n.n) AS n, sum(sign(b.mean - a.mean)) AS s FROM pt a JOIN pt b ON a.feature = b.feature AND a.i < b.i
  JOIN (SELECT feature, count(*) AS n FROM pt GROUP BY 1) n ON n.feature = a.feature GROUP BY 1),
z AS (SELECT *, CASE WHEN s > 0 THEN (s - 1) WHEN s < 0 THEN (s + 1) ELSE 0 END / sqrt(n * (n - 1) * (2 * n + 5) / 18) AS z FROM k)
SELECT feature, n, CAST(s AS DOUBLE) AS s, round(z, 6) AS z, round({tail_sql('abs(z)')}, 4) AS p_value FROM z""")
def t14_mann_kendall(spark, sf):
    out = st.mann_kendall(st.time_points(monthly(spark, sf), ["feature"], "t"), ["feature"])
    return out.select("feature", F.col("n").cast("long").alias("n"), "s", r6("z", "z"), F.round("p_value", 4).alias("p_value"))


DAILY = """pt AS (SELECT l_returnflag AS feature, epoch(l_shipdate) // 86400 AS i, round(avg(l_quantity)) AS mean FROM lineitem GROUP BY 1, 2)"""


@query("t14_tied_series", f"""WITH {DAILY}, k AS (SELECT a.feature, sum(sign(b.mean - a.mean)) AS s FROM pt a JOIN pt b ON a.feature = b.feature AND a.i < b.i GROUP BY 1),
c AS (SELECT feature, mean, CAST(count(*) AS DOUBLE) AS c FROM pt GROUP BY 1, 2), n AS (SELECT feature, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS t FROM c GROUP BY 1),
z AS (SELECT feature, n, s, CASE WHEN s > 0 THEN (s - 1) WHEN s < 0 THEN (s + 1) ELSE 0 END / sqrt((n * (n - 1) * (2 * n + 5) - t) / 18) AS z FROM k JOIN n USING (feature))
SELECT feature, CAST(n AS BIGINT) AS n, CAST(s AS DOUBLE) AS s, round(z, 6) AS z, round({tail_sql('abs(z)')}, 4) AS p_value FROM z""")
def t14_tied_series(spark, sf):
    """Daily means in whole units: thousands of times, most values tied; cut into slices of 512."""
    daily = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("feature"), F.unix_date(F.to_date("l_shipdate")).alias("i")).agg(
        F.round(F.avg("l_quantity")).alias("mean"))
    out = st.mann_kendall(daily, ["feature"], ties=True, slice_rows=512)
    return out.select("feature", "n", "s", r6("z", "z"), F.round("p_value", 4).alias("p_value"))


SUB = ROWS + """,
g AS (SELECT dataset, feature, subtype, count(*) AS n, avg(value) AS mean FROM rows WHERE subtype <> 'unknown' GROUP BY 1, 2, 3 HAVING count(*) >= 2),
w AS (SELECT *, max(mean) OVER k - min(mean) OVER k AS spread, count(*) OVER k AS groups,
  CASE WHEN count(*) OVER k > 1 THEN mean - (sum(mean) OVER k - mean) / (count(*) OVER k - 1) ELSE mean END AS signature
  FROM g WINDOW k AS (PARTITION BY dataset, feature))"""


@query("t16_subtype_comparison", f"""WITH {SUB} SELECT dataset, feature, subtype, n, groups, round(mean, 6) AS mean, round(spread, 6) AS spread,
  round(signature, 6) AS signature FROM w""")
def t16_subtype_comparison(spark, sf):
    out = st.subtype_comparison(rows(spark, sf), KEYS, "subtype")
    return rounded(out, "mean", "spread", "signature").select(*KEYS, "subtype", "n", "groups", "mean", "spread", "signature")


@query("t16_subtype_signatures", f"""WITH {SUB} SELECT dataset, subtype, feature, row_number() OVER (PARTITION BY dataset, subtype
  ORDER BY signature DESC, feature) AS place FROM w QUALIFY place <= 3""")
def t16_subtype_signatures(spark, sf):
    out = st.subtype_comparison(rows(spark, sf), KEYS, "subtype")
    return top_rows(out.select("dataset", "subtype", "feature", "signature"), ["dataset", "subtype"],
                    [F.col("signature").desc(), F.col("feature")], 3).drop("signature")


@query("t17_trait_association", f"""WITH {ROWS}, x AS (SELECT *, coalesce(age, severity) AS trait FROM rows WHERE coalesce(age, severity) IS NOT NULL)
SELECT dataset, feature, count(*) AS n, CASE WHEN stddev_pop(value) > 1e-9 THEN round(corr(trait, value), 6) ELSE 0 END AS r
FROM x GROUP BY 1, 2 HAVING count(*) >= 6 AND stddev_pop(trait) > 1e-9""")
def t17_trait_association(spark, sf):
    samples = design(spark, sf)
    chosen = dz.chosen_trait(samples).select("dataset", "trait")
    trait = dz.trait_values(samples).join(chosen, ["dataset", "trait"]).select(
        "dataset", "sample", F.col("value").alias("trait_value"))
    joined = values(spark, sf).join(trait, ["dataset", "sample"])
    return rounded(st.trait_association(joined, KEYS, "trait_value"), "r").select(*KEYS, "n", "r")


@query("t18_correlation_with_size", """WITH x AS (SELECT p_brand AS feature, p_size AS s, ln(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT feature, count(*) AS n, round(corr(s, v), 6) AS r, round(corr(s, v) * corr(s, v), 6) AS r2 FROM x GROUP BY 1""")
def t18_correlation_with_size(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = lines.select(F.col("p_brand").alias("feature"), F.col("p_size").cast("double").alias("s"), F.ln("l_extendedprice").alias("value"))
    return rounded(st.trait_association(x, ["feature"], "s"), "r", "r2")


@query("t18_correlation_p_values", f"""WITH x AS (SELECT p_brand AS feature, p_size AS s, ln(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT feature, count(*) AS n, round(corr(s, v), 6) AS r FROM x GROUP BY 1), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df FROM c)
SELECT feature, round({t_tail_sql('t', 'df')}, 6) + 0 AS p_value, CASE WHEN abs(r) >= 0.5 THEN 'Large' WHEN abs(r) >= 0.3 THEN 'Medium' WHEN abs(r) >= 0.1 THEN 'Small' ELSE 'Negligible' END AS effect FROM t""")
def t18_correlation_p_values(spark, sf):
    out = t18_correlation_with_size(spark, sf)
    return out.select("feature", F.round(st.correlation_p(F.col("r"), F.col("n")), 6).alias("p_value"),
                      labels.correlation_effect_word(F.col("r")).alias("effect"))


@query("t19_severity_association", f"""WITH {ROWS} SELECT dataset, feature, count(*) AS n, CASE WHEN stddev_pop(value) > 1e-9 THEN round(corr(severity, value), 6) ELSE 0 END AS r
FROM rows WHERE severity IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 6 AND stddev_pop(severity) > 1e-9""")
def t19_severity_association(spark, sf):
    return rounded(st.trait_association(rows(spark, sf), KEYS, "severity"), "r").select(*KEYS, "n", "r")


@query("t20_top_and_bottom", f"""WITH {VALUES}, m AS (SELECT dataset, feature, avg(value) AS v FROM vals GROUP BY 1, 2)
SELECT dataset, feature, 'top' AS side, row_number() OVER (PARTITION BY dataset ORDER BY v DESC, feature) AS place FROM m QUALIFY place <= 5
UNION ALL SELECT dataset, feature, 'bottom', row_number() OVER (PARTITION BY dataset ORDER BY v, feature DESC) AS place FROM m QUALIFY place <= 5""")
def t20_top_and_bottom(spark, sf):
    means = values(spark, sf).groupBy(*KEYS).agg(F.avg("value").alias("v"))
    top = top_rows(means, ["dataset"], [F.col("v").desc(), F.col("feature")], 5).withColumn("side", F.lit("top"))
    low = top_rows(means, ["dataset"], [F.col("v"), F.col("feature").desc()], 5).withColumn("side", F.lit("bottom"))
    return top.unionByName(low).drop("v")


MEANS = f"""{VALUES}, mn AS (SELECT dataset, split_part(feature, '/', 1) AS system, avg(value) AS score FROM vals GROUP BY 1, 2),
ex AS (SELECT n_nationkey AS dataset, CASE n_nationkey % 3 WHEN 0 THEN ['1-URGENT', '5-LOW'] WHEN 1 THEN ['2-HIGH'] ELSE ['3-MEDIUM', '1-URGENT'] END AS expected FROM nation)"""


def priority_means(spark, sf):
    return values(spark, sf).groupBy("dataset", F.split_part("feature", F.lit("/"), F.lit(1)).alias("system")).agg(
        F.avg("value").alias("score"))


def expected(spark, sf):
    return table(spark, sf, "nation").selectExpr(
        "n_nationkey AS dataset", "CASE n_nationkey % 3 WHEN 0 THEN array('1-URGENT', '5-LOW') WHEN 1 THEN array('2-HIGH') "
        "ELSE array('3-MEDIUM', '1-URGENT') END AS expected")


@query("t21_expected_against_observed", f"""WITH {MEANS},
hi AS (SELECT dataset, list(system ORDER BY score DESC, system) AS act FROM (SELECT * FROM mn QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, system) <= 3) GROUP BY 1),
lo AS (SELECT dataset, list(system ORDER BY score, system DESC) AS sup FROM (SELECT * FROM mn QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score, system DESC) <= 2) GROUP BY 1)
SELECT dataset, array_to_string(act, ',') AS active, array_to_string(sup, ',') AS suppressed,
  array_to_string(list_filter(expected, lambda e: list_contains(act, e)), ',') AS matched,
  array_to_string(list_filter(expected, lambda e: NOT list_contains(act, e)), ',') AS missing,
  array_to_string(list_filter(act, lambda e: NOT list_contains(expected, e)), ',') AS unexpected
FROM hi JOIN lo USING (dataset) JOIN ex USING (dataset)""")
def t21_expected_against_observed(spark, sf):
    out = st.expected_against_observed(priority_means(spark, sf), expected(spark, sf))
    return out.select("dataset", *[F.array_join(c, ",").alias(c) for c in
                                   ("active", "suppressed", "matched", "missing", "unexpected")])


@query("t22_expected_rank", f"""WITH {MEANS}, e AS (SELECT dataset, expected[1] AS want FROM ex), s AS (SELECT dataset, want, score AS own FROM mn JOIN e USING (dataset) WHERE system = want)
SELECT dataset, want AS expected_system, count_if(score > own) + 1 AS rank, CASE WHEN count_if(score > own) = 0 THEN 'HIGH' WHEN count_if(score > own) = 1 THEN 'MODERATE' ELSE 'LOW' END AS significance
FROM mn JOIN s USING (dataset) GROUP BY 1, 2""")
def t22_expected_rank(spark, sf):
    return st.expected_rank(priority_means(spark, sf), expected(spark, sf)).select(
        "dataset", "expected_system", "rank", "significance")


@query("t22_top_two_overlap", f"""WITH {MEANS}, t AS (SELECT * FROM mn QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, system) <= 2),
o AS (SELECT dataset, count_if(list_contains(expected, system)) AS overlap FROM t JOIN ex USING (dataset) GROUP BY 1)
SELECT dataset, overlap, CASE WHEN overlap >= 2 THEN 'STRONG' WHEN overlap >= 1 THEN 'MODERATE' ELSE 'WEAK' END AS strength FROM o""")
def t22_top_two_overlap(spark, sf):
    return st.top_two_overlap(priority_means(spark, sf), expected(spark, sf))


SYSTEMS = ["S0", "S1", "S2", "S3", "S4", "ST"]


@query("t23_system_coordination", f"""WITH {SYS_SCORES} SELECT x.system AS a, y.system AS b, round(corr(x.score, y.score), 6) AS r, count(*) AS n
FROM sys x JOIN sys y ON x.sample = y.sample AND x.system < y.system GROUP BY 1, 2""")
def t23_system_coordination(spark, sf):
    out = st.pair_correlations(system_scores(spark, sf), [], "sample", "system", "score", SYSTEMS)
    return rounded(out, "r")


@query("t24_pairwise_correlation", f"""WITH {SYS_SCORES}, p AS (SELECT x.system AS a, y.system AS b, corr(x.score, y.score) AS r
FROM sys x JOIN sys y ON x.sample = y.sample AND x.system < y.system GROUP BY 1, 2)
SELECT a, b, round(r, 6) AS r, CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength FROM p""")
def t24_pairwise_correlation(spark, sf):
    out = st.pair_correlations(system_scores(spark, sf), [], "sample", "system", "score", SYSTEMS)
    return out.select("a", "b", r6("r", "r"), labels.correlation_strength(F.col("r")).alias("strength"))


@query("t23_extreme_pairs", f"""WITH {SYS_SCORES}, p AS (SELECT x.system AS a, y.system AS b, round(corr(x.score, y.score), 6) AS r FROM sys x JOIN sys y ON x.sample = y.sample AND x.system < y.system GROUP BY 1, 2)
SELECT 'top' AS side, row_number() OVER (ORDER BY r DESC, a, b) AS place, a, b, r FROM p QUALIFY place <= 3
UNION ALL SELECT 'bottom', row_number() OVER (ORDER BY r, a, b) AS place, a, b, r FROM p QUALIFY place <= 3""")
def t23_extreme_pairs(spark, sf):
    """The three pairs of systems that go together most, and least."""
    return rounded(co.extreme_pairs(st.pair_correlations(system_scores(spark, sf), [], "sample", "system", "score"), []).drop("n"), "r")


@query("t24_tested_pairs", f"""WITH {SYS_SCORES}, p AS (SELECT x.system AS a, y.system AS b, corr(x.score, y.score) AS r, count(*) AS n
  FROM sys x JOIN sys y ON x.sample = y.sample AND x.system < y.system GROUP BY 1, 2),
t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df FROM p)
SELECT a, b, round(r, 6) AS r, n, round({t_tail_sql('t', 'df')}, 6) + 0 AS p_value,
  CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength FROM t""")
def t24_tested_pairs(spark, sf):
    pairs = st.pair_correlations(system_scores(spark, sf), [], "sample", "system", "score")
    return co.tested_pairs(pairs).select("a", "b", r6("r", "r"), "n", (F.round("p_value", 6) + 0).alias("p_value"), "strength")


PART_PAIRS = f"""WITH {MEAS}, x AS (SELECT *, value - avg(value) OVER (PARTITION BY feature) AS c FROM meas),
p AS (SELECT x.feature AS a, y.feature AS b, corr(x.c, y.c) AS r, count(*) AS n FROM x JOIN x AS y ON x.sample = y.sample AND x.feature < y.feature
  GROUP BY 1, 2 HAVING count(*) >= 5)"""


def lines(spark, sf):
    """Price lines as they are; of several of a part and a supplier the pairs take the mean."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("feature"), F.col("l_extendedprice").alias("value"))


@query("j11_part_pairs", PART_PAIRS + """ SELECT a, b, round(r, 6) AS r, n FROM p WHERE abs(r) >= 0.9""")
def j11_part_pairs(spark, sf):
    """Pairs of all parts that move together over the suppliers that sell both."""
    return rounded(co.all_pair_correlations(lines(spark, sf), [], "sample", "feature", "value", least_n=5, least_r=0.9), "r")


@query("t24_part_pairs_by_strength", PART_PAIRS + """ SELECT CASE WHEN abs(round(r, 9)) >= 0.7 THEN 'Strong' WHEN abs(round(r, 9)) >= 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength, count(*) AS pairs, round(avg(r), 6) AS mean_r
FROM p GROUP BY 1""")
def t24_part_pairs_by_strength(spark, sf):
    pairs = co.all_pair_correlations(lines(spark, sf), [], "sample", "feature", "value", least_n=5)
    return pairs.groupBy(labels.correlation_strength(F.round("r", 9)).alias("strength")).agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg("r"), "mean_r"))


@query("t25_correlation_difference", f"""WITH {SYS_SCORES}, g AS (SELECT sys.*, CASE WHEN s_acctbal > 4500 THEN 'rich' ELSE 'poor' END AS g FROM sys JOIN supplier ON sample = s_suppkey),
c AS (SELECT x.g, x.system AS a, y.system AS b, corr(x.score, y.score) AS r FROM g x JOIN g y ON x.sample = y.sample AND x.system < y.system GROUP BY 1, 2, 3
  HAVING count(*) >= 3 AND stddev_pop(x.score) > 0 AND stddev_pop(y.score) > 0),
d AS (SELECT a, b, max(CASE WHEN g = 'rich' THEN r END) AS r_a, max(CASE WHEN g = 'poor' THEN r END) AS r_b FROM c GROUP BY 1, 2)
SELECT a, b, round(r_a, 6) AS r_a, round(r_b, 6) AS r_b, round(r_a - r_b, 6) AS difference FROM d WHERE abs(r_a - r_b) > 0.1""")
def t25_correlation_difference(spark, sf):
    groups = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("sample"), F.when(F.col("s_acctbal") > 4500, "rich").otherwise("poor").alias("g"))
    marked = system_scores(spark, sf).join(groups, "sample")
    by_group = st.pair_correlations(marked, ["g"], "sample", "system", "score", SYSTEMS)
    return rounded(st.correlation_difference(by_group, "g", "rich", "poor"), "r_a", "r_b", "difference")


@query("t26_platform_agreement", f"""WITH {MONTHLY}, p AS (SELECT feature, t, avg(CASE WHEN l_returnflag = 'A' THEN value END) AS x, avg(CASE WHEN l_returnflag = 'R' THEN value END) AS y FROM m GROUP BY 1, 2),
c AS (SELECT count(*) AS features, corr(x, y) AS r FROM p WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT features, round(r, 6) AS r, CASE WHEN r > 0.7 THEN 'high' WHEN r > 0.4 THEN 'moderate' ELSE 'low' END AS verdict FROM c""")
def t26_platform_agreement(spark, sf):
    means = monthly(spark, sf, "l_returnflag").groupBy(
        "l_returnflag", F.struct("feature", "t").alias("feature")).agg(F.avg("value").alias("value"))
    return rounded(st.platform_agreement(means, "l_returnflag", "feature", "value", "A", "R"), "r")


@query("t27_heterogeneity", f"""WITH {VALUES}, v AS (SELECT dataset, feature, CASE WHEN count(*) > 1 THEN var_samp(value) ELSE 0 END AS variance FROM vals GROUP BY 1, 2)
SELECT dataset, feature, round(variance, 6) AS variance, row_number() OVER (PARTITION BY dataset ORDER BY variance DESC, feature) AS place FROM v""")
def t27_heterogeneity(spark, sf):
    out = running(st.heterogeneity(values(spark, sf), KEYS), ["dataset"], [F.col("variance").desc(), F.col("feature")], position="place")
    return rounded(out, "variance")


@query("t27_system_heterogeneity", f"""WITH {VALUES}, s AS (SELECT dataset, sample, split_part(feature, '/', 1) AS system, avg(value) AS score FROM vals GROUP BY 1, 2, 3)
SELECT dataset, system, round(CASE WHEN count(*) > 1 THEN var_samp(score) ELSE 0 END, 6) AS variance FROM s GROUP BY 1, 2""")
def t27_system_heterogeneity(spark, sf):
    scores = values(spark, sf).groupBy("dataset", "sample", F.split_part("feature", F.lit("/"), F.lit(1)).alias("system")).agg(
        F.avg("value").alias("value"))
    return rounded(st.heterogeneity(scores, ["dataset", "system"]), "variance")


@query("t29_response_stratification", f"""WITH {ROWS}, m AS (SELECT dataset, feature, count_if(response = 'responder') AS n_a, count_if(response = 'non_responder') AS n_b,
  avg(CASE WHEN response = 'responder' THEN value END) AS a, avg(CASE WHEN response = 'non_responder' THEN value END) AS b FROM rows GROUP BY 1, 2)
SELECT dataset, feature, n_a, n_b, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(a - b, 6) AS mean_diff FROM m WHERE n_a >= 2 AND n_b >= 2""")
def t29_response_stratification(spark, sf):
    m = st.enough(st.two_group_moments(rows(spark, sf), KEYS, "response", "responder", "non_responder"))
    out = m.withColumn("mean_diff", F.col("mean_a") - F.col("mean_b"))
    return rounded(out, "mean_a", "mean_b", "mean_diff").select(*KEYS, "n_a", "n_b", "mean_a", "mean_b", "mean_diff")


@query("t30_severity_tertiles", f"""WITH {SYS_SCORES}, x AS (SELECT sample, sum(score) AS v FROM sys WHERE system IN ('S1', 'S2') GROUP BY 1),
q AS (SELECT quantile_cont(v, 1.0 / 3) AS a, quantile_cont(v, 2.0 / 3) AS b FROM x)
SELECT sample, round(v, 6) AS v, CASE WHEN v <= a THEN 'Mild' WHEN v <= b THEN 'Moderate' ELSE 'Severe' END AS stratum FROM x, q""")
def t30_severity_tertiles(spark, sf):
    index = system_scores(spark, sf).filter(F.col("system").isin("S1", "S2")).groupBy("sample").agg(
        F.sum("score").alias("v"))
    out = st.strata(index.withColumn("_all", F.lit(0)), ["_all"], "v", [1 / 3, 2 / 3], ["Mild", "Moderate", "Severe"])
    return rounded(out.drop("_all"), "v")


@query("t31_stratum_profiles", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.3333) AS a, quantile_cont(o_totalprice, 0.6667) AS b FROM orders)
SELECT CASE WHEN o_totalprice <= a THEN 'Low' WHEN o_totalprice <= b THEN 'Medium' ELSE 'High' END AS stratum, o_orderstatus AS status,
  count(*) AS n, round(avg(ln(o_totalprice)), 6) AS mean FROM orders, q GROUP BY 1, 2""")
def t31_stratum_profiles(spark, sf):
    base = table(spark, sf, "orders").select(F.lit(0).alias("_all"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    out = st.strata(base, ["_all"], "o_totalprice", [0.3333, 0.6667], ["Low", "Medium", "High"])
    return out.groupBy("stratum", "status").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.ln("o_totalprice")), "mean"))


@query("t32_rank_gaps", f"""WITH {MEANS} SELECT dataset, system, row_number() OVER w AS place, round(max(score) OVER (PARTITION BY dataset) - score, 6) AS from_top,
  round(score - lead(score) OVER w, 6) AS lead, row_number() OVER w - 1 AS rank_deviation FROM mn WINDOW w AS (PARTITION BY dataset ORDER BY score DESC, system)""")
def t32_rank_gaps(spark, sf):
    out = st.rank_gaps(priority_means(spark, sf), ["dataset"], "system", "score", F.lit(1))
    return rounded(out, "from_top", "lead").drop("score")


@query("t33_phase_shifts", f"""WITH {MONTHLY}, p AS (SELECT feature, t % 12 AS t, avg(value) AS mean FROM m GROUP BY 1, 2),
k AS (SELECT feature, arg_min(t, struct_pack(a := -mean, b := t)) AS peak_time, max(mean) AS peak,
  avg(CASE WHEN t > 3 THEN mean END) - avg(CASE WHEN t <= 3 THEN mean END) AS lme FROM p GROUP BY 1 HAVING count(*) >= 2)
SELECT feature, peak_time, round(peak, 6) AS peak, row_number() OVER (ORDER BY peak_time, feature) AS place,
  lead(peak_time) OVER (ORDER BY peak_time, feature) - peak_time AS gap_to_next, round(lme, 6) AS late_minus_early FROM k""")
def t33_phase_shifts(spark, sf):
    points = monthly(spark, sf).groupBy("feature", (F.col("t") % 12).alias("t")).agg(F.avg("value").alias("mean"))
    out = st.phase_shifts(points, "feature", "t")
    return rounded(out, "peak", "late_minus_early").select("feature", "peak_time", "peak", "place", "gap_to_next", "late_minus_early")


@query("t34_dominant_feature", f"""WITH {ROWS}, m AS (SELECT dataset, response, feature, avg(value) AS v FROM rows GROUP BY 1, 2, 3)
SELECT dataset, response, arg_min(feature, struct_pack(a := -v, b := feature)) AS dominant FROM m GROUP BY 1, 2""")
def t34_dominant_feature(spark, sf):
    means = group_profiles(rows(spark, sf), ["dataset", "response", "feature"], "value")
    return means.groupBy("dataset", "response").agg(
        F.min_by("feature", F.struct(-F.col("mean"), F.col("feature"))).alias("dominant"))


@query("t35_change_from_baseline", f"""WITH {ROWS}, sp AS (SELECT dataset, min(days) AS lo, max(days) AS hi FROM rows GROUP BY 1 HAVING min(days) < max(days)),
m AS (SELECT dataset, feature, avg(CASE WHEN days = lo THEN value END) AS a, avg(CASE WHEN days = hi THEN value END) AS b FROM rows JOIN sp USING (dataset) GROUP BY 1, 2)
SELECT dataset, feature, round(b - a, 6) AS change, round((b - a) / abs(a) * 100, 6) AS change_pct FROM m WHERE a IS NOT NULL AND b IS NOT NULL""")
def t35_change_from_baseline(spark, sf):
    return rounded(st.change_from_baseline(rows(spark, sf), KEYS, "days"), "change", "change_pct").select(
        *KEYS, "change", "change_pct")


@query("t36_row_z_scores", f"""WITH {MONTHLY}, p AS (SELECT feature, t, avg(value) AS v FROM m GROUP BY 1, 2)
SELECT feature, t, round((v - avg(v) OVER (PARTITION BY feature)) / stddev_pop(v) OVER (PARTITION BY feature), 6) AS z FROM p""")
def t36_row_z_scores(spark, sf):
    points = monthly(spark, sf).groupBy("feature", "t").agg(F.avg("value").alias("v"))
    return rounded(st.row_z_scores(points, ["feature"], "v"), "z").drop("v")


@query("t37_group_centroids", f"""WITH {SYS_SCORES} SELECT s_nationkey AS g, round(avg(CASE WHEN system = 'S1' THEN score END), 6) AS x,
  round(avg(CASE WHEN system = 'S2' THEN score END), 6) AS y FROM sys JOIN supplier ON sample = s_suppkey GROUP BY 1""")
def t37_group_centroids(spark, sf):
    groups = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("g"))
    return system_scores(spark, sf).join(groups, "sample").groupBy("g").agg(
        r6(F.avg(F.when(F.col("system") == "S1", F.col("score"))), "x"),
        r6(F.avg(F.when(F.col("system") == "S2", F.col("score"))), "y"))


@query("t42_adjusted_p_values", f"""WITH {TWO}, p AS (SELECT dataset, feature, {tail_sql('abs(diff) / se')} AS p FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p, feature) AS i, count(*) OVER (PARTITION BY dataset) AS m FROM p)
SELECT dataset, feature, round(least(1, p * m), 4) AS bonferroni,
  round(least(1, min(p * m / i) OVER (PARTITION BY dataset ORDER BY i DESC)), 4) AS bh FROM r""")
def t42_adjusted_p_values(spark, sf):
    tests = st.case_control(two_groups(spark, sf)).select(*KEYS, "p_value")
    bonferroni = st.adjust(tests, ["dataset"], "p_value", "feature", "bonferroni").select(
        *KEYS, F.round("p_adjusted", 4).alias("bonferroni"))
    bh = st.adjust(tests, ["dataset"], "p_value", "feature").select(*KEYS, F.round("p_adjusted", 4).alias("bh"))
    return bonferroni.join(bh, KEYS)


@query("t43_sample_leaders", f"""WITH {SYS_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, system) AS p FROM sys)
SELECT sample, max(CASE WHEN p = 1 THEN system END) AS first, round(max(CASE WHEN p = 1 THEN score END), 6) AS first_score,
  max(CASE WHEN p = 2 THEN system END) AS second, round(max(CASE WHEN p = 2 THEN score END), 6) AS second_score FROM r GROUP BY 1""")
def t43_sample_leaders(spark, sf):
    two = top_rows(system_scores(spark, sf), ["sample"], [F.col("score").desc(), F.col("system")], 2)
    at = lambda i, c: F.max(F.when(F.col("place") == i, F.col(c)))
    return two.groupBy("sample").agg(at(1, "system").alias("first"), r6(at(1, "score"), "first_score"),
                                     at(2, "system").alias("second"), r6(at(2, "score"), "second_score"))


@query("t43_named_rank_and_differences", f"""WITH {SYS_SCORES} SELECT x.sample, y.system AS other, round(x.score - y.score, 6) AS difference,
  (SELECT count(*) + 1 FROM sys z WHERE z.sample = x.sample AND (z.score > x.score OR z.score = x.score AND z.system < x.system)) AS rank
FROM sys x JOIN sys y ON x.sample = y.sample AND y.system <> 'S1' WHERE x.system = 'S1'""")
def t43_named_rank_and_differences(spark, sf):
    return rounded(st.named_rank(system_scores(spark, sf), "S1"), "difference").select("sample", "other", "difference", "rank")


@query("t44_activation_map", f"""WITH {MEANS}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, system) AS place FROM mn QUALIFY place <= 3)
SELECT system, dataset, place, round(score, 6) AS score, list_contains(expected, system) AS expected FROM r JOIN ex USING (dataset)""")
def t44_activation_map(spark, sf):
    top = top_rows(priority_means(spark, sf), ["dataset"], [F.col("score").desc(), F.col("system")], 3)
    return top.join(expected(spark, sf), "dataset").select(
        "system", "dataset", "place", r6("score", "score"), F.array_contains("expected", F.col("system")).alias("expected"))


@query("t45_datasets_by_system", f"""WITH {MEANS} SELECT unnest(expected) AS system, dataset FROM ex""")
def t45_datasets_by_system(spark, sf):
    return expected(spark, sf).select(F.explode("expected").alias("system"), "dataset")


EXPECTED_SETS = "CASE n_nationkey % 3 WHEN 0 THEN {0}'1-URGENT/F', '5-LOW/O'{1} WHEN 1 THEN {0}'2-HIGH/P'{1} ELSE {0}'3-MEDIUM/F', '1-URGENT/O'{1} END"


@query("t46_relevance", f"""WITH {VALUES}, f AS (SELECT DISTINCT dataset, feature FROM vals), ex AS (SELECT n_nationkey AS dataset, {EXPECTED_SETS.format("[", "]")} AS expected FROM nation)
SELECT dataset, feature, CASE WHEN list_contains(expected, feature) THEN 2 WHEN split_part(feature, '/', 1) = split_part(expected[1], '/', 1) THEN 1 ELSE 0 END AS relevance
FROM f JOIN ex USING (dataset)""")
def t46_relevance(spark, sf):
    sets = table(spark, sf, "nation").selectExpr("n_nationkey AS dataset", f"{EXPECTED_SETS.format('array(', ')')} AS expected")
    of = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    found = values(spark, sf).select("dataset", "feature").distinct().join(sets, "dataset")
    return found.select("dataset", "feature", st.relevance(F.col("feature"), F.col("expected"), of).alias("relevance"))


@query("t48_temporal_leaders", f"""WITH {MONTHLY}, x AS (SELECT l_returnflag AS dataset, t, feature, avg(value) AS v FROM m GROUP BY 1, 2, 3)
SELECT dataset, t, arg_min(feature, struct_pack(a := -v, b := feature)) AS leader, round(max(v), 6) AS score FROM x GROUP BY 1, 2""")
def t48_temporal_leaders(spark, sf):
    means = monthly(spark, sf, "l_returnflag").groupBy(F.col("l_returnflag").alias("dataset"), "t", "feature").agg(
        F.avg("value").alias("v"))
    return means.groupBy("dataset", "t").agg(
        F.min_by("feature", F.struct(-F.col("v"), F.col("feature"))).alias("leader"), r6(F.max("v"), "score"))
