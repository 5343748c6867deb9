"""Quality, coverage and chart-ready tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import design as dz
from tallyloom.operators import quality as ql
from tallyloom.operators import rule_tables as rt
from tallyloom.operators import statistics as st
from tallyloom.operators.ordering import top_rows
from tallyloom.plans.classification import CLASSIFIED, TERMS, classified, entries
from tallyloom.plans.common import r6
from tallyloom.plans.registry import query
from tallyloom.plans.statistics import PAIRS, ROWS, TWO, expected, rounded, rows, tail_sql
from tallyloom.plans.studies import DESIGN, MODES, VALUES, design, values
from tallyloom.session import cut, spread, table

WORDS = {"web": ["http", "www", "html"], "legal": ["license", "copyright", "warranty"], "mail": ["@", "contact"]}


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def checks():
    return [
        ("missing_text", "error", "text", F.col("text").isNull() | (F.trim("text") == "")),
        ("bad_length", "error", "n_chars", F.col("n_chars") != F.length("text")),
        ("unknown_language", "warning", "lang", ~F.col("lang").isin("en", "fr")),
        ("short_text", "warning", "text", F.length("text") < 200),
        ("no_sentence", "info", "text", ~F.col("text").rlike("[.!?]")),
    ]


ISSUES = r"""iss AS (SELECT doc_id, 'missing_text' AS type, 'error' AS severity, 'text' AS field FROM documents WHERE text IS NULL OR trim(text) = ''
UNION ALL SELECT doc_id, 'bad_length', 'error', 'n_chars' FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT doc_id, 'unknown_language', 'warning', 'lang' FROM documents WHERE lang NOT IN ('en', 'fr')
UNION ALL SELECT doc_id, 'short_text', 'warning', 'text' FROM documents WHERE length(text) < 200
UNION ALL SELECT doc_id, 'no_sentence', 'info', 'text' FROM documents WHERE NOT regexp_matches(text, '[.!?]'))"""


@query("q1_issues", f"WITH {ISSUES} SELECT * FROM iss")
def q1_issues(spark, sf):
    return ql.issues(documents(spark, sf), "doc_id", checks())


@query("q2_content_statistics", """SELECT lang, count(*) AS n, count_if(length(text) < 200) AS short, count_if(source IS NULL) AS missing_source, round(avg(ln(length(text))), 6) AS mean_log_length FROM documents GROUP BY 1""")
def q2_content_statistics(spark, sf):
    return documents(spark, sf).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") < 200).alias("short"), F.count_if(F.col("source").isNull()).alias("missing_source"),
        r6(F.avg(F.ln(F.length("text"))), "mean_log_length"))


@query("q3_class_counts", """SELECT p_type AS class_a, p_brand AS class_b, count(*) AS n, count_if(NOT regexp_matches(p_name, '^[a-z]+ [a-z]+$')) AS bad_names FROM part GROUP BY 1, 2""")
def q3_class_counts(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("class_a"), F.col("p_brand").alias("class_b")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("p_name").rlike("^[a-z]+ [a-z]+$")).alias("bad_names"))


SCORE = f"""{ISSUES}, mk AS (SELECT doc_id, count_if(severity = 'error') AS e, count_if(severity = 'warning') AS w FROM iss GROUP BY 1),
qs AS (SELECT source, count(*) AS total, count_if(coalesce(e, 0) = 0) AS valid, CAST(sum(coalesce(e, 0)) AS BIGINT) AS errors, CAST(sum(coalesce(w, 0)) AS BIGINT) AS warnings
FROM documents LEFT JOIN mk USING (doc_id) GROUP BY 1)"""


@query("q4_quality_score", f"""WITH {SCORE} SELECT source, total, valid, errors, warnings, greatest(0, least(100, round(100.0 * valid / total - 5 * errors - 2 * warnings, 6))) AS score,
  round(valid * 1.0 / total, 6) AS completeness FROM qs""")
def q4_quality_score(spark, sf):
    docs = documents(spark, sf)
    out = ql.quality_score(docs, ql.issues(docs, "doc_id", checks()), "doc_id", ["source"])
    return rounded(out, "score", "completeness")


@query("q5_source_consistency", f"""WITH {CLASSIFIED}, i AS (SELECT source, 'no_system' AS type, 'warning' AS severity FROM cls WHERE system = '0' UNION ALL SELECT source, 'low_confidence', 'info' FROM cls WHERE confidence < 0.6)
SELECT type, severity, count_if(source = 'GO') AS "GO", count_if(source = 'KEGG') AS "KEGG" FROM i GROUP BY 1, 2""")
def q5_source_consistency(spark, sf):
    rows_ = classified(spark, sf)
    found = ql.issues(rows_, "id", [("no_system", "warning", "system", F.col("system") == "0"),
                                    ("low_confidence", "info", "confidence", F.round("confidence", 9) < 0.6)])
    return ql.source_consistency(found.join(rows_.select("id", "source"), "id"), "source")


@query("q6_coverage", """SELECT coalesce(lang, 'all') AS lang, count(*) AS total, count(l.doc_id) AS classified, round(count(l.doc_id) * 1.0 / count(*), 6) AS coverage
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ROLLUP (lang)""")
def q6_coverage(spark, sf):
    return rounded(ql.coverage(documents(spark, sf), table(spark, sf, "labels"), "doc_id", "lang"), "coverage")


def hits_sql(words):
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words)


FAILED = f"""m AS (SELECT doc_id, text, {', '.join(f"{hits_sql(w)} AS {k}" for k, w in WORDS.items())} FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
fr AS (SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'no_text' WHEN length(text) < 20 THEN 'short_text' WHEN greatest(web, legal, mail) = 0 THEN 'no_keyword' ELSE 'ambiguous' END AS reason,
  CASE WHEN greatest(web, legal, mail) = 0 THEN NULL WHEN web = greatest(web, legal, mail) THEN 'web' WHEN legal = greatest(web, legal, mail) THEN 'legal' ELSE 'mail' END AS suggested,
  round(least(0.8, 0.2 * greatest(web, legal, mail)), 6) AS suggestion_confidence FROM m)"""


def failures(spark, sf):
    missed = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    return ql.failure_reasons(missed, F.col("text"), WORDS)


@query("q7_failure_reasons", f"WITH {FAILED} SELECT doc_id, reason, suggested, suggestion_confidence FROM fr")
def q7_failure_reasons(spark, sf):
    return rounded(failures(spark, sf), "suggestion_confidence").drop("text")


@query("q8_result_validity", f"""WITH {CLASSIFIED}, found AS (SELECT unnest([CASE WHEN system NOT IN ('A', 'B', 'C', 'D', 'E', '0') THEN 'unknown_system' END,
  CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'out_of_range' END, CASE WHEN system IS NULL THEN 'missing_system' END, CASE WHEN subsystem IS NULL THEN 'missing_subsystem' END,
  CASE WHEN confidence > 0.85 THEN 'suspicious' END]) AS type FROM cls) SELECT type, count(*) AS n FROM found WHERE type IS NOT NULL GROUP BY 1""")
def q8_result_validity(spark, sf):
    checks_ = [
        ("unknown_system", "error", "system", ~F.col("system").isin("A", "B", "C", "D", "E", "0")),
        ("out_of_range", "error", "confidence", ~F.col("confidence").between(0, 1)),
        ("missing_system", "error", "system", F.col("system").isNull()),
        ("missing_subsystem", "warning", "subsystem", F.col("subsystem").isNull()),
        ("suspicious", "info", "confidence", F.col("confidence") > 0.85),
    ]
    return ql.issues(classified(spark, sf), "id", checks_).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("q9_failure_shares", f"WITH {FAILED} SELECT reason, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM fr), 6) AS share FROM fr GROUP BY 1")
def q9_failure_shares(spark, sf):
    return rounded(ql.shares_of(cut(failures(spark, sf).select("reason")), "reason"), "share")


@query("q10_primary_missing_from_all", f"WITH {CLASSIFIED} SELECT id, system, all_systems FROM cls WHERE NOT list_contains(string_split(all_systems, ','), system)")
def q10_primary_missing_from_all(spark, sf):
    out = ql.inconsistent_results(classified(spark, sf), "id", "system", "all_systems")
    return out.withColumn("all_systems", F.array_join("all_systems", ","))


@query("q11_overall_quality", f"""WITH {SCORE}, c AS (SELECT source, count(l.doc_id) * 1.0 / count(*) AS cov FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1),
o AS (SELECT source, 0.4 * greatest(0, least(100, 100.0 * valid / total - 5 * errors - 2 * warnings)) + 0.6 * cov * 100 AS v FROM qs JOIN c USING (source))
SELECT source, round(v, 6) AS overall, CASE WHEN v >= 90 THEN 'excellent' WHEN v >= 75 THEN 'good' WHEN v >= 60 THEN 'fair' ELSE 'poor' END AS level FROM o""")
def q11_overall_quality(spark, sf):
    docs = documents(spark, sf)
    scored = ql.quality_score(docs, ql.issues(docs, "doc_id", checks()), "doc_id", ["source"])
    covered = ql.coverage(docs, table(spark, sf, "labels"), "doc_id", "source").select("source", "coverage")
    out = scored.join(covered, "source").withColumns(ql.overall_quality(F.col("score"), F.col("coverage")))
    return rounded(out.select("source", "overall", "level"), "overall")


@query("q13_recommendation_codes", """WITH m AS (SELECT 'coverage' AS metric, (SELECT count(*) FROM labels) * 1.0 / count(*) AS value FROM documents UNION ALL SELECT 'short_share', avg(CASE WHEN length(text) < 200 THEN 1.0 ELSE 0 END) FROM documents
  UNION ALL SELECT 'documents', count(*) FROM documents)
SELECT metric, CASE metric WHEN 'coverage' THEN 'raise_coverage' ELSE 'too_few' END AS code FROM m WHERE (metric = 'coverage' AND value < 0.9) OR (metric = 'documents' AND value < 5000)""")
def q13_recommendation_codes(spark, sf):
    docs, marks = documents(spark, sf), table(spark, sf, "labels")
    joined = docs.join(marks.select("doc_id").distinct().withColumn("_l", F.lit(1)), "doc_id", "left")
    one = joined.agg(F.avg(F.coalesce("_l", F.lit(0))).alias("coverage"), F.avg((F.length("text") < 200).cast("double")).alias("short_share"),
                     F.count(F.lit(1)).cast("double").alias("documents"))
    metrics = cut(one.unpivot([], ["coverage", "short_share", "documents"], "metric", "value"))
    rules = [("raise_coverage", "coverage", "<", 0.9), ("shorten", "short_share", ">", 0.99), ("too_few", "documents", "<", 5000)]
    return ql.threshold_codes(metrics, rules).select("metric", "code")


METRICS = f"""{CLASSIFIED}, own AS (SELECT source, count(*) AS n, count(*) FILTER (namespace = 'biological_process') AS process, avg(CASE WHEN definition IS NULL THEN 1.0 ELSE 0 END) AS undefined,
  avg(CASE WHEN id % 17 = 3 THEN 1.0 ELSE 0 END) AS obsolete, count(*) FILTER (contains(name, 'metabolism') OR contains(coalesce(definition, ''), 'metabolism')) AS metabolism,
  count(*) FILTER (system = '0') AS unclassified FROM cls GROUP BY 1),
sizes AS (SELECT count(*) AS k FROM cls WHERE system <> '0' GROUP BY system),
metrics AS (SELECT 'terms' AS scope, unnest(['process_terms', 'obsolete_share', 'missing_definition_share', 'errors']) AS metric, unnest([process * 1.0, obsolete, undefined, 0.0]) AS value FROM own WHERE source = 'GO'
  UNION ALL SELECT 'pathways', unnest(['pathways', 'metabolism_pathways', 'warnings']), unnest([n * 1.0, metabolism * 1.0, unclassified * 1.0]) FROM own WHERE source = 'KEGG'
  UNION ALL SELECT 'coverage', 'coverage', 1 - sum(unclassified) / sum(n) FROM own UNION ALL SELECT 'coverage', 'largest_to_smallest_system', max(k) * 1.0 / min(k) FROM sizes)"""


def quality_metrics(spark, sf):
    rows = classified(spark, sf)
    share = lambda c: F.avg(c.cast("double"))
    own = cut(rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("namespace") == "biological_process").alias("process"), share(F.col("definition").isNull()).alias("undefined"),
        share(F.col("id") % 17 == 3).alias("obsolete"), F.count_if(F.col("name").contains("metabolism") | F.coalesce("definition", F.lit("")).contains("metabolism")).alias("metabolism"),
        F.count_if(F.col("system") == "0").alias("unclassified")))
    named = lambda scope, **figures: F.array(*[F.struct(F.lit(scope).alias("scope"), F.lit(k).alias("metric"), F.col(c).cast("double").alias("value")) if isinstance(c, str)
                                              else F.struct(F.lit(scope).alias("scope"), F.lit(k).alias("metric"), F.lit(c).alias("value")) for k, c in figures.items()])
    terms = own.filter("source = 'GO'").select(F.inline(named("terms", process_terms="process", obsolete_share="obsolete", missing_definition_share="undefined", errors=0.0)))
    pathways = own.filter("source = 'KEGG'").select(F.inline(named("pathways", pathways="n", metabolism_pathways="metabolism", warnings="unclassified")))
    covered = own.agg((1 - F.sum("unclassified") / F.sum("n")).alias("c")).select(F.inline(named("coverage", coverage="c")))
    sizes = rows.filter("system <> '0'").groupBy("system").agg(F.count(F.lit(1)).alias("k")).agg((F.max("k") / F.min("k")).alias("k"))
    return terms.unionByName(pathways).unionByName(covered).unionByName(sizes.select(F.inline(named("coverage", largest_to_smallest_system="k"))))


RULE_ROWS = ", ".join(f"('{s}', '{m}', '{o}', {x}, '{c}', '{v}', {p})" for s, m, o, x, c, v, p in rt.SHIPPED_THRESHOLDS)


@query("q13_shipped_thresholds", f"""WITH {METRICS}, rules(scope, metric, op, lim, code, severity, priority) AS (VALUES {RULE_ROWS}),
fit AS (SELECT m.scope, m.metric, m.value, code, severity, row_number() OVER (PARTITION BY m.scope, m.metric ORDER BY priority, code) AS i FROM metrics m JOIN rules r ON r.metric = m.metric AND r.scope IN (m.scope, '*')
  AND CASE op WHEN '<' THEN value < lim WHEN '<=' THEN value <= lim WHEN '>' THEN value > lim WHEN '>=' THEN value >= lim ELSE value = lim END)
SELECT scope, metric, round(value, 6) AS value, code, severity FROM fit WHERE i = 1""")
def q13_shipped_thresholds(spark, sf):
    return rounded(rt.broken_thresholds(quality_metrics(spark, sf), rt.threshold_frame(spark)), "value")


@query("q11_issue_priorities", f"""WITH {CLASSIFIED}, k AS (SELECT 'errors' AS category, count(*) FILTER (name IS NULL OR name = '') AS n FROM cls UNION ALL SELECT 'warnings', count(*) FILTER (definition IS NULL) FROM cls
  UNION ALL SELECT 'low_coverage', CASE WHEN avg(CASE WHEN system = '0' THEN 1.0 ELSE 0 END) > 0.2 THEN count(*) FILTER (system = '0') ELSE 0 END FROM cls
  UNION ALL SELECT 'no_match', count(*) FILTER (system = '0' AND kind <> 'general') FROM cls UNION ALL SELECT 'general', count(*) FILTER (kind = 'general') FROM cls),
r AS (SELECT category, CASE WHEN category IN ('errors', 'low_coverage', 'system_error') THEN 'high' ELSE 'medium' END AS priority, n AS "count",
  CASE category WHEN 'errors' THEN 'critical' WHEN 'low_coverage' THEN 'high' ELSE 'moderate' END AS impact FROM k WHERE n > 0)
SELECT *, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 3 ELSE 2 END DESC, "count" DESC, category) AS place FROM r""")
def q11_issue_priorities(spark, sf):
    rows = classified(spark, sf)
    missed = F.col("system") == "0"
    one = rows.agg(
        F.count_if(F.col("name").isNull() | (F.col("name") == "")).alias("errors"), F.count_if(F.col("definition").isNull()).alias("warnings"),
        F.when(F.avg(missed.cast("double")) > 0.2, F.count_if(missed)).otherwise(0).alias("low_coverage"),
        F.count_if(missed & (F.col("kind") != "general")).alias("no_match"), F.count_if(F.col("kind") == "general").alias("general"))
    return rt.issue_priorities(cut(one.unpivot([], one.columns, "category", "count")))


@query("q11_estimated_gain", f"""WITH {CLASSIFIED}, f AS (SELECT source, count(*) FILTER (definition IS NULL AND id % 7 = 0) AS errors, count(*) FILTER (system = '0' AND kind <> 'general') AS recoverable, count(*) AS entries FROM cls GROUP BY 1),
g AS (SELECT *, least(20.0, errors * 2.0) AS error_gain, recoverable * 100.0 / entries AS coverage_gain FROM f)
SELECT source, errors, recoverable, entries, CAST(error_gain AS DOUBLE) AS error_gain, round(coverage_gain, 6) AS coverage_gain, round(error_gain + coverage_gain * 0.6, 6) AS total_gain,
  CASE WHEN errors > 10 THEN 'high' WHEN errors > 0 THEN 'medium' END AS error_effort, CASE WHEN errors = 0 AND recoverable = 0 THEN 'minimal' ELSE 'low' END AS effort FROM g""")
def q11_estimated_gain(spark, sf):
    figures = classified(spark, sf).groupBy("source").agg(
        F.count_if(F.col("definition").isNull() & (F.col("id") % 7 == 0)).alias("errors"),
        F.count_if((F.col("system") == "0") & (F.col("kind") != "general")).alias("recoverable"), F.count(F.lit(1)).alias("entries"))
    return rounded(rt.estimated_gain(figures), "coverage_gain", "total_gain")


TITLE_RULES = [("1-URGENT", 1, "^F of 199[0-6]", "early"), ("1-URGENT", 2, "^F ", "done"), ("2-HIGH", 1, "7$", "seventh"), ("*", 1, "^O ", "open"), ("*", 2, "of 1998", "last")]


@query("f13_title_groups", f"""WITH t AS (SELECT o_orderkey AS sample, o_orderpriority AS dataset, o_orderstatus || ' of ' || year(o_orderdate) AS title FROM orders),
rules(scope, priority, pattern, effect) AS (VALUES {", ".join(f"('{a}', {b}, '{c}', '{d}')" for a, b, c, d in TITLE_RULES)}),
m AS (SELECT sample, effect, row_number() OVER (PARTITION BY sample ORDER BY scope = '*', priority, effect) AS i FROM t JOIN rules ON scope IN (dataset, '*') AND regexp_matches(title, pattern))
SELECT t.sample, coalesce(effect, 'Unknown') AS "group" FROM t LEFT JOIN (SELECT * FROM m WHERE i = 1) m USING (sample)""")
def f13_title_groups(spark, sf):
    """Rules by dataset for what a sample's title says of its group."""
    titles = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("dataset"),
        F.concat("o_orderstatus", F.lit(" of "), F.year("o_orderdate").cast("string")).alias("title"))
    return rt.first_by_rule(titles, rt.rule_frame(spark, TITLE_RULES), ["sample"], "dataset", "title", "group", "Unknown").select("sample", "group")


@query("g14_ontology_statistics", f"""WITH {TERMS} SELECT namespace, count(*) AS n, count(definition) AS defined, count(DISTINCT name) AS names FROM terms GROUP BY 1""")
def g14_ontology_statistics(spark, sf):
    return entries(spark, sf).groupBy("namespace").agg(
        F.count(F.lit(1)).alias("n"), F.count("definition").alias("defined"), F.count_distinct("name").alias("names"))


@query("p10_term_filter_counts", f"""WITH {TERMS} SELECT CASE WHEN namespace <> 'biological_process' THEN 'namespace' WHEN contains(name, 'killing') THEN 'pattern' WHEN id % 53 = 0 THEN 'general' ELSE 'kept' END AS reason, count(*) AS n FROM terms GROUP BY 1""")
def p10_term_filter_counts(spark, sf):
    from tallyloom.operators.filters import filter_with_counts
    rules = [("namespace", F.col("namespace") != "biological_process"), ("pattern", F.col("name").contains("killing")), ("general", F.col("id") % 53 == 0)]
    return filter_with_counts(entries(spark, sf), rules)[1]


@query("p11_process_terms", f"WITH {TERMS} SELECT id FROM terms WHERE namespace = 'biological_process' AND id % 53 <> 0")
def p11_process_terms(spark, sf):
    return entries(spark, sf).filter("namespace = 'biological_process' AND id % 53 <> 0").select("id")


@query("p17_finite_values", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value)")
def p17_finite_values(spark, sf):
    from tallyloom.operators.enrichment import present_values
    return present_values(table(spark, sf, "events")).select("event_id", "value")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

LONG = """SELECT dataset, {block} AS block, {key} AS key, unnest([{names}]) AS metric, unnest([{values}]) AS value, NULL AS note FROM ({rows})"""


def long_sql(block: str, key: str, metrics: list[str], rows: str) -> str:
    return LONG.format(block=block, key=key, rows=rows, names=", ".join(f"'{m}'" for m in metrics),
                       values=", ".join(f"CAST({m} AS DOUBLE)" for m in metrics))


R = ("CASE WHEN stddev_pop({y}) > 1e-9 THEN corr({x}, {y}) ELSE 0 END AS r")
T38_OWN = " UNION ALL ".join([
    long_sql("'case_control'", "feature", ["n_a", "n_b", "mean_diff", "fold_change", "effect_size", "p_value"],
             "SELECT dataset, feature, n_a, n_b, diff AS mean_diff, (mean_a + 1e-6) / (mean_b + 1e-6) AS fold_change, CASE WHEN sd > 1e-12 THEN diff / sd ELSE 0 END AS effect_size, "
             f"CASE WHEN se > 1e-12 THEN {tail_sql('abs(diff) / se')} ELSE 1 END AS p_value FROM e JOIN modes USING (dataset) WHERE mode = 'case_control'"),
    long_sql("'time_series'", "feature", ["n", "slope", "peak_time", "shift"],
             "SELECT dataset, feature, count(value) AS n, coalesce(regr_slope(value, days), 0) AS slope, arg_min(days, struct_pack(a := -value, b := sample)) AS peak_time, "
             "coalesce(avg(CASE WHEN days = hi THEN value END), 0) - coalesce(avg(CASE WHEN days = lo THEN value END), 0) AS shift "
             "FROM x JOIN sp USING (dataset) WHERE days IS NOT NULL AND mode = 'time_series' GROUP BY 1, 2 HAVING count(*) >= 3"),
    long_sql("'subtype_comparison'", "feature", ["spread", "groups"],
             "SELECT dataset, feature, max(mean) - min(mean) AS spread, count(*) AS groups FROM sg GROUP BY 1, 2 HAVING count(*) >= 3"),
    long_sql("'continuous_trait_association'", "feature", ["n", "r"],
             f"SELECT dataset, feature, count(*) AS n, {R.format(x='tr', y='value')} FROM x WHERE mode = 'continuous_trait_association' AND tr IS NOT NULL "
             "GROUP BY 1, 2 HAVING count(*) >= 6 AND stddev_pop(tr) > 1e-9"),
])
T38_CROSS = " UNION ALL ".join([
    long_sql("'heterogeneity'", "feature", ["variance"], "SELECT dataset, feature, coalesce(var_samp(value), 0) AS variance FROM x GROUP BY 1, 2"),
    long_sql("'system_heterogeneity'", "system", ["variance"], "SELECT dataset, system, coalesce(var_samp(score), 0) AS variance FROM sy GROUP BY 1, 2"),
    long_sql("'coordination'", "pair_name", ["n", "r"],
             "SELECT a.dataset, a.system || '|' || b.system AS pair_name, count(*) AS n, corr(a.score, b.score) AS r FROM sy a JOIN sy b ON a.sample = b.sample AND a.dataset = b.dataset "
             "AND a.system < b.system GROUP BY 1, 2 HAVING count(*) >= 3 AND stddev_pop(a.score) > 0 AND stddev_pop(b.score) > 0"),
    long_sql("'expected'", "'all'", ["matched", "missing", "unexpected"],
             "SELECT dataset, len(list_filter(expected, lambda e: list_contains(act, e))) AS matched, len(list_filter(expected, lambda e: NOT list_contains(act, e))) AS missing, "
             "len(list_filter(act, lambda e: NOT list_contains(expected, e))) AS unexpected FROM (SELECT dataset, list(system ORDER BY score DESC, system) AS act FROM "
             "(SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, system) <= 3) GROUP BY 1) JOIN ex USING (dataset)"),
    long_sql("'pairs'", "feature", ["pairs", "mean_delta", "sd_delta"],
             "SELECT dataset, feature, count(*) AS pairs, avg(delta) AS mean_delta, coalesce(stddev_samp(delta), 0) AS sd_delta FROM dl GROUP BY 1, 2 HAVING count(*) >= 2"),
    long_sql("'response'", "feature", ["n_a", "n_b", "mean_diff"],
             "SELECT dataset, feature, count_if(response = 'responder') AS n_a, count_if(response = 'non_responder') AS n_b, avg(CASE WHEN response = 'responder' THEN value END) "
             "- avg(CASE WHEN response = 'non_responder' THEN value END) AS mean_diff FROM x GROUP BY 1, 2 HAVING count_if(response = 'responder') >= 2 AND count_if(response = 'non_responder') >= 2"),
    long_sql("'severity'", "feature", ["n", "r"],
             f"SELECT dataset, feature, count(*) AS n, {R.format(x='severity', y='value')} FROM x WHERE severity IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 6 AND stddev_pop(severity) > 1e-9"),
])
REASON = "CASE key " + " ".join(f"WHEN '{mode}' THEN '{text}'" for mode, text in dz.FALLBACK_REASONS.items()) + " END"


@query("t38_run_statistics", f"""WITH {PAIRS[:PAIRS.index("pp AS")]} {MODES}, {TWO[TWO.index("m AS"):]}, {PAIRS[PAIRS.index("pp AS"):]},
x AS (SELECT rows.*, mode, trait, CASE trait WHEN 'age' THEN age WHEN 'severity' THEN severity END AS tr, split_part(feature, '/', 1) AS system FROM rows JOIN modes USING (dataset)),
sp AS (SELECT dataset, min(days) AS lo, max(days) AS hi FROM x WHERE days IS NOT NULL GROUP BY 1),
sg AS (SELECT dataset, feature, subtype, avg(value) AS mean FROM x WHERE subtype <> 'unknown' AND mode = 'subtype_comparison' GROUP BY 1, 2, 3 HAVING count(*) >= 2),
sy AS (SELECT dataset, sample, system, avg(value) AS score FROM x GROUP BY 1, 2, 3), sm AS (SELECT dataset, system, avg(score) AS score FROM sy GROUP BY 1, 2),
ex AS (SELECT n_nationkey AS dataset, CASE n_nationkey % 3 WHEN 0 THEN ['1-URGENT', '5-LOW'] WHEN 1 THEN ['2-HIGH'] ELSE ['3-MEDIUM', '1-URGENT'] END AS expected FROM nation),
own AS ({T38_OWN}), done AS (SELECT DISTINCT dataset FROM own),
state AS (SELECT dataset, any_value(mode) AS key, dataset IN (SELECT dataset FROM done) AS ok FROM x GROUP BY 1)
SELECT dataset, block, key, metric, CASE metric WHEN 'p_value' THEN round(value, 4) ELSE round(value, 6) END AS value, note FROM (
  SELECT * FROM own UNION ALL {T38_CROSS}
  UNION ALL SELECT dataset, 'unsupervised_pattern_discovery', feature, 'mean', avg(value), NULL FROM x WHERE dataset NOT IN (SELECT dataset FROM done) GROUP BY dataset, feature
  UNION ALL SELECT dataset, 'status', key, 'fallback', CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN NOT ok THEN {REASON} END FROM state)""")
def t38_run_statistics(spark, sf):
    out = dz.run_statistics(values(spark, sf), design(spark, sf), expected(spark, sf), PRIORITIES,
                            lambda feature: F.split_part(feature, F.lit("/"), F.lit(1)))
    return out.withColumn("value", F.when(F.col("metric") == "p_value", F.round("value", 4)).otherwise(F.round("value", 6)))


@query("t39_table_plan", f"""WITH {DESIGN}, {MODES}
SELECT dataset, CASE mode WHEN 'time_series' THEN 'radar,barplot,time_series_system,time_series_subcategory,heatmap,heterogeneity_heatmap' WHEN 'case_control' THEN 'radar,barplot,boxplot,heatmap,expected_vs_observed_barplot,heterogeneity_heatmap'
  WHEN 'subtype_comparison' THEN 'radar,barplot,grouped_subtype_boxplot,heatmap,correlation,heterogeneity_heatmap' WHEN 'continuous_trait_association' THEN 'radar,barplot,trait_scatter_plot,correlation,heatmap,heterogeneity_heatmap'
  ELSE 'radar,barplot,heatmap,correlation,heterogeneity_heatmap' END AS tables FROM modes""")
def t39_table_plan(spark, sf):
    designs = dz.infer_design(design(spark, sf)).withColumn("has_heterogeneity", F.lit(True))
    return dz.table_plan(designs).select("dataset", F.array_join("tables", ",").alias("tables"))


FEATURES = [f"{priority}/{status}" for priority in PRIORITIES for status in "FOP"]


@query("t40_heat_table", f"""WITH {VALUES} SELECT dataset, sample, {", ".join(f"round(avg(CASE WHEN feature = '{f}' THEN value END), 6) AS "
    f'"{f}"' for f in FEATURES)} FROM vals GROUP BY 1, 2""")
def t40_heat_table(spark, sf):
    names = FEATURES
    wide = values(spark, sf).groupBy("dataset", "sample").pivot("feature", names).agg(F.avg("value"))
    return rounded(wide, *names)


@query("t40_box_rows", f"""WITH {ROWS} SELECT dataset, response, feature, count(*) AS n, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high FROM rows GROUP BY 1, 2, 3""")
def t40_box_rows(spark, sf):
    from tallyloom.operators.ordering import quantiles
    keys = ["dataset", "response", "feature"]
    joined = rows(spark, sf)
    ends = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    boxes = quantiles(joined, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return rounded(ends.join(boxes, keys), "low", "q1", "median", "q3", "high").select(*keys, "n", "low", "q1", "median", "q3", "high")


@query("t40_time_lines", f"""WITH {ROWS} SELECT dataset, feature, days, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd
FROM rows WHERE days IS NOT NULL GROUP BY 1, 2, 3""")
def t40_time_lines(spark, sf):
    out = rows(spark, sf).filter("days IS NOT NULL").groupBy("dataset", "feature", "days").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    return rounded(out, "mean", "sd")


@query("t40_trait_fit", f"""WITH {ROWS} SELECT dataset, feature, round(regr_slope(value, severity), 6) AS slope, round(regr_intercept(value, severity), 6) AS intercept, count(severity) AS n
FROM rows WHERE severity IS NOT NULL GROUP BY 1, 2 HAVING count(severity) >= 6""")
def t40_trait_fit(spark, sf):
    out = st.linear_fit(rows(spark, sf).filter("severity IS NOT NULL"), ["dataset", "feature"], "severity", "value").filter("n >= 6")
    return rounded(out, "slope", "intercept").select("dataset", "feature", "slope", "intercept", "n")


@query("t40_most_variable", f"""WITH {VALUES}, v AS (SELECT feature, var_samp(value) AS variance FROM vals GROUP BY 1)
SELECT feature, round(variance, 6) AS variance FROM v ORDER BY variance DESC, feature LIMIT 8""")
def t40_most_variable(spark, sf):
    out = st.heterogeneity(values(spark, sf), ["feature"])
    return rounded(out.orderBy(F.col("variance").desc(), "feature").limit(8), "variance")


@query("t40_ranked_bars", f"""WITH {VALUES}, m AS (SELECT dataset, feature, avg(value) AS mean FROM vals GROUP BY 1, 2)
SELECT dataset, feature, round(mean, 6) AS mean, row_number() OVER (PARTITION BY dataset ORDER BY mean DESC, feature) AS place FROM m""")
def t40_ranked_bars(spark, sf):
    from tallyloom.operators.ordering import running
    means = values(spark, sf).groupBy("dataset", "feature").agg(F.avg("value").alias("mean"))
    return rounded(running(means, ["dataset"], [F.col("mean").desc(), F.col("feature")], position="place"), "mean")
