"""Catalogue entries derived from the orders, their filters and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.metadata import sample_items  # noqa: F401
from tallyloom.operators import catalogue as ct
from tallyloom.operators import filters as fl
from tallyloom.operators import joins as jn
from tallyloom.plans.common import SCORES, SETS, SYSTEM, hierarchy, measurements, r6, scores, sets, system_of
from tallyloom.plans.registry import query
from tallyloom.session import table

TITLES = ["Breast cancer cohort", "Alzheimer disease brain", "Wound healing in skin", "Healthy donors",
          "Type 2 diabetes islets", "miRNA in infection", "Sepsis blood", "Lupus nephritis kidney",
          "Heart failure biopsies", "Schizophrenia cortex", "Asthma airway", "Yeast growth"]
KINDS = ["Expression profiling by array", "Expression profiling by high throughput sequencing",
         "Genome binding/occupancy profiling", "Methylation profiling by array",
         "Expression profiling by array; Non-coding RNA profiling by array"]
TAXA = ["Homo sapiens", "Homo sapiens; Mus musculus", "Mus musculus"]
PLATFORMS = ["GPL570", "96;gpl97", " GPL10558 ; 570", ""]


def one_of(values, expr, spark=True):
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    if spark:
        return f"element_at(array({quoted}), CAST(({expr}) % {len(values)} AS INT) + 1)"
    return f"list_extract([{quoted}], CAST(({expr}) % {len(values)} AS INT) + 1)"


def entry_columns(spark: bool) -> str:
    div = "div" if spark else "//"
    return f"""CASE WHEN o_orderkey % 37 = 0 THEN 'GDS' ELSE 'GSE' END AS entrytype,
  CASE WHEN o_orderkey % 41 = 0 THEN 'GDS' ELSE 'GSE' END || CAST(o_orderkey AS VARCHAR(20)) AS accession,
  {one_of(TAXA, f'o_orderkey {div} 7', spark)} AS taxon, {one_of(KINDS, f'o_orderkey {div} 3', spark)} AS gdstype,
  CAST(o_custkey % 60 AS INT) AS n_samples, CASE WHEN o_orderkey % 29 = 0 THEN 2 ELSE 0 END AS subseries,
  {one_of(TITLES, 'o_orderkey', spark)} AS title, o_orderpriority || ' study of ' || {one_of(TITLES, 'o_custkey', spark)} AS summary,
  {one_of(PLATFORMS, 'o_custkey', spark)} AS gpl, o_orderkey % 5 <> 0 AS has_matrix, o_orderkey % 7 <> 0 AS has_platform"""


ENTRIES = f"entries AS (SELECT o_orderkey, {entry_columns(False)} FROM orders)"


def entries(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", *[
        c.strip() for c in _split_columns(entry_columns(True))])


def _split_columns(text: str) -> list[str]:
    out, depth, start, quoted = [], 0, 0, False
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "([":
            depth += 1
        elif not quoted and ch in ")]":
            depth -= 1
        elif not quoted and depth == 0 and ch == ",":
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def any_sql(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


KIND_BAD = f"({any_sql('lower(gdstype)', fl.INVALID_TYPES)} OR NOT {any_sql('lower(gdstype)', fl.VALID_TYPES)})"
REASON = f"""CASE WHEN entrytype <> 'GSE' OR NOT starts_with(accession, 'GSE') THEN 'entry_type'
  WHEN NOT contains(lower(taxon), 'homo sapiens') THEN 'organism' WHEN {KIND_BAD} THEN 'data_type'
  WHEN n_samples < 20 THEN 'too_few_samples' WHEN subseries > 0 THEN 'superseries' END"""
TEXT = "lower(title || ' ' || summary)"


@query("p1_entry_validity", f"WITH {ENTRIES} SELECT accession, {REASON} AS reason FROM entries")
def p1_entry_validity(spark, sf):
    return entries(spark, sf).select("accession", fl.first_failing(fl.catalogue_rules()).alias("reason"))


@query("p2_single_entry_validity", f"""WITH {ENTRIES} SELECT accession, CASE WHEN NOT contains(lower(taxon), 'homo sapiens') THEN 'organism'
  WHEN {KIND_BAD} THEN 'data_type' WHEN n_samples < 10 THEN 'too_few_samples' END AS reason FROM entries""")
def p2_single_entry_validity(spark, sf):
    return entries(spark, sf).select("accession", fl.first_failing(fl.single_entry_rules()).alias("reason"))


@query("p4_keyword_texts", f"""WITH {ENTRIES} SELECT accession, {any_sql(TEXT, fl.TITLE_KEYWORDS)} AS relevant,
  {any_sql(TEXT, fl.EXCLUDED_KEYWORDS)} AS excluded FROM entries""")
def p4_keyword_texts(spark, sf):
    return entries(spark, sf).select(
        "accession", fl.has_keyword("title", "summary", fl.TITLE_KEYWORDS).alias("relevant"),
        fl.has_keyword("title", "summary", fl.EXCLUDED_KEYWORDS).alias("excluded"))


@query("p5_rejection_counts", f"""WITH {ENTRIES} SELECT CASE WHEN {REASON} IS NOT NULL THEN 'invalid_metadata'
  WHEN {any_sql(TEXT, fl.EXCLUDED_KEYWORDS)} THEN 'excluded_keywords' WHEN NOT {any_sql(TEXT, fl.TITLE_KEYWORDS)} THEN 'non_disease_text'
  WHEN NOT has_matrix THEN 'missing_matrix' WHEN NOT has_platform THEN 'platform_unavailable' ELSE 'accepted' END AS reason, count(*) AS n
FROM entries GROUP BY 1""")
def p5_rejection_counts(spark, sf):
    return fl.rejection_counts(entries(spark, sf), fl.refresh_rules())


@query("p6_useful_symbols", """WITH s AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '---' WHEN 1 THEN ' Control ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE p_name END AS symbol FROM part)
SELECT p_partkey, symbol FROM s WHERE lower(trim(symbol)) NOT IN ('', '---', 'null', 'nan', 'coding', 'multiple_complex', 'multiple', 'complex', 'control', 'main')""")
def p6_useful_symbols(spark, sf):
    symbols = table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE p_partkey % 7 WHEN 0 THEN '---' WHEN 1 THEN ' Control ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE p_name END AS symbol")
    return fl.useful_symbols(symbols, "symbol")


@query("p7_numbers_only", """WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS text FROM lineitem)
SELECT l_orderkey, l_linenumber, TRY_CAST(text AS DOUBLE) AS value FROM c WHERE TRY_CAST(text AS DOUBLE) IS NOT NULL""")
def p7_numbers_only(spark, sf):
    cells = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS text")
    return fl.to_number(cells, "l_orderkey", "text")


IDS = r"""ids AS (SELECT DISTINCT c_mktsegment AS dataset, CASE c_mktsegment WHEN 'BUILDING' THEN CAST(c_custkey AS VARCHAR(20)) || '_at'
  WHEN 'MACHINERY' THEN 'ENSG' || CAST(c_custkey AS VARCHAR(20)) WHEN 'HOUSEHOLD' THEN CASE WHEN c_custkey % 12 = 0 THEN 'AFFX' ELSE 'GENE' END || CAST(c_custkey AS VARCHAR(20))
  WHEN 'FURNITURE' THEN 'TP' || CAST(c_custkey % 900 AS VARCHAR(20)) ELSE '?' || CAST(c_custkey AS VARCHAR(20)) END AS feature FROM customer)"""
PROFILE_SQL = IDS + r""",
m AS (SELECT dataset, regexp_matches(feature, '^[A-Za-z][A-Za-z0-9._-]{1,24}$') AS s, regexp_matches(feature, '^ENS[A-Z]*G[0-9]+(\.[0-9]+)?$') AS e,
  regexp_matches(feature, '^(ILMN_|AFFX|A_|cg|TC)|^[0-9]+$|[|:]|^[A-Za-z]{1,4}[0-9]{5,}$|_(at|s_at|x_at|st)$') AS p,
  regexp_matches(feature, '^(ILMN_|AFFX|A_|cg|TC|HTA)|[|:]|_(at|s_at|x_at|st)$') AS k FROM ids),
q AS (SELECT dataset, count(*) AS ids, avg(CAST(s AS INT)) AS s, avg(CAST(e AS INT)) AS e, avg(CAST(p AS INT)) AS p, avg(CAST(k AS INT)) AS k FROM m GROUP BY 1),
kd AS (SELECT *, CASE WHEN p >= 0.1 THEN 'probe' WHEN greatest(s, e) >= 0.6 THEN 'gene' WHEN p >= 0.05 THEN 'probe' ELSE 'unknown' END AS kind FROM q)"""


def identifiers(spark, sf):
    return table(spark, sf, "customer").selectExpr(*[c.strip() for c in _split_columns(
        IDS[IDS.index("DISTINCT") + 8:IDS.rindex("FROM customer")])])


@query("p8_identifier_profile", f"WITH {PROFILE_SQL} SELECT dataset, ids, round(s, 6) AS symbol, round(e, 6) AS ensembl, round(p, 6) AS probe, kind FROM kd")
def p8_identifier_profile(spark, sf):
    out = fl.identifier_profile(identifiers(spark, sf), by=["dataset"])
    return out.select("dataset", "ids", r6("symbol", "symbol"), r6("ensembl", "ensembl"), r6("probe", "probe"), "kind")


@query("p20_mapping_decision", f"""WITH {PROFILE_SQL} SELECT dataset, round(k, 6) AS marked, CASE WHEN kind = 'gene' AND k >= 0.08 THEN CASE WHEN dataset <> 'HOUSEHOLD' THEN 'map' ELSE 'stop' END
  WHEN kind = 'gene' THEN 'keep' WHEN dataset <> 'HOUSEHOLD' THEN 'map' ELSE 'stop' END AS decision FROM kd""")
def p20_mapping_decision(spark, sf):
    profile = fl.identifier_profile(identifiers(spark, sf), by=["dataset"])
    return fl.mapping_decision(profile, F.col("dataset") != "HOUSEHOLD").select("dataset", r6("marked", "marked"), "decision")


@query("p12_pattern_filter", r"""SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'ECONOMY') AND regexp_matches(p_name, '(?i)(ring|bolt)') AND NOT regexp_matches(p_name, '(?i)(red)')""")
def p12_pattern_filter(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("class_a"), F.col("p_brand").alias("class_b"),
                                           F.col("p_name").alias("name"))
    return fl.pathway_filter(rows, class_a=["SMALL", "ECONOMY"], include=["ring", "bolt"], exclude=["red"]).select("p_partkey")


@query("p14_search", """SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')""")
def p14_search(spark, sf):
    return fl.search(table(spark, sf, "documents"), "License", ["text", "source"]).select("doc_id")


@query("p15_sized_sets", f"WITH {SETS} SELECT set_id, count(*) AS size FROM sets GROUP BY 1 HAVING count(*) >= 5")
def p15_sized_sets(spark, sf):
    return fl.sized_sets(sets(spark, sf), 5)


@query("p16_focus_sets", f"""WITH {SCORES}, m AS (SELECT set_id, avg(es) AS v FROM scores GROUP BY 1),
l AS (SELECT set_id, 0 AS list_no, row_number() OVER (ORDER BY v DESC, set_id) AS place FROM m QUALIFY place <= 5
  UNION ALL SELECT set_id, 1, row_number() OVER (ORDER BY v, set_id DESC) AS place FROM m QUALIFY place <= 5
  UNION ALL SELECT set_id, 2, row_number() OVER (ORDER BY set_id) AS place FROM m WHERE {SYSTEM} = 'S1' QUALIFY place <= 4
  UNION ALL SELECT set_id, 3, row_number() OVER (ORDER BY set_id) AS place FROM m QUALIFY place <= 10),
f AS (SELECT set_id, min(list_no * 100 + place) AS o FROM l GROUP BY 1)
SELECT set_id, CAST(o // 100 AS INT) AS list_no, CAST(o % 100 AS INT) AS place FROM f ORDER BY o, set_id LIMIT 16""")
def p16_focus_sets(spark, sf):
    means = scores(spark, sf).groupBy("set_id").agg(F.avg("es").alias("v"))
    ordered = [
        (means, [F.col("v").desc(), F.col("set_id")], 5), (means, [F.col("v"), F.col("set_id").desc()], 5),
        (means.filter(system_of() == "S1"), [F.col("set_id")], 4), (means, [F.col("set_id")], 10),
    ]
    lists = None
    for i, (rows, order, n) in enumerate(ordered):
        part = fl.top_rows(rows.withColumn("list_no", F.lit(i)), ["list_no"], order, n).select("set_id", "list_no", "place")
        lists = part if lists is None else lists.unionByName(part)
    return fl.focus_sets(lists)


@query("p18_column_report", """SELECT 'c_custkey' AS "column", true AS present, true AS fits, count_if(c_custkey IS NULL) AS nulls, count(*) - count(DISTINCT c_custkey) AS duplicates, 'PASS' AS verdict FROM customer
UNION ALL SELECT 'c_name', true, true, count_if(c_name IS NULL), 0, 'PASS' FROM customer
UNION ALL SELECT 'c_acctbal', true, true, count_if(c_acctbal IS NULL), 0, 'PASS' FROM customer
UNION ALL SELECT 'c_mktsegment', true, false, count_if(c_mktsegment IS NULL), 0, 'FAIL' FROM customer
UNION ALL SELECT 'c_phone', false, false, 0, 0, 'FAIL'""")
def p18_column_report(spark, sf):
    required = {"c_custkey": "number", "c_name": "text", "c_acctbal": "number", "c_mktsegment": "number", "c_phone": "text"}
    return fl.column_report(table(spark, sf, "customer"), required, "c_custkey")


@query("p21_successful_runs", """SELECT event_id FROM events WHERE event_type <> 'error' AND props IS NOT NULL AND props <> '{}' AND value IS NOT NULL""")
def p21_successful_runs(spark, sf):
    from tallyloom.sources.tables import successful_runs
    runs = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.array(F.lit("failed"))).otherwise(F.array()).alias("errors"),
        F.col("props").alias("classification_results"), F.col("value").cast("string").alias("system_scores"))
    return successful_runs(runs).select("event_id")


PATHS = """paths AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 7 WHEN 0 THEN ' Cytokine signaling' WHEN 1 THEN ' toll-like receptor' ELSE '' END AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'Metabolism' ELSE p_type END AS class_a, CASE p_partkey % 11 WHEN 0 THEN 'Immune system' ELSE p_brand END AS class_b FROM part)"""
IMMUNE = "immune|immunity|immunodeficiency|complement|antigen|antibody|cytokine|chemokine|toll-like|nf-kappa|inflammatory"


@query("p13_pathway_classes", f"""WITH {PATHS} SELECT id, 'metabolism' AS kind FROM paths WHERE class_a = 'Metabolism'
UNION ALL SELECT id, 'immune' FROM paths WHERE regexp_matches(lower(name || ' ' || class_b), '{IMMUNE}')""")
def p13_pathway_classes(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "p_name || CASE p_partkey % 7 WHEN 0 THEN ' Cytokine signaling' WHEN 1 THEN ' toll-like receptor' ELSE '' END AS name",
        "CASE p_partkey % 3 WHEN 0 THEN 'Metabolism' ELSE p_type END AS class_a", "CASE p_partkey % 11 WHEN 0 THEN 'Immune system' ELSE p_brand END AS class_b")
    return fl.metabolism_pathways(rows).select("id", F.lit("metabolism").alias("kind")).unionByName(
        fl.immune_pathways(rows).select("id", F.lit("immune").alias("kind")))


@query("j1_mapped_means", """SELECT l_suppkey AS sample, p_type AS feature, round(avg(ln(l_extendedprice)), 6) AS value
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def j1_mapped_means(spark, sf):
    return mapped(spark, sf, "mean")


@query("j1_mapped_medians", """SELECT l_suppkey AS sample, p_type AS feature, round(median(ln(l_extendedprice)), 6) AS value
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def j1_mapped_medians(spark, sf):
    return mapped(spark, sf, "median")


@query("j1_mapped_maxima", """SELECT l_suppkey AS sample, p_type AS feature, round(max(ln(l_extendedprice)), 6) AS value
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def j1_mapped_maxima(spark, sf):
    return mapped(spark, sf, "max")


def mapped(spark, sf, method):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("feature"),
                                                F.ln("l_extendedprice").alias("value"))
    mapping = table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), F.col("p_type").alias("target"))
    out = jn.map_features(lines, mapping, ["sample"], method=method)
    return out.withColumn("value", F.round("value", 6))


@query("j2_one_to_many", """WITH f AS (SELECT DISTINCT p_partkey, unnest([p_type, p_brand]) AS feature FROM part)
SELECT l_suppkey AS sample, feature, round(avg(ln(l_extendedprice)), 6) AS value FROM lineitem JOIN f ON l_partkey = p_partkey GROUP BY 1, 2""")
def j2_one_to_many(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("feature"),
                                                F.ln("l_extendedprice").alias("value"))
    mapping = table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), F.array("p_type", "p_brand").alias("targets"))
    return jn.map_features_or_keep(lines, mapping, ["sample"]).withColumn("value", F.round("value", 6))


@query("j3_set_members", """SELECT DISTINCT p_type AS set_id, l_suppkey AS feature FROM part JOIN lineitem ON p_partkey = l_partkey""")
def j3_set_members(spark, sf):
    terms = table(spark, sf, "part").select(F.col("p_type").alias("set_id"), F.col("p_partkey").alias("term_id"))
    features = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("term_id"), F.col("l_suppkey").alias("feature"))
    return jn.set_members(terms, features)


@query("j5_scores_groups_clinical", """SELECT o_orderkey, c_mktsegment, n_name, r_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def j5_scores_groups_clinical(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("o_orderkey", "c_mktsegment", "n_name", "r_name", "o_totalprice"))


@query("j6_metadata_or_unknown", """SELECT doc_id, lang, coalesce(CAST(quality AS VARCHAR), 'Unknown') AS quality FROM documents LEFT JOIN labels USING (doc_id)""")
def j6_metadata_or_unknown(spark, sf):
    marks = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return jn.enrich(table(spark, sf, "documents").select("doc_id", "lang"), marks, "doc_id", ["quality"])


@query("j7_unlabelled", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j7_unlabelled(spark, sf):
    return jn.without(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


VERSIONS = """cur AS (SELECT o_orderkey AS id, o_orderstatus AS label, o_totalprice / 1000 AS s FROM orders WHERE o_orderkey % 3 <> 0),
prev AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS label, o_totalprice / 1000 - o_custkey % 3 + 1 AS s FROM orders WHERE o_orderkey % 4 <> 0),
cmp AS (SELECT id, CASE WHEN p.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'removed' WHEN c.label <> p.label THEN 'changed' ELSE 'same' END AS state,
  c.s - p.s AS d FROM cur c FULL JOIN prev p USING (id))"""


def versions(spark, sf):
    orders = table(spark, sf, "orders")
    cur = orders.filter("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS id", "o_orderstatus AS label", "o_totalprice / 1000 AS s")
    prev = orders.filter("o_orderkey % 4 <> 0").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS label",
        "o_totalprice / 1000 - o_custkey % 3 + 1 AS s")
    return cur, prev


@query("j8_version_changes", f"WITH {VERSIONS} SELECT id, state, round(d, 6) AS score_change FROM cmp")
def j8_version_changes(spark, sf):
    out = jn.compare_versions(*versions(spark, sf), "id", "label", "s")
    return out.select("id", "state", r6("score_change", "score_change"))


@query("j8_version_summary", f"""WITH {VERSIONS} SELECT state, count(*) AS n, round(avg(round(d, 6)), 6) AS mean_score_change, coalesce(count_if(round(d, 6) > 0), 0) AS improved,
  coalesce(count_if(round(d, 6) < 0), 0) AS declined FROM cmp GROUP BY 1""")
def j8_version_summary(spark, sf):
    compared = jn.compare_versions(*versions(spark, sf), "id", "label", "s")
    out = jn.version_summary(compared.withColumn("score_change", F.round("score_change", 6)))
    return out.withColumn("mean_score_change", F.round("mean_score_change", 6))


@query("j8_distribution_change", f"""WITH {VERSIONS}, a AS (SELECT label, count(*) AS n FROM cur GROUP BY 1), b AS (SELECT label, count(*) AS n FROM prev GROUP BY 1)
SELECT label, coalesce(a.n, 0) AS n_now, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) - coalesce(b.n, 0) AS n_change,
  round(coalesce(a.n, 0) * 1.0 / (SELECT count(*) FROM cur) - coalesce(b.n, 0) * 1.0 / (SELECT count(*) FROM prev), 6) AS share_change FROM a FULL JOIN b USING (label)""")
def j8_distribution_change(spark, sf):
    cur, prev = versions(spark, sf)
    return jn.distribution_change(cur, prev, "label").withColumn("share_change", F.round("share_change", 6))


@query("j12_upsert", """SELECT o_orderkey AS id, 'new' AS v FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'old' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0""")
def j12_upsert(spark, sf):
    orders = table(spark, sf, "orders")
    old = orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("v"))
    new = orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("v"))
    return jn.upsert(old, new, "id")


@query("j13_link_by_name", r"""SELECT page_id, nullif(regexp_extract(url, 'example\.([a-z]+)', 1), '') AS tld,
  CASE regexp_extract(url, 'example\.([a-z]+)', 1) WHEN 'com' THEN 0 WHEN 'net' THEN 1 END AS rank FROM pages""")
def j13_link_by_name(spark, sf):
    domains = table(spark, sf, "region").filter("r_regionkey < 2").selectExpr(
        "CASE r_regionkey WHEN 0 THEN 'com' ELSE 'net' END AS tld", "r_regionkey AS rank")
    files = table(spark, sf, "pages").select("page_id", "url")
    return jn.link_by_pattern(files, "url", r"example\.([a-z]+)", domains, "tld").select("page_id", "tld", "rank")


@query("j13_link_or_any", r"""SELECT page_id, CASE regexp_extract(url, 'example\.([a-z]+)', 1) WHEN 'net' THEN 'net' ELSE 'com' END AS tld,
  CASE regexp_extract(url, 'example\.([a-z]+)', 1) WHEN 'net' THEN 1 ELSE 0 END AS rank, regexp_extract(url, 'example\.([a-z]+)', 1) IN ('com', 'net') AS matched FROM pages""")
def j13_link_or_any(spark, sf):
    domains = table(spark, sf, "region").filter("r_regionkey < 2").selectExpr(
        "CASE r_regionkey WHEN 0 THEN 'com' ELSE 'net' END AS tld", "r_regionkey AS rank")
    files = table(spark, sf, "pages").select("page_id", "url")
    return jn.link_by_pattern(files, "url", r"example\.([a-z]+)", domains, "tld", any_other=True).select("page_id", "tld", "rank", "matched")


@query("j14_first_known", """SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, d.source) AS name FROM documents d LEFT JOIN labels l USING (doc_id)""")
def j14_first_known(spark, sf):
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id", F.lit("good").alias("name"))
    docs = table(spark, sf, "documents")
    return jn.first_known(docs.select("doc_id"), [good, docs.select("doc_id", F.col("source").alias("name"))], "doc_id", ["name"])


@query("j15_positional_mapping", """SELECT o_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber <= 3 THEN 'part ' || l_linenumber END, 'sample') AS label
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def j15_positional_mapping(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    names = table(spark, sf, "region").filter("r_regionkey < 3").select(
        (F.col("r_regionkey") + 1).alias("l_linenumber"), F.concat(F.lit("part "), (F.col("r_regionkey") + 1).cast("string")).alias("label"))
    known = table(spark, sf, "orders").select("o_orderkey")
    return jn.enrich(lines.join(known, "o_orderkey"), names, "l_linenumber", ["label"], "sample").select(
        "o_orderkey", "l_linenumber", "label")


@query("f18_platform_ids", f"""WITH {ENTRIES}, p AS (SELECT accession, list_filter(list_transform(string_split(gpl, ';'), lambda x: upper(trim(x))), lambda x: x <> '') AS ids FROM entries)
SELECT accession, array_to_string(list_transform(ids, lambda x: CASE WHEN starts_with(x, 'GPL') THEN substr(x, 4) ELSE x END), ';') AS bare,
  array_to_string(list_transform(ids, lambda x: CASE WHEN starts_with(x, 'GPL') THEN x ELSE 'GPL' || x END), ';') AS full FROM p""")
def f18_platform_ids(spark, sf):
    return entries(spark, sf).select("accession", ct.bare_platforms(F.col("gpl")).alias("bare"),
                                     F.array_join(ct.platform_ids(F.col("gpl")), ";").alias("full"))


DISEASE_SQL = "CASE " + " ".join(
    f"WHEN {any_sql(TEXT, words)} THEN '{name}'" for name, words in ct.DISEASE_WORDS) + " ELSE 'other' END"


@query("f19_disease_types", f"WITH {ENTRIES} SELECT accession, {DISEASE_SQL} AS disease_type FROM entries")
def f19_disease_types(spark, sf):
    return entries(spark, sf).select("accession", ct.disease_type("title", "summary").alias("disease_type"))


ROWS_SQL = f"""{ENTRIES}, d AS (SELECT *, {DISEASE_SQL} AS disease_type FROM entries),
rw AS (SELECT accession AS dataset_id, substr(title, 1, 120) AS name, disease_type,
  CASE disease_type WHEN 'cancer' THEN 'subtype_comparison' WHEN 'repair' THEN 'time_series' ELSE 'case_control' END AS expected_strategy,
  CASE disease_type {' '.join(f"WHEN '{k}' THEN '{';'.join(v)}'" for k, v in ct.SYSTEMS_BY_DISEASE.items())} ELSE 'System A;System B' END AS expected_systems,
  substr(summary, 1, 300) AS description, n_samples FROM d)"""


@query("f20_strategies_and_systems", f"WITH {ROWS_SQL} SELECT dataset_id, disease_type, expected_strategy, expected_systems FROM rw")
def f20_strategies_and_systems(spark, sf):
    return ct.catalogue_rows(entries(spark, sf)).select("dataset_id", "disease_type", "expected_strategy", "expected_systems")


@query("f21_catalogue_rows", f"WITH {ROWS_SQL} SELECT dataset_id, name, disease_type, description, n_samples FROM rw")
def f21_catalogue_rows(spark, sf):
    return ct.catalogue_rows(entries(spark, sf)).select("dataset_id", "name", "disease_type", "description", "n_samples")


@query("t41_next_dataset", f"""WITH {ROWS_SQL}, k AS (SELECT *, CAST(substr(dataset_id, 4) AS BIGINT) AS no FROM rw),
done AS (SELECT * FROM k WHERE no % 1000 = 3), cov AS (SELECT s, count(*) AS n FROM (SELECT unnest(string_split(expected_systems, ';')) AS s FROM done) GROUP BY 1),
types AS (SELECT DISTINCT disease_type FROM done), open AS (SELECT * FROM k WHERE dataset_id NOT IN (SELECT dataset_id FROM done)),
sy AS (SELECT dataset_id, unnest(string_split(expected_systems, ';')) AS s FROM open),
g AS (SELECT dataset_id, sum(CASE WHEN n IS NULL THEN 2 WHEN n < 2 THEN 1 ELSE 0 END) AS g FROM sy LEFT JOIN cov USING (s) GROUP BY 1)
SELECT dataset_id, CAST(coalesce(g, 0) + CASE WHEN disease_type NOT IN (SELECT disease_type FROM types) THEN 3 ELSE 0 END
  + CASE WHEN disease_type IN ('cancer', 'neurodegenerative', 'metabolic') THEN 1 ELSE 0 END AS BIGINT) AS score FROM open JOIN g USING (dataset_id)""")
def t41_next_dataset(spark, sf):
    rows = ct.catalogue_rows(entries(spark, sf)).withColumn("systems", F.split("expected_systems", ";"))
    done = rows.filter(F.substring("dataset_id", 4, 20).cast("long") % 1000 == 3)
    return ct.next_dataset_scores(rows, done.select("dataset_id", "disease_type", F.col("systems").alias("top_systems"))).select(
        "dataset_id", "score")
