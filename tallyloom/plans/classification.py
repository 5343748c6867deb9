"""Term classification over entries derived from the orders, and over whole
documents, with the reports that read it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import term_rules as tr
from tallyloom.operators import aggregates as agg
from tallyloom.operators import classification as cl
from tallyloom.plans.catalogue import one_of
from tallyloom.plans.common import r6
from tallyloom.plans.registry import query
from tallyloom.session import cut, spread, table

PHRASES = [w for s in cl.SYSTEMS for w in tr.SYSTEM_WORDS[s]][::3]
SIDES = ["killing of", "repair of", "maintenance of", "clearance and assembly of", "suppression of", "IL-6 dependent",
         "resolution of", "formation of", "recognition of", "response to wound by", "death and healing in", "regulation of"]
TAILS = ["energy metabolism", "pathogen infection", "tissue repair", "inflammatory response", "immune defense", "nothing else",
         "structural integrity", "growth"]


def entry_sql(spark: bool) -> dict[str, str]:
    div = "div" if spark else "//"
    general = one_of(tr.GENERAL_NAMES, f"o_orderkey {div} 53", spark)
    return {
        "id": "o_orderkey",
        "name": f"CASE WHEN o_orderkey % 53 = 0 THEN {general} ELSE {one_of(SIDES, 'o_orderkey', spark)} || ' ' || "
                f"{one_of(PHRASES, f'o_orderkey * 7 + o_custkey', spark)} END",
        "definition": f"CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS VARCHAR(9)) WHEN o_orderkey % 3 = 1 THEN {one_of(TAILS, 'o_custkey', spark)} "
                      f"ELSE {one_of(PHRASES, 'o_custkey', spark)} || ' with ' || {one_of(TAILS, 'o_orderkey', spark)} END",
        "source": "CASE WHEN o_orderkey % 10 = 0 THEN 'KEGG' ELSE 'GO' END",
        "namespace": "CASE WHEN o_orderkey % 10 = 0 THEN 'pathway' WHEN o_orderkey % 4 = 1 THEN 'molecular_function' ELSE 'biological_process' END",
    }


def entries(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in entry_sql(True).items()])
    return spread(rows, "id")


TERMS = "terms AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in entry_sql(False).items()) + " FROM orders)"
DOCS = "terms AS (SELECT doc_id AS id, '' AS name, text AS definition, source, lang AS namespace FROM documents)"


def lst(words) -> str:
    return "[" + ", ".join("'" + w.lower().replace("'", "''") + "'" for w in dict.fromkeys(x.lower() for x in words)) + "]"


def any_in(words) -> str:
    return f"list_has_any(f, {lst(words)})"


def count_in(words) -> str:
    return f"len(list_filter({lst(words)}, lambda w: list_contains(f, w)))"


def weights_in(weights) -> str:
    return " + ".join(f"CASE WHEN {any_in(k.split('|'))} THEN {w} ELSE 0.0 END" for k, w in weights.items())


def best_in(counts: dict[str, str]) -> str:
    """First label whose count equals the greatest positive count."""
    top = f"greatest({', '.join(counts.values())})"
    return "CASE WHEN " + top + " <= 0 THEN NULL " + " ".join(f"WHEN {c} = {top} THEN '{k}'" for k, c in counts.items()) + " END"


STANDARD_PATH = """CASE len(systems) WHEN 0 THEN 'no_pattern_match > default_to_system_0' WHEN 1 THEN 'pattern_matching > single_match_' || std ELSE 'pattern_matching > priority_rule_' || std END"""
PATH = f"""CASE kind WHEN 'general' THEN 'excluded_general_term' WHEN 'complex' THEN CASE
    WHEN d > c * 1.5 THEN 'complex_pathway > destructive_dominant > ' || CASE WHEN o_threat_elimination OR o_immune_defense THEN 'system_B' ELSE 'system_A' END
    WHEN c > d * 1.5 THEN 'complex_pathway > constructive_dominant > ' || CASE WHEN o_tissue_repair OR o_structural_maintenance THEN 'system_A' WHEN o_metabolic_support THEN 'system_C' ELSE 'system_A_default' END
    WHEN objective IS NULL THEN {STANDARD_PATH} || ' > balanced_pathway_standard_classification' ELSE 'complex_pathway > balanced > objective_based > system_' || system END || ' > complex_pathway_analysis'
  ELSE {STANDARD_PATH} || CASE WHEN kind <> 'inflammation' OR about IS NULL THEN '' WHEN about = 'threat' AND std <> 'B' THEN ' > inflammation_threat_clearance_rule' WHEN about = 'tolerance' THEN ' > inflammation_tolerance_rule'
    WHEN about = 'resolution' THEN ' > inflammation_resolution_rule' WHEN about = 'repair' AND std <> 'A' THEN ' > inflammation_repair_rule' ELSE '' END END"""


def classified_ctes(terms: str) -> str:
    vocabulary = cl.Rules().vocabulary()
    pick = lambda col: "CASE " + col + " " + " ".join(f"WHEN '{s}' THEN sub_{s}" for s in tr.SUBSYSTEM_WORDS) + " END"
    subs = ", ".join(f"{best_in({c: count_in(w) for c, w in subs.items()})} AS sub_{s}" for s, subs in tr.SUBSYSTEM_WORDS.items())
    by_priority = sorted(tr.PRIORITY, key=tr.PRIORITY.get)
    return f"""{terms},
fnd AS (SELECT *, list_filter({lst(vocabulary)}, lambda w: contains(lower(concat_ws(' ', name, definition)), w)) AS f FROM terms),
wd AS (SELECT id, name, definition, source, namespace, lower(trim(name)) IN ({', '.join(f"'{n}'" for n in tr.GENERAL_NAMES)}) AS general,
  {any_in(tr.DESTRUCTIVE_WORDS)} AND {any_in(tr.CONSTRUCTIVE_WORDS)} AS cplx,
  {weights_in(tr.DESTRUCTIVE_WEIGHTS)} AS d, {weights_in(tr.CONSTRUCTIVE_WEIGHTS)} AS c,
  CASE {' '.join(f"WHEN {any_in(w)} THEN '{p}'" for p, w in tr.POLARITY_WORDS.items())} END AS pol,
  CASE {' '.join(f"WHEN {any_in(w)} THEN '{k}'" for k, w in tr.INFLAMMATION_WORDS.items())} END AS about,
  list_filter([{', '.join(f"CASE WHEN {any_in(tr.SYSTEM_WORDS[s])} THEN '{s}' END" for s in cl.SYSTEMS)}], lambda x: x IS NOT NULL) AS systems,
  {best_in({o: count_in(w) for o, w in tr.OBJECTIVE_WORDS.items()})} AS objective,
  {', '.join(f"{any_in(w)} AS o_{o}" for o, w in tr.OBJECTIVE_WORDS.items())}, {subs} FROM fnd),
st AS (SELECT *, CASE {' '.join(f"WHEN list_contains(systems, '{s}') THEN '{s}'" for s in by_priority)} ELSE '0' END AS std,
  CASE len(systems) WHEN 0 THEN 0.1 WHEN 1 THEN 0.9 ELSE 0.8 END AS stdc,
  CASE WHEN general THEN 'general' WHEN cplx THEN 'complex' WHEN pol IS NOT NULL THEN 'inflammation' ELSE 'standard' END AS kind FROM wd),
dc AS (SELECT *, CASE kind WHEN 'general' THEN '0' WHEN 'complex' THEN CASE
    WHEN d > c * 1.5 THEN CASE WHEN o_threat_elimination OR o_immune_defense THEN 'B' ELSE 'A' END
    WHEN c > d * 1.5 THEN CASE WHEN o_tissue_repair OR o_structural_maintenance THEN 'A' WHEN o_metabolic_support THEN 'C' ELSE 'A' END
    WHEN objective IS NULL THEN std WHEN objective IN ('threat_elimination', 'immune_defense') THEN 'B' WHEN objective = 'metabolic_support' THEN 'C' ELSE 'A' END
  WHEN 'inflammation' THEN CASE WHEN about IN ('threat', 'tolerance') THEN 'B' WHEN about IN ('resolution', 'repair') THEN 'A' ELSE std END ELSE std END AS system,
  CASE kind WHEN 'general' THEN 0.9 WHEN 'complex' THEN 0.8 * CASE
    WHEN d > c * 1.5 THEN CASE WHEN o_threat_elimination OR o_immune_defense THEN 0.8 ELSE 0.6 END
    WHEN c > d * 1.5 THEN CASE WHEN o_tissue_repair OR o_structural_maintenance THEN 0.8 WHEN o_metabolic_support THEN 0.7 ELSE 0.6 END
    WHEN objective IS NULL THEN stdc ELSE 0.7 END ELSE stdc END AS confidence FROM st),
cls AS (SELECT id, name, definition, source, namespace, kind, system, CAST(confidence AS DOUBLE) AS confidence, systems, d, c,
  CASE WHEN general THEN NULL WHEN kind = 'inflammation' AND about = 'tolerance' THEN 'B3' WHEN kind = 'inflammation' AND about = 'resolution' THEN 'A4' ELSE {pick('system')} END AS subsystem,
  CASE WHEN NOT general THEN pol END AS polarity, CASE WHEN general THEN '0' ELSE array_to_string(systems, ',') END AS all_systems,
  CASE WHEN kind = 'inflammation' THEN about END AS about, std, {PATH} AS path FROM dc)"""


CLASSIFIED = classified_ctes(TERMS)


def classified(spark, sf):
    """The result table the reports read.

    It is written first, as in production: a report's filter on a derived label
    would otherwise be pushed below the word search and repeat it.
    """
    return cut(cl.classify(entries(spark, sf)))


def shown(df, *extra):
    return df.select("id", "kind", "system", "subsystem", F.array_join("all_systems", ",").alias("all_systems"), "polarity",
                     r6("confidence", "confidence"), *extra)


@query("c2_term_classification", f"""WITH {CLASSIFIED} SELECT id, kind, system, subsystem, all_systems, polarity, round(confidence, 6) AS confidence FROM cls""")
def c2_term_classification(spark, sf):
    return shown(cl.classify(entries(spark, sf)))


@query("c2_document_classification", f"""WITH {classified_ctes(DOCS)} SELECT id, kind, system, subsystem, all_systems, polarity, round(confidence, 6) AS confidence FROM cls""")
def c2_document_classification(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("name"), F.col("text").alias("definition"))
    return shown(cl.classify(spread(docs, "id")))


@query("c6_two_sided_scores", f"""WITH {CLASSIFIED} SELECT id, CAST(d AS DOUBLE) AS destructive_score, CAST(c AS DOUBLE) AS constructive_score FROM cls WHERE kind = 'complex'""")
def c6_two_sided_scores(spark, sf):
    return classified(spark, sf).filter("kind = 'complex'").select("id", "destructive_score", "constructive_score")


@query("c8_decision_steps", f"""WITH {CLASSIFIED} SELECT CASE WHEN kind = 'general' THEN 'excluded_general_term' WHEN kind = 'complex' THEN 'complex_pathway_analysis'
  WHEN about = 'threat' AND std <> 'B' THEN 'inflammation_threat_clearance_rule' WHEN about = 'tolerance' THEN 'inflammation_tolerance_rule'
  WHEN about = 'resolution' THEN 'inflammation_resolution_rule' WHEN about = 'repair' AND std <> 'A' THEN 'inflammation_repair_rule'
  WHEN len(systems) = 0 THEN 'default_to_system_0' WHEN len(systems) = 1 THEN 'single_match_' || std ELSE 'priority_rule_' || std END AS last_step, count(*) AS n
FROM cls GROUP BY 1""")
def c8_decision_steps(spark, sf):
    return classified(spark, sf).groupBy(F.element_at("path", -1).alias("last_step")).agg(F.count(F.lit(1)).alias("n"))


@query("c8_system_counts", f"WITH {CLASSIFIED} SELECT unnest(string_split(all_systems, ',')) AS system, count(*) AS n FROM cls WHERE all_systems <> '' GROUP BY 1")
def c8_system_counts(spark, sf):
    return classified(spark, sf).select(F.explode("all_systems").alias("system")).groupBy("system").agg(
        F.count(F.lit(1)).alias("n"))


DETAIL = ", ".join(f"""{best_in({c: f"{count_in(w)} * {tr.SPECIFICITY[c]}" for c, w in subs.items()})} AS d_{s}""" for s, subs in tr.SUBSYSTEM_WORDS.items())
SUBWORDS = [w for subs in tr.SUBSYSTEM_WORDS.values() for ws in subs.values() for w in ws]


@query("c9_detailed_subsystems", f"""WITH {TERMS}, fnd AS (SELECT *, list_filter({lst(SUBWORDS)}, lambda w: contains(lower(concat_ws(' ', name, definition)), w)) AS f FROM terms),
x AS (SELECT id, list_extract(['A', 'B', 'C', 'D', 'E'], CAST(id % 5 AS INT) + 1) AS system, {DETAIL} FROM fnd)
SELECT id, CASE system {' '.join(f"WHEN '{s}' THEN d_{s}" for s in tr.SUBSYSTEM_WORDS)} END AS detailed_subsystem FROM x""")
def c9_detailed_subsystems(spark, sf):
    rows = entries(spark, sf).withColumn("system", F.expr("element_at(array('A', 'B', 'C', 'D', 'E'), CAST(id % 5 AS INT) + 1)"))
    return cl.detailed_subsystem(rows).select("id", "detailed_subsystem")


POLWORDS = [w for ws in tr.POLARITY_WORDS.values() for w in ws]


@query("c9_weighted_polarity", f"""WITH {TERMS}, fnd AS (SELECT *, list_filter({lst(POLWORDS)}, lambda w: contains(lower(concat_ws(' ', name, definition)), w)) AS f FROM terms)
SELECT id, {best_in({p: f"{count_in(tr.POLARITY_WORDS[p])} * {tr.POLARITY_WEIGHTS[p]}" for p in reversed(list(tr.POLARITY_WORDS))})} AS weighted_polarity FROM fnd""")
def c9_weighted_polarity(spark, sf):
    return cl.weighted_polarity(entries(spark, sf)).select("id", "weighted_polarity")


GRADED = [w for lists in tr.GRADED_WORDS.values() for ws in lists for w in ws]
SCORED = ", ".join(
    "struct_pack(label := '" + (k if k != "0" else "00") + "', score := (" + " + ".join(f"{count_in(ws)} * {w}" for ws, w in zip(lists, tr.GRADE_WEIGHTS))
    + f") * {tr.SYSTEM_WEIGHTS[k[0]]})" for k, lists in tr.GRADED_WORDS.items())
PROBS = f"""{TERMS}, fnd AS (SELECT id, list_filter({lst(GRADED)}, lambda w: contains(lower(name), w)) AS f FROM terms),
e AS (SELECT id, unnest([{SCORED}]) AS s FROM fnd), p AS (SELECT id, s.label AS label, s.score / sum(s.score) OVER (PARTITION BY id) AS p FROM e WHERE s.score > 0),
pr AS (SELECT id, label, p / sum(p) OVER (PARTITION BY id) AS probability FROM p WHERE round(p, 12) >= 0.1)"""


@query("c10_label_probabilities", f"WITH {PROBS} SELECT id, label, round(probability, 6) AS probability FROM pr")
def c10_label_probabilities(spark, sf):
    return cl.label_probabilities(entries(spark, sf), "id", "name").withColumn("probability", F.round("probability", 6))


@query("c10_label_statistics", f"""WITH {PROBS}, k AS (SELECT id, count(*) AS k FROM pr GROUP BY 1)
SELECT substr(label, 1, 1) AS system, round(sum(probability), 5) AS weight, (SELECT count(*) FROM k) AS classified,
  (SELECT count(*) FROM k WHERE k > 1) AS multi_label, (SELECT count(*) FROM terms) AS total FROM pr GROUP BY 1""")
def c10_label_statistics(spark, sf):
    rows = entries(spark, sf)
    out = cl.label_statistics(cl.label_probabilities(rows, "id", "name"), "id", rows.count())
    return out.withColumn("weight", F.round("weight", 5))


FIRST_SQL = "CASE " + " ".join(
    "WHEN (" + " OR ".join(f"contains(lower(name), '{w}')" for w in ws) + f") THEN '{k}'" for k, ws in tr.FIRST_MATCH_WORDS.items()) + " ELSE 'U' END"


@query("c11_first_match", f"WITH {TERMS} SELECT id, {FIRST_SQL} AS label FROM terms")
def c11_first_match(spark, sf):
    return entries(spark, sf).select("id", cl.first_match(F.col("name")).alias("label"))


def set_sql() -> str:
    tests: dict[str, list[str]] = {}
    for label, pattern, unless in tr.SET_RULES:
        t = f"regexp_matches(t, '{pattern}')"
        tests.setdefault(label, []).append(f"({t} AND NOT regexp_matches(t, '{unless}'))" if unless else t)
    for label, names in tr.SET_ANCESTORS.items():
        tests.setdefault(label, []).extend(f"contains(anc, '{n}')" for n in names)
    neural = "(" + " OR ".join(tests["D neuro"]) + ")"
    tests["C"].append(f"(regexp_matches(t, '{tr.SET_TRANSPORT}') AND NOT {neural})")
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(tests[k])} THEN '{k}' END" for k in tr.SET_PRIORITY) + "], lambda x: x IS NOT NULL)"


ANCESTORS = ["Immune system process", "metabolic process", "wound healing", "cellular process"]


@query("c12_set_labels", rf"""WITH {TERMS}, a AS (SELECT id, lower(concat_ws(' ', name, definition)) AS t, lower({one_of(ANCESTORS, 'o_orderkey // 11', False).replace('o_orderkey', 'id')}) AS anc FROM terms),
l AS (SELECT id, t, {set_sql()} AS labels FROM a)
SELECT id, array_to_string(labels, ',') AS labels, CASE WHEN len(labels) > 0 THEN labels[1] WHEN regexp_matches(t, '(regulation|signaling)') THEN 'General Regulation' ELSE 'General Process' END AS "primary" FROM l""")
def c12_set_labels(spark, sf):
    named = entries(spark, sf).withColumn(
        "ancestor_names", F.array(F.expr(one_of(ANCESTORS, "id div 11"))))
    out = cl.set_labels(named, "name", "definition", "ancestor_names")
    return out.select("id", F.array_join("labels", ",").alias("labels"), "primary")


@query("c13_result_table", f"""WITH {CLASSIFIED} SELECT CASE WHEN source = 'KEGG' THEN 'KEGG:' ELSE 'GO:' END || CAST(id AS VARCHAR) AS id, name, source, system, subsystem, all_systems, polarity,
  round(confidence, 6) AS confidence FROM cls WHERE namespace <> 'molecular_function'""")
def c13_result_table(spark, sf):
    rows = entries(spark, sf).filter("namespace <> 'molecular_function'")
    out = cl.classify(rows)
    return out.select(F.concat("source", F.lit(":"), F.col("id").cast("string")).alias("id"), "name", "source", "system", "subsystem",
                      F.array_join("all_systems", ",").alias("all_systems"), "polarity", r6("confidence", "confidence"))


SCOPES = [("system", k, w) for k, w in tr.SYSTEM_WORDS.items()] + [("subsystem", c, w) for subs in tr.SUBSYSTEM_WORDS.values() for c, w in subs.items()] + [
    ("polarity", p, w) for p, w in tr.POLARITY_WORDS.items()]


@query("c1_matched_patterns", f"""WITH {TERMS}, x AS (SELECT id, lower(concat_ws(' ', name, definition)) AS t FROM terms),
m AS (SELECT id, unnest([{", ".join(f"struct_pack(scope := '{s}', code := '{c}', ws := list_filter({lst(w)}, lambda w: contains(t, w)))" for s, c, w in SCOPES)}]) AS m FROM x)
SELECT id, m.scope AS scope, m.code AS code, unnest(m.ws) AS pattern FROM m""")
def c1_matched_patterns(spark, sf):
    return cl.pattern_matches(entries(spark, sf), "id")


OBSOLETE = "o_orderkey % 17 = 3"
FULL_TERMS = f"""terms AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, name, CASE WHEN source = 'KEGG' THEN coalesce(definition, '') ELSE definition END AS definition, source, namespace
  FROM (SELECT *, {', '.join(f"{e} AS {n}" for n, e in entry_sql(False).items() if n != "id")} FROM orders) WHERE source = 'KEGG' OR (namespace = 'biological_process' AND NOT {OBSOLETE}))"""
DETAIL_CASE = lambda i: "CASE subsystem " + " ".join(f"WHEN '{c}' THEN '{t[i]}'" for c, t in tr.SUBCATEGORY_TEXTS.items()) + " ELSE '' END"
STAMP, VERSION = "2025-01-01 00:00:00", "v8.0"


@query("c13_delivered_table", f"""WITH {classified_ctes(FULL_TERMS)} SELECT id AS "ID", name AS "Name", definition AS "Definition", source AS "Source", namespace AS "Namespace", system AS "Primary_System",
  subsystem AS "Subcategory_Code", {DETAIL_CASE(0)} AS "Subcategory_Name", {DETAIL_CASE(1)} AS "Subcategory_Description", replace(all_systems, ',', ', ') AS "All_Systems",
  coalesce(polarity, '') AS "Inflammation_Polarity", round(confidence, 6) AS "Confidence_Score", path AS "Decision_Path", '{STAMP}' AS "Classification_Date", '{VERSION}' AS "Version" FROM cls""")
def c13_delivered_table(spark, sf):
    """All fifteen columns, of process terms that are not obsolete and of all pathways."""
    rows = entries(spark, sf)
    terms = rows.filter("source = 'GO'").withColumn("is_obsolete", F.expr(OBSOLETE.replace("o_orderkey", "id")))
    pathways = rows.filter("source = 'KEGG'").withColumnRenamed("definition", "description")
    out = cl.result_table(cl.classify(cl.entries_to_classify(terms, pathways)), STAMP, VERSION)
    return out.withColumn("Confidence_Score", F.round("Confidence_Score", 6))


# a term's parents are the entries with half and a third of its number, as far as they exist
TERM_EDGES = f"""{TERMS}, e AS (SELECT x.id AS child, p.id AS parent FROM (SELECT id, id // 2 AS up FROM terms UNION SELECT id, id // 3 FROM terms) x JOIN terms p ON p.id = x.up WHERE x.id <> p.id),
clo AS (SELECT child AS node, parent AS ancestor, 1 AS distance FROM e UNION SELECT w.node, e.parent, w.distance + 1 FROM clo w JOIN e ON w.ancestor = e.child WHERE w.distance < 5),
sh AS (SELECT node, ancestor, min(distance) AS distance FROM clo GROUP BY 1, 2),
nr AS (SELECT node, ancestor, distance, row_number() OVER (PARTITION BY node ORDER BY distance, ancestor) AS place FROM sh QUALIFY place <= 5),
an AS (SELECT node, list(name ORDER BY place) AS names FROM nr JOIN terms ON id = ancestor GROUP BY 1)"""


def nearest(spark, sf):
    from tallyloom.operators import graph as gr

    rows = entries(spark, sf)
    up = rows.select(F.col("id").alias("child"), F.explode(F.array(F.expr("id div 2"), F.expr("id div 3"))).alias("parent")).distinct()
    known = up.join(rows.select(F.col("id").alias("parent")), "parent", "left_semi").filter("child <> parent")
    near = gr.nearest_ancestors(known)
    return near, gr.ancestor_names(near, rows.select(F.col("id").alias("node"), "name"))


@query("d5_nearest_ancestors", f"WITH RECURSIVE {TERM_EDGES} SELECT node, ancestor, distance, place FROM nr")
def d5_nearest_ancestors(spark, sf):
    return nearest(spark, sf)[0]


@query("f29_text_with_ancestors", f"""WITH RECURSIVE {TERM_EDGES} SELECT t.id, concat_ws(' ', nullif(name, ''), nullif(definition, ''),
  CASE WHEN source = 'KEGG' THEN o_orderpriority || ' ' || o_orderstatus END, array_to_string(names, ' ')) AS text FROM terms t JOIN orders ON o_orderkey = t.id LEFT JOIN an ON an.node = t.id""")
def f29_text_with_ancestors(spark, sf):
    """Pathways carry their two class names, terms the names of at most five nearest ancestors."""
    classes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderpriority", "o_orderstatus").alias("classes"))
    rows = entries(spark, sf).join(classes, "id").join(nearest(spark, sf)[1].withColumnRenamed("node", "id"), "id", "left")
    return rows.select("id", cl.classification_text(F.col("name"), F.col("definition"), F.when(F.col("source") == "KEGG", F.col("classes")), F.col("ancestor_names")).alias("text"))


@query("c12_labels_by_ancestors", rf"""WITH RECURSIVE {TERM_EDGES}, a AS (SELECT id, lower(concat_ws(' ', name, definition)) AS t, lower(coalesce(array_to_string(names, '|'), '')) AS anc FROM terms LEFT JOIN an ON node = id),
l AS (SELECT id, t, {set_sql()} AS labels FROM a)
SELECT id, array_to_string(labels, ',') AS labels, CASE WHEN len(labels) > 0 THEN labels[1] WHEN regexp_matches(t, '(regulation|signaling)') THEN 'General Regulation' ELSE 'General Process' END AS "primary" FROM l""")
def c12_labels_by_ancestors(spark, sf):
    named = entries(spark, sf).join(nearest(spark, sf)[1].withColumnRenamed("node", "id"), "id", "left")
    out = cl.set_labels(named, "name", "definition", "ancestor_names")
    return out.select("id", F.array_join("labels", ",").alias("labels"), "primary")


@query("c14_added_words", f"""WITH {TERMS} SELECT id FROM terms WHERE contains(lower(concat_ws(' ', name, definition)), 'nothing else')
  AND lower(trim(name)) NOT IN ({', '.join(f"'{n}'" for n in tr.GENERAL_NAMES)})""")
def c14_added_words(spark, sf):
    rules = cl.Rules().with_word("C", "nothing else")
    return cut(cl.classify(entries(spark, sf), rules)).filter(
        F.array_contains("all_systems", "C") & F.lower(F.concat_ws(" ", "name", "definition")).contains("nothing else")).select("id")


@query("g8_classification_statistics", f"""WITH {CLASSIFIED} SELECT system, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(stddev_samp(confidence), 5) AS sd_confidence,
  count(DISTINCT source) AS sources, count(DISTINCT id) AS terms, round(100.0 * count(*) / (SELECT count(*) FROM cls), 6) AS pct_of_total FROM cls GROUP BY 1""")
def g8_classification_statistics(spark, sf):
    out = agg.classification_statistics(classified(spark, sf), ["system"], "confidence", "source", "id")
    return out.withColumns({"mean_confidence": F.round("mean_confidence", 6), "sd_confidence": F.round("sd_confidence", 5),
                            "pct_of_total": F.round("pct_of_total", 6)})


@query("g9_publication_table", f"""WITH {CLASSIFIED}, k AS (SELECT system, coalesce(subsystem, '-') AS subsystem, count(*) AS n FROM cls GROUP BY 1, 2),
x AS (SELECT system, coalesce(subsystem, '-') AS subsystem, name, id FROM cls QUALIFY row_number() OVER (PARTITION BY system, coalesce(subsystem, '-') ORDER BY confidence DESC, id) <= 3)
SELECT system, subsystem, n, round(100.0 * n / sum(n) OVER (PARTITION BY system), 6) AS pct_of_parent, round(100.0 * n / sum(n) OVER (), 6) AS pct_of_total FROM k""")
def g9_publication_table(spark, sf):
    rows = classified(spark, sf).withColumn("subsystem", F.coalesce("subsystem", F.lit("-")))
    out = agg.shares(rows.select("system", "subsystem"), ["system"], ["subsystem"])
    return out.withColumns({c: F.round(c, 6) for c in ("pct_of_parent", "pct_of_total")})


@query("g9_examples", f"""WITH {CLASSIFIED}, x AS (SELECT system, name, confidence, id FROM cls QUALIFY row_number() OVER (PARTITION BY system ORDER BY confidence DESC, id) <= 3)
SELECT system, string_agg(name, '; ' ORDER BY confidence DESC, id) AS examples FROM x GROUP BY 1""")
def g9_examples(spark, sf):
    return agg.examples(classified(spark, sf), ["system"], [F.col("confidence") * -1, F.col("id")], "name", 3)


@query("g10_distribution_breakdown", f"""WITH {CLASSIFIED} SELECT system, 'all' AS dimension, 'all' AS key, count(*) AS n FROM cls GROUP BY 1
UNION ALL SELECT system, 'source', source, count(*) FROM cls GROUP BY 1, 3 UNION ALL SELECT system, 'namespace', namespace, count(*) FROM cls GROUP BY 1, 3""")
def g10_distribution_breakdown(spark, sf):
    return agg.breakdown(classified(spark, sf), "system", ["source", "namespace"])


@query("g11_coverage_rates", f"""WITH {CLASSIFIED} SELECT coalesce(source, 'all') AS source, count(*) AS n, count_if(system <> '0') AS classified,
  round(avg(CASE WHEN system <> '0' THEN 1.0 ELSE 0 END), 6) AS classified_rate, round(avg(CASE WHEN polarity IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS annotated_rate
FROM cls GROUP BY ROLLUP (source)""")
def g11_coverage_rates(spark, sf):
    out = agg.coverage_rates(classified(spark, sf), "source", F.col("system") != "0", F.col("polarity").isNotNull())
    return out.withColumns({c: F.round(c, 6) for c in ("classified_rate", "annotated_rate")})


@query("g12_quality_metrics", f"""WITH {CLASSIFIED} SELECT round(avg(confidence), 6) AS mean_confidence, round(median(confidence), 6) AS median_confidence,
  round(avg(CASE WHEN len(systems) > 1 AND kind <> 'general' THEN 1.0 ELSE 0 END), 6) AS multi_match_rate FROM cls""")
def g12_quality_metrics(spark, sf):
    from tallyloom.operators.ordering import quantiles
    rows = classified(spark, sf).select("confidence", "all_systems", F.lit(0).alias("_all"))
    middle = quantiles(rows, ["_all"], "confidence", {"median_confidence": 0.5})
    out = rows.groupBy("_all").agg(
        r6(F.avg("confidence"), "mean_confidence"), r6(F.avg((F.size("all_systems") > 1).cast("double")), "multi_match_rate"))
    return out.join(middle, "_all").drop("_all").withColumn("median_confidence", F.round("median_confidence", 6))


@query("g12_path_lengths", f"""WITH {CLASSIFIED}, l AS (SELECT kind, len(string_split(path, ' > ')) AS steps FROM cls)
SELECT kind, count(*) AS n, round(avg(steps), 6) AS mean_steps, min(steps) AS least, max(steps) AS most, round(coalesce(stddev_samp(steps), 0), 6) AS sd FROM l GROUP BY 1""")
def g12_path_lengths(spark, sf):
    """Steps of the decision paths by kind of decision."""
    rows = classified(spark, sf).select("kind", F.size("path").alias("steps"))
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("steps"), "mean_steps"), F.min("steps").alias("least"), F.max("steps").alias("most"),
        r6(F.coalesce(F.stddev_samp("steps"), F.lit(0.0)), "sd"))


@query("g12_gini", f"""WITH {CLASSIFIED}, k AS (SELECT count(*) AS v FROM cls GROUP BY system), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM k)
SELECT round(2 * sum(i * v) / (max(n) * sum(v)) - (max(n) + 1.0) / max(n), 6) AS gini FROM r""")
def g12_gini(spark, sf):
    counts = classified(spark, sf).groupBy("system").agg(F.count(F.lit(1)).alias("n"))
    return agg.gini(counts, "n").withColumn("gini", F.round("gini", 6))


@query("g13_polarity_within_system", f"""WITH {CLASSIFIED}, k AS (SELECT system, polarity, count(*) AS n FROM cls WHERE polarity IS NOT NULL GROUP BY 1, 2)
SELECT system, polarity, n, round(100.0 * n / sum(n) OVER (PARTITION BY system), 6) AS pct_of_parent FROM k""")
def g13_polarity_within_system(spark, sf):
    rows = classified(spark, sf).filter("polarity IS NOT NULL").select("system", "polarity")
    return agg.shares(rows, ["system"], ["polarity"]).drop("pct_of_total").withColumn("pct_of_parent", F.round("pct_of_parent", 6))


@query("g15_classification_checks", f"""WITH {CLASSIFIED} SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n,
  count_if(subsystem IS NOT NULL AND substr(subsystem, 1, 1) <> system) AS inconsistent, count_if(system IS NULL) AS incomplete FROM cls GROUP BY 1""")
def g15_classification_checks(spark, sf):
    from tallyloom.operators.quality import classification_checks
    return classification_checks(classified(spark, sf))


@query("g16_polarity_by_system", f"""WITH {CLASSIFIED} SELECT coalesce(polarity, 'none') AS polarity, count_if(system = 'A') AS A, count_if(system = 'B') AS B, count_if(system = 'C') AS C,
  count_if(system = 'D') AS D, count_if(system = 'E') AS E, count_if(system = '0') AS "0" FROM cls GROUP BY 1""")
def g16_polarity_by_system(spark, sf):
    rows = classified(spark, sf).withColumn("polarity", F.coalesce("polarity", F.lit("none")))
    return agg.cross_table(rows, "polarity", "system", cl.SYSTEMS)


@query("p19_confident_examples", f"""WITH {CLASSIFIED} SELECT system, id, row_number() OVER (PARTITION BY system ORDER BY confidence DESC, id) AS place FROM cls WHERE confidence >= 0.9 QUALIFY place <= 3""")
def p19_confident_examples(spark, sf):
    from tallyloom.operators.filters import confident_examples
    return confident_examples(classified(spark, sf), ["system"], "confidence", "id").select("system", "id", "place")


@query("f29_classification_text", f"""WITH {TERMS} SELECT id, concat_ws(' ', name, definition, namespace) AS text FROM terms""")
def f29_classification_text(spark, sf):
    return entries(spark, sf).select("id", F.concat_ws(" ", "name", "definition", "namespace").alias("text"))


@query("p22_predicates", f"""WITH {CLASSIFIED} SELECT count_if(contains(lower(name || ' ' || coalesce(definition, '')), 'obsolete')) AS obsolete,
  count_if(kind IN ('unclassified', 'general')) AS unclassified, count_if(polarity IS NOT NULL) AS with_polarity, count(*) AS n FROM cls""")
def p22_predicates(spark, sf):
    from tallyloom.operators import filters as fl
    return classified(spark, sf).agg(
        F.count_if(fl.is_obsolete()).alias("obsolete"), F.count_if(fl.is_unclassified()).alias("unclassified"),
        F.count_if(fl.has_polarity()).alias("with_polarity"), F.count(F.lit(1)).alias("n"))
