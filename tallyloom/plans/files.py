"""File formats written out of the given tables as text lines and parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.plans.classification import CLASSIFIED, classified
from tallyloom.plans.common import r6
from tallyloom.plans.registry import query
from tallyloom.plans.studies import ATTRS, LINES, VALUES, attributes, values
from tallyloom.sources import matrices as mx
from tallyloom.sources import ontologies as on
from tallyloom.sources import platforms as pf
from tallyloom.sources import sinks, tables
from tallyloom.session import shared_folder, table

FLAGS = ["A", "N", "R"]


def matrix_lines(spark, sf):
    """A matrix per line status: features are parts, samples return flags."""
    lines = table(spark, sf, "lineitem")
    wide = lines.groupBy(F.col("l_linestatus").alias("file"), "l_partkey").pivot("l_returnflag", FLAGS).agg(F.max("l_quantity"))
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    body = wide.select("file", (F.col("l_partkey") + 100).cast("long").alias("line_no"), F.concat_ws(
        "\t", F.concat(F.lit('"'), F.col("l_partkey").cast("string"), F.lit('"')), *[cell(c) for c in FLAGS]).alias("line"))
    files = lines.select(F.col("l_linestatus").alias("file")).distinct()
    # the header's first cell is another word in each file; behind the end marker stands a line that is no row
    first = F.concat(F.lit('"PROBE_'), F.col("file"), F.lit('"\t"A"\t"N"\t"R"'))
    parts = [F.lit("!Series_type\tExpression profiling by array"), F.lit("!Series_sample_taxid\t9606"), F.lit('!Series_sample_id\t"A N R"'), F.lit(mx.TABLE_BEGIN), first]
    head = files.select("file", F.posexplode(F.array(*parts)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))
    last = files.select("file", F.posexplode(F.array(F.lit(mx.TABLE_END), F.lit("trailer\t1\t2\t3"))).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no") + F.lit(1 << 40))
    return head.unionByName(body.select("file", "line_no", "line")).unionByName(last)


@query("s1_matrix_values", """SELECT l_linestatus AS file, CAST(l_partkey AS VARCHAR) AS feature, l_returnflag AS sample, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3""")
def s1_matrix_values(spark, sf):
    return mx.matrix_values(matrix_lines(spark, sf))


@query("s2_lenient_matrix", """SELECT l_linestatus AS file, CAST(l_partkey AS VARCHAR) AS feature, l_returnflag AS sample, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3""")
def s2_lenient_matrix(spark, sf):
    broken = matrix_lines(spark, sf)
    extra = broken.select("file").distinct().select("file", F.lit("bad\t1").alias("line"), F.lit(50).cast("long").alias("line_no"))
    return mx.matrix_values(broken.unionByName(extra), lenient=True)


@query("s3_well_measured", """WITH v AS (SELECT l_linestatus AS file, l_partkey, l_returnflag, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3)
SELECT file, CAST(l_partkey AS VARCHAR) AS feature, count(*) AS n FROM v GROUP BY 1, 2 HAVING count(*) >= 3 * 0.9""")
def s3_well_measured(spark, sf):
    values_ = mx.matrix_values(matrix_lines(spark, sf))
    samples = values_.groupBy("file").agg(F.count_distinct("sample").alias("samples"))
    return mx.well_measured(values_, samples, 0.9).groupBy("file", "feature").agg(F.count(F.lit(1)).alias("n"))


@query("p3_matrix_verdicts", """SELECT l_linestatus AS file, count(DISTINCT l_partkey) + 1 AS table_lines, 3 AS samples, 'too_few_samples' AS reason FROM lineitem GROUP BY 1""")
def p3_matrix_verdicts(spark, sf):
    return mx.matrix_verdicts(matrix_lines(spark, sf)).select("file", "table_lines", "samples", "reason")


@query("s4_sample_attributes", f"""WITH {ATTRS} SELECT dataset || '/' || (sample // 64) AS file, CAST(sample AS VARCHAR) AS sample, text FROM attrs""")
def s4_sample_attributes(spark, sf):
    # a file holds the samples of one dataset with up to 64 neighbouring ids, side by side in its lines
    samples = table(spark, sf, "customer").select(F.col("c_nationkey").alias("dataset"), F.col("c_custkey").alias("sample"))
    file = F.concat_ws("/", F.col("dataset").cast("string"), F.expr("sample div 64").cast("string"))
    places = samples.withColumn("file", file)
    full = places.select("file", "dataset", "sample", F.explode(F.sequence(F.lit(0), F.lit(len(LINES) - 1))).alias("pos"))
    texts = full.join(attributes(spark, sf), ["dataset", "sample", "pos"], "left")
    packed = texts.groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("sample", F.coalesce("text", F.lit("")).alias("text")))).alias("_s"))
    quoted = lambda f: F.array_join(F.transform("_s", lambda e: F.concat(F.lit('"'), e[f].cast("string"), F.lit('"'))), "\t")
    attrs = packed.select("file", (F.col("pos") + 1).cast("long").alias("line_no"), F.concat(F.lit("!Sample_characteristics_ch1\t"), quoted("text")).alias("line"))
    ids = packed.filter("pos = 0").select("file", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("!Sample_geo_accession\t"), quoted("sample")).alias("line"))
    return mx.sample_attributes(attrs.unionByName(ids)).select("file", "sample", "text")


@query("s5_study_texts", """SELECT n_name AS file, 'Study of ' || n_name AS title, 'Nation ' || n_nationkey AS summary, 'Region ' || n_regionkey AS design FROM nation""")
def s5_study_texts(spark, sf):
    parts = ["concat('!Series_title\t\"Study of ', n_name, '\"')", "concat('!Series_summary\tNation ', n_nationkey)", "concat('!Series_overall_design\tRegion ', n_regionkey)"]
    lines = table(spark, sf, "nation").selectExpr("n_name AS file", f"posexplode(array({', '.join(parts)})) AS (line_no, line)")
    return mx.study_texts(lines)


def platform_lines(spark, sf, symbol):
    """A family file for each brand: its platform table between markers, and a
    sample table of the same width behind it.  Every third row lacks its last,
    empty cell."""
    parts = table(spark, sf, "part")
    row = lambda *cells: F.concat_ws("\t", *cells)
    body = parts.select(F.col("p_brand").alias("file"), (F.col("p_partkey") + 10).alias("line_no"), F.concat(
        row(F.col("p_partkey").cast("string"), "p_name", symbol), F.when(F.col("p_partkey") % 3 == 0, "").otherwise("\t")).alias("line"))
    files = parts.select(F.col("p_brand").alias("file")).distinct()
    named = F.when(F.expr("ascii(right(file, 1)) % 2 = 0"), "ID\tName\tGene Symbol\tNote").otherwise("PROBE_ID\tName\tSYMBOL\tNote")
    head = files.select("file", F.posexplode(F.array(F.lit("^PLATFORM = x"), F.lit(pf.PLATFORM_BEGIN), named)).alias("line_no", "line"))
    tail = files.select("file", F.posexplode(F.array(F.lit(pf.PLATFORM_END), F.lit("!sample_table_begin"), F.lit("ID_REF\tVALUE\tA\tB"), F.lit("7_at\t1.5\tZZ3\tx"))).alias("line_no", "line"))
    return head.withColumn("line_no", F.col("line_no").cast("long")).unionByName(body).unionByName(tail.withColumn("line_no", F.col("line_no") + F.lit(1 << 40)))


@query("s6_platform_map", """SELECT p_brand AS file, CAST(p_partkey AS VARCHAR) AS feature, replace(p_brand, '#', '') AS target FROM part WHERE p_partkey % 5 <> 0""")
def s6_platform_map(spark, sf):
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    return pf.platform_map(platform_lines(spark, sf, F.when(F.col("p_partkey") % 5 == 0, "---").otherwise(F.concat(brand, F.lit(" /// "), "p_type"))))


@query("s6_platform_verdicts", """SELECT p_brand AS file, CASE WHEN ascii(right(p_brand, 1)) % 2 = 0 THEN 'ID' ELSE 'PROBE_ID' END AS key,
  CASE WHEN p_brand = 'Brand#1' THEN NULL WHEN ascii(right(p_brand, 1)) % 2 = 0 THEN 'Gene Symbol' ELSE 'SYMBOL' END AS symbol, p_brand <> 'Brand#1' AS usable,
  CASE WHEN p_brand = 'Brand#1' THEN 'no_symbol_column' ELSE 'ok' END AS reason FROM part GROUP BY p_brand""")
def s6_platform_verdicts(spark, sf):
    """One file has no symbol column; it is reported and doesn't stop the others."""
    lines = platform_lines(spark, sf, F.lit("TP53"))
    worse = lines.withColumn("line", F.when((F.col("file") == "Brand#1") & F.col("line").contains("\tNote"), "PROBE_ID\tName\tLocus\tNote").otherwise(F.col("line")))
    return pf.platform_verdicts(worse).select("file", "key", "symbol", "usable", "reason")


@query("s8_second_vendor", """SELECT CAST(p_partkey AS VARCHAR) AS feature, replace(p_brand, '#', '') AS target FROM part WHERE p_partkey % 5 <> 0""")
def s8_second_vendor(spark, sf):
    """The second vendor's layout: its own column names, its own order of preference among them."""
    parts = table(spark, sf, "part")
    symbol = F.when(F.col("p_partkey") % 5 == 0, "---").otherwise(F.replace("p_brand", F.lit("#"), F.lit("")))
    body = parts.select((F.col("p_partkey") + 10).alias("line_no"), F.concat_ws("\t", F.col("p_partkey").cast("string"), F.lit("other"), symbol).alias("line"))
    head = spark.range(1).select(F.lit(0).cast("long").alias("line_no"), F.lit("ID\tSymbol\tILMN_Gene").alias("line"))
    return pf.platform_map(head.unionByName(body), pf.ILLUMINA_SYMBOL_COLUMNS)


@query("s27_imputed_matrix", """WITH v AS (SELECT l_linestatus AS file, CAST(l_partkey // 2 AS VARCHAR) AS feature, l_returnflag AS sample, avg(q) AS value
  FROM (SELECT l_linestatus, l_partkey, l_returnflag, max(l_quantity) AS q FROM lineitem WHERE (l_partkey // 2) % 10 <> 0 GROUP BY 1, 2, 3) GROUP BY 1, 2, 3),
m AS (SELECT file, sample, avg(value) AS mean FROM v GROUP BY 1, 2)
SELECT f.file, f.feature, m.sample, round(coalesce(v.value, m.mean), 6) AS value FROM (SELECT DISTINCT file, feature FROM v) f JOIN m ON m.file = f.file
  LEFT JOIN v ON v.file = f.file AND v.feature = f.feature AND v.sample = m.sample""")
def s27_imputed_matrix(spark, sf):
    """Two neighbouring parts share a feature name; every tenth name is one of the vendor's own."""
    renamed = F.regexp_replace("line", '^"([0-9]+)"', F.concat(F.lit('"'), F.expr("CAST(CAST(regexp_extract(line, '^\"([0-9]+)\"', 1) AS BIGINT) div 2 AS STRING)"), F.lit('"')))
    lines = matrix_lines(spark, sf).withColumn("line", F.when(F.col("line").rlike('^"[0-9]+"'), renamed).otherwise(F.col("line")))
    out = mx.imputed_matrix(lines, F.coalesce(F.expr("try_cast(feature AS BIGINT)") % 10 == 0, F.lit(False)))
    return out.withColumn("value", F.round("value", 6))


@query("j15_positional_samples", f"""SELECT n_nationkey AS file, CAST(pos AS INT) AS pos, 'col' || pos AS sample, CASE WHEN pos < n_nationkey % 4 THEN n_name || ' ' || pos ELSE 'col' || pos END AS title,
  CASE WHEN pos < n_nationkey % 4 THEN CASE WHEN pos % 2 = 0 THEN 'even' ELSE 'odd' END ELSE 'Unknown' END AS "group" FROM nation, (SELECT unnest(range(4)) AS pos)""")
def j15_positional_samples(spark, sf):
    """Each nation's file names fewer samples than its score table has columns."""
    nations = table(spark, sf, "nation")
    quoted = lambda value: F.array_join(F.transform(F.slice(F.array(*[F.lit(k) for k in range(4)]), F.lit(1), (F.col("n_nationkey") % 4).cast("int")), lambda k: F.concat(F.lit('"'), value(k), F.lit('"'))), "\t")
    titles = F.concat(F.lit("!Sample_title\t"), quoted(lambda k: F.concat("n_name", F.lit(" "), k.cast("string"))))
    sources = F.concat(F.lit("!Sample_source_name_ch1\t"), quoted(lambda k: F.when(k % 2 == 0, "even").otherwise("odd")))
    lines = nations.select(F.col("n_nationkey").alias("file"), F.posexplode(F.array(titles, sources)).alias("line_no", "line"))
    columns = nations.select(F.col("n_nationkey").alias("file"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).withColumn(
        "sample", F.concat(F.lit("col"), F.col("pos").cast("string")))
    return mx.positional_samples(columns, lines, F.col("source")).drop("source")


@query("s7_platform_map_all", """SELECT p_brand AS file, CAST(p_partkey AS VARCHAR) AS feature, unnest([p_brand, p_type]) AS target FROM part""")
def s7_platform_map_all(spark, sf):
    mark = F.element_at(F.array(*[F.lit(m) for m in pf.SEPARATORS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    lines = platform_lines(spark, sf, F.concat("p_brand", F.lit(" "), mark, F.lit(" "), "p_type"))
    return pf.platform_map_all(lines).select("file", "feature", F.explode("targets").alias("target"))


@query("s12_record_features", """SELECT DISTINCT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS term_id, 'G' || l_partkey AS feature FROM lineitem""")
def s12_record_features(spark, sf):
    # a record for each supplier and stretch of 64 parts
    genes = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey", F.expr("l_partkey div 64").alias("k")).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.col("l_partkey").cast("string"), F.lit("  G"), F.col("l_partkey").cast("string"), F.lit("; some gene")))), "\n            ").alias("g"))
    records = genes.select(F.concat(F.lit("ENTRY       hsa"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0"), F.lit("    Pathway\nNAME        x\nGENE        "), "g", F.lit("\nCOMPOUND    C1  y\n")).alias("record"))
    return on.record_features(records)


@query("s14_joined_study", f"""WITH {VALUES}, go AS (SELECT sample, max(CASE WHEN feature = '1-URGENT/F' THEN value END) AS f FROM vals GROUP BY 1), sy AS (SELECT o_custkey AS sample, avg(ln(o_totalprice)) AS A FROM orders GROUP BY 1)
SELECT c_custkey AS sample_id, c_mktsegment AS "group", round(coalesce(f, 0), 6) AS f, round(coalesce(A, 0), 6) AS "A" FROM customer JOIN go ON go.sample = c_custkey JOIN sy ON sy.sample = c_custkey WHERE c_custkey % 4 <> 0""")
def s14_joined_study(spark, sf):
    info = table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("group"))
    wide = values(spark, sf).groupBy(F.col("sample").alias("sample_id")).agg(F.max(F.when(F.col("feature") == "1-URGENT/F", F.col("value"))).alias("f"))
    scores = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.avg(F.ln("o_totalprice")).alias("A"))
    return tables.joined_study(info, wide, scores).select("sample_id", "group", r6("f", "f"), r6("A", "A"))


@query("s18_written_by_key", """SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def s18_written_by_key(spark, sf):
    path = f"{shared_folder(spark)}/by-key-{uuid.uuid4().hex}"
    sinks.write_by_key(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), path, "status", batch_rows=1000)
    back = spark.read.option("header", "true").csv(path, schema="o_orderkey bigint, status string")
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("s19_appended_once", """SELECT o_orderkey, o_orderstatus FROM orders""")
def s19_appended_once(spark, sf):
    path = f"{shared_folder(spark)}/append-{uuid.uuid4().hex}"
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    rows.filter("o_orderkey % 3 = 0").write.parquet(path)
    sinks.append_new(rows, path, "o_orderkey")
    sinks.append_new(rows.filter("o_orderkey % 2 = 0"), path, "o_orderkey")
    return spark.read.parquet(path)


@query("s24_run_log", """SELECT 'orders' AS step, 'ok' AS status, count(*) AS "rows" FROM orders UNION ALL SELECT 'lineitem', 'ok', count(*) FROM lineitem""")
def s24_run_log(spark, sf):
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    for name in ("orders", "lineitem"):
        sinks.observed_run(table(spark, sf, name), path, name).write.format("noop").mode("overwrite").save()
        sinks.log_observed(spark, path, name)
    return spark.read.parquet(path).select("step", "status", "rows")


@query("s25_archived_dataset", """SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, c_custkey = 7 AS archived, CASE WHEN c_custkey = 7 THEN 'no platform' END AS reason FROM customer""")
def s25_archived_dataset(spark, sf):
    from tallyloom.operators.catalogue import move_to_archive
    kept, gone = move_to_archive(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("dataset_id")), "7", "no platform")
    return kept.select("dataset_id", F.lit(False).alias("archived"), F.lit(None).cast("string").alias("reason")).unionByName(
        gone.select("dataset_id", F.lit(True).alias("archived"), F.col("remove_reason").alias("reason")))


@query("s9_ontology_terms", """SELECT 'GO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS id, p_name AS name, 'about ' || p_type AS definition,
  CASE WHEN p_partkey > 1 THEN 'GO:' || lpad(CAST(p_partkey // 2 AS VARCHAR), 7, '0') ELSE '' END AS is_a, p_partkey % 10 = 0 AS obsolete FROM part""")
def s9_ontology_terms(spark, sf):
    go = lambda e: f"concat('GO:', lpad(CAST({e} AS STRING), 7, '0'))"
    stanzas = table(spark, sf, "part").selectExpr(f"""concat('[Term]\\nid: ', {go('p_partkey')}, '\\nname: ', p_name, '\\nnamespace: biological_process\\ndef: "about ', p_type, '" [x]',
      CASE WHEN p_partkey > 1 THEN concat('\\nis_a: ', {go('p_partkey div 2')}, ' ! parent') ELSE '' END, CASE WHEN p_partkey % 10 = 0 THEN '\\nis_obsolete: true' ELSE '' END) AS stanza""")
    return on.terms(stanzas).select("id", "name", "definition", F.array_join("is_a", ",").alias("is_a"), "obsolete")


@query("s10_pathways", """SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS id, n_name AS name, r_name AS class_a, 'Part ' || (n_nationkey % 2) AS class_b FROM nation JOIN region ON n_regionkey = r_regionkey""")
def s10_pathways(spark, sf):
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = nation.groupBy("r_name", (F.col("n_nationkey") % 2).alias("p")).agg(F.array_join(F.array_sort(F.collect_list(
        F.concat(F.lit("C    "), F.lpad(F.col("n_nationkey").cast("string"), 5, "0"), F.lit("  "), "n_name"))), "\n").alias("c"))
    blocks = parts.groupBy("r_name").agg(F.array_join(F.collect_list(F.concat(F.lit("B  Part "), F.col("p").cast("string"), F.lit("\n"), "c")), "\n").alias("b"))
    files = blocks.select(F.concat(F.lit("+D\n!\nA"), "r_name", F.lit("\n"), "b", F.lit("\n!")).alias("text"))
    return on.pathways(files).drop("description")


@query("s11_annotations", """SELECT DISTINCT 'GO:' || l_partkey AS term_id, 'G' || l_suppkey AS feature FROM lineitem""")
def s11_annotations(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.concat_ws("\t", F.lit("U"), F.lit("P1"), F.concat(F.lit("G"), F.col("l_suppkey").cast("string")), F.lit(""),
                                                            F.concat(F.lit("GO:"), F.col("l_partkey").cast("string"))).alias("line"))
    return on.annotations(lines)


@query("s13_json_sets", """SELECT DISTINCT p_brand AS set_id, CAST(p_partkey AS VARCHAR) AS feature FROM part""")
def s13_json_sets(spark, sf):
    texts = table(spark, sf, "part").select(F.to_json(F.create_map("p_brand", F.array(F.col("p_partkey").cast("string")))).alias("text"))
    return on.json_sets(texts)


@query("s15_catalogue", """SELECT 'D' || c_custkey AS dataset_id, CASE WHEN c_custkey % 3 = 0 THEN 'D' || c_custkey ELSE c_name END AS name, 'unknown' AS disease_type,
  c_mktsegment || ',B' AS expected_systems, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS INT) ELSE 0 END AS n_samples FROM customer""")
def s15_catalogue(spark, sf):
    raw = table(spark, sf, "customer").selectExpr(
        "concat(' D', c_custkey, ' ') AS dataset_id", "CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END AS name", "'' AS chinese_name", "'' AS disease_type",
        "'' AS expected_strategy", "concat(c_mktsegment, ' ; ;B') AS expected_systems", "'' AS description", "'' AS platform",
        "CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) ELSE 'many' END AS n_samples", "'' AS pub_date", "'' AS gdstype")
    return tables.catalogue(raw).select("dataset_id", "name", "disease_type", F.array_join("expected_systems", ",").alias("expected_systems"), "n_samples")


@query("s16_system_coverage", """WITH r AS (SELECT event_id, event_type FROM events WHERE event_type <> 'error') SELECT unnest([event_type, 'System A']) AS system, count(*) AS runs FROM r GROUP BY 1""")
def s16_system_coverage(spark, sf):
    from tallyloom.operators.catalogue import system_coverage
    runs = table(spark, sf, "events").select(
        F.array("event_type", F.lit("System A")).alias("top_systems"), F.when(F.col("event_type") == "error", F.array(F.lit("x"))).otherwise(F.array()).alias("errors"),
        F.lit('{"a":1}').alias("classification_results"), F.col("props").alias("system_scores"))
    return system_coverage(tables.successful_runs(runs))


@query("s17_flat_results", f"""WITH {CLASSIFIED} SELECT CAST(id AS VARCHAR) AS "ID", name AS "Name", coalesce(subsystem, '') AS "Subsystem", coalesce(polarity, '') AS "Inflammation_Polarity",
  printf('%.3f', confidence) AS "Confidence_Score" FROM cls""")
def s17_flat_results(spark, sf):
    return sinks.flat_results(classified(spark, sf)).select("ID", "Name", "Subsystem", "Inflammation_Polarity", "Confidence_Score")


@query("s20_summary_counts", f"""WITH {CLASSIFIED} SELECT 'system' AS dimension, system AS key, count(*) AS n FROM cls GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM cls GROUP BY 2
UNION ALL SELECT 'polarity', coalesce(polarity, 'none'), count(*) FROM cls GROUP BY 2 UNION ALL SELECT 'subsystem', coalesce(subsystem, 'none'), count(*) FROM cls GROUP BY 2""")
def s20_summary_counts(spark, sf):
    return sinks.summary_counts(classified(spark, sf), ["system", "source", "polarity", "subsystem"])


@query("s21_export_check", """SELECT count(*) AS "rows", count_if(text IS NULL OR trim(text) = '') AS without_key, 'quality' AS missing, false AS valid FROM documents""")
def s21_export_check(spark, sf):
    return sinks.check_export(table(spark, sf, "documents"), ["doc_id", "text", "quality"], "text")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FEATURES = [f"{priority}/{status}" for priority in PRIORITIES for status in "FOP"]


@query("s22_wide_scores", f"""WITH {VALUES} SELECT sample, {", ".join(f"round(coalesce(max(CASE WHEN feature = '{f}' THEN value END), 0), 6) AS " + f'"{f}"' for f in FEATURES)} FROM vals GROUP BY 1""")
def s22_wide_scores(spark, sf):
    out = sinks.wide_scores(values(spark, sf), "sample", "feature", "value", FEATURES)
    return out.select("sample", *[r6(f"`{f}`", f) for f in FEATURES])


@query("s23_time_table", """SELECT year(o_orderdate) AS y, round(avg(CASE WHEN o_orderstatus = 'F' THEN ln(o_totalprice) END), 6) AS "F", round(avg(CASE WHEN o_orderstatus = 'O' THEN ln(o_totalprice) END), 6) AS "O" FROM orders GROUP BY 1""")
def s23_time_table(spark, sf):
    points = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), "o_orderstatus", F.ln("o_totalprice").alias("v"))
    return sinks.time_table(points, "y", "o_orderstatus", "v", ["F", "O"]).select("y", r6("F", "F"), r6("O", "O"))


@query("s26_records_round_trip", """SELECT o_orderkey, o_orderstatus, 'none' AS note FROM orders""")
def s26_records_round_trip(spark, sf):
    texts = sinks.as_records(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"))
    return sinks.from_records(texts, "o_orderkey bigint, o_orderstatus string, note string", {"note": "none"})
