"""Scalar extraction from texts: attributes, times, labels, symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import labels, metadata as md
from tallyloom.plans.registry import query
from tallyloom.plans.studies import ATTRS, DESIGN, attributes, design
from tallyloom.session import table


@query("f1_items_per_sample", f"""WITH {ATTRS} SELECT dataset, sample, count(*) AS n,
  string_agg(text, ' ' ORDER BY pos) AS merged FROM attrs GROUP BY 1, 2""")
def f1_items_per_sample(spark, sf):
    rows = md.sample_items(attributes(spark, sf), ["dataset", "sample"])
    return rows.select("dataset", "sample", F.size("items").cast("long").alias("n"),
                       md.merged(F.col("items")).alias("merged"))


@query("f2_key_values", rf"""WITH {ATTRS} SELECT dataset, sample,
  lower(trim(regexp_extract(text, '^([^:=]*)[:=](.*)$', 1))) AS key,
  trim(regexp_extract(text, '^([^:=]*)[:=](.*)$', 2)) AS value FROM attrs""")
def f2_key_values(spark, sf):
    rows = md.sample_items(attributes(spark, sf), ["dataset", "sample"])
    return rows.select("dataset", "sample", F.inline(md.key_values(F.col("items")))).drop("split")


@query("f3_first_number", r"""SELECT event_id, CAST(nullif(regexp_extract(props, '(-?[0-9]+(\.[0-9]+)?)', 1), '') AS DOUBLE) AS number
FROM events""")
def f3_first_number(spark, sf):
    return table(spark, sf, "events").select("event_id", md.number_in(F.col("props")).alias("number"))


TIMES = """CASE event_id % 6 WHEN 0 THEN event_id % 90 || ' h' WHEN 1 THEN 'day ' || event_id % 30 WHEN 2 THEN
 event_id % 9 || ' weeks' WHEN 3 THEN event_id % 5 || '.5 months' WHEN 4 THEN 't' || event_id % 11 ELSE 'none' END"""


@query("f4_times_in_days", rf"""WITH x AS (SELECT event_id, {TIMES} AS text FROM events),
p AS (SELECT event_id, CAST(nullif(regexp_extract(text, '(-?[0-9]+(\.[0-9]+)?)', 1), '') AS DOUBLE) AS n,
  regexp_extract(text, '-?[0-9]+(\.[0-9]+)?\s*(h|d|wk|week|mo)?', 2) AS u FROM x)
SELECT event_id, round(CASE u WHEN 'h' THEN n / 24 WHEN 'week' THEN n * 7 WHEN 'wk' THEN n * 7 WHEN 'mo' THEN n * 30 ELSE n END, 6) AS days,
  nullif(u, '') AS unit FROM p""")
def f4_times_in_days(spark, sf):
    text = F.expr(TIMES)
    return table(spark, sf, "events").select(
        "event_id", F.round(md.days_in(text), 6).alias("days"), md.unit_in(text).alias("unit"))


@query("f5_group_labels", f'WITH {DESIGN} SELECT dataset, sample, "group" FROM design')
def f5_group_labels(spark, sf):
    return design(spark, sf).select("dataset", "sample", "group")


@query("f7_subtypes", f"WITH {DESIGN} SELECT dataset, sample, subtype FROM design")
def f7_subtypes(spark, sf):
    return design(spark, sf).select("dataset", "sample", "subtype")


@query("f8_sample_times", f"WITH {DESIGN} SELECT dataset, sample, round(days, 6) AS days FROM design")
def f8_sample_times(spark, sf):
    return design(spark, sf).select("dataset", "sample", F.round("days", 6).alias("days"))


@query("f9_continuous_trait", f"""WITH {DESIGN} SELECT dataset, 'age' AS trait,
  count(coalesce(age, severity)) AS hits FROM design GROUP BY 1 HAVING count(coalesce(age, severity)) >= 6""")
def f9_continuous_trait(spark, sf):
    from tallyloom.operators.design import chosen_trait
    # trait names are matched inside keys, so "stage" also counts as "age"
    return chosen_trait(design(spark, sf), "dataset").select("dataset", "trait", "hits")


@query("f12_label_rules", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'late' WHEN event_type IN ('click', 'view')
  THEN 'early' ELSE 'unknown' END AS phase, CASE WHEN event_type = 'error' THEN 7 WHEN event_type IN ('click', 'view') THEN 1
  ELSE -1 END AS day FROM events""")
def f12_label_rules(spark, sf):
    from tallyloom.functions.rules import first_rule
    rules = [("error", ("late", 7)), ("click|view", ("early", 1))]
    label = first_rule(F.col("event_type"), [(p, v[0]) for p, v in rules], "unknown")
    day = first_rule(F.col("event_type"), [(p, v[1]) for p, v in rules], -1)
    return table(spark, sf, "events").select("event_id", label.alias("phase"), day.alias("day"))


@query("f14_subject_ids", r"""SELECT c_custkey, coalesce(nullif(regexp_extract(c_name, 'Subject ([0-9]+)', 1), ''),
  nullif(regexp_extract(c_name, '#0*([0-9]+)$', 1), ''), 'row') AS subject FROM customer""")
def f14_subject_ids(spark, sf):
    from tallyloom.functions.rules import first_extract
    name = first_extract(F.col("c_name"), ["Subject ([0-9]+)", "#0*([0-9]+)$"])
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(name, F.lit("row")).alias("subject"))


@query("f15_attribute_columns", f"""WITH {ATTRS}
SELECT dataset, sample, min(CASE WHEN regexp_matches(lower(text), 'stage|grade') THEN text END) AS severity,
  min(CASE WHEN regexp_matches(lower(text), 'tissue|source') THEN text END) AS origin,
  min(CASE WHEN regexp_matches(lower(text), 'respon|outcome') THEN text END) AS outcome FROM attrs GROUP BY 1, 2""")
def f15_attribute_columns(spark, sf):
    from tallyloom.functions.rules import typed_attributes
    rules = {"severity": "stage|grade", "origin": "tissue|source", "outcome": "respon|outcome"}
    return typed_attributes(attributes(spark, sf), ["dataset", "sample"], "text", rules)


@query("f16_typed_fields", r"""SELECT event_id, CAST(nullif(regexp_extract(props, '"k": ([0-9]+)', 1), '') AS INT) AS k,
  CASE WHEN regexp_extract(props, '"k": ([0-9]+)', 1) = '' THEN NULL ELSE CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) > 50 END AS high
FROM events""")
def f16_typed_fields(spark, sf):
    k = F.regexp_extract("props", r'"k": ([0-9]+)', 1).try_cast("int")
    return table(spark, sf, "events").select("event_id", k.alias("k"), (k > 50).alias("high"))


@query("f17_symbols", r"""WITH a AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Homo sapiens ' || p_name || ' (GX' || p_partkey || '), mRNA'
  WHEN 1 THEN p_name || ' (AB-' || p_partkey || ')[gene_biotype:coding]' WHEN 2 THEN 'TP' || p_partkey ELSE p_name || ' 12' END AS text FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'GX' || p_partkey WHEN 1 THEN 'AB-' || p_partkey WHEN 2 THEN 'TP' || p_partkey ELSE '' END AS symbol FROM a""")
def f17_symbols(spark, sf):
    from tallyloom.sources.platforms import symbol_in
    text = F.expr("""CASE p_partkey % 4 WHEN 0 THEN 'Homo sapiens ' || p_name || ' (GX' || p_partkey || '), mRNA'
      WHEN 1 THEN p_name || ' (AB-' || p_partkey || ')[gene_biotype:coding]' WHEN 2 THEN 'TP' || p_partkey ELSE p_name || ' 12' END""")
    return table(spark, sf, "part").select("p_partkey", symbol_in(text).alias("symbol"))


@query("f22_bins", """SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'medium'
  WHEN p_size > 30 AND p_size <= 50 THEN 'large' END AS bin FROM part""")
def f22_bins(spark, sf):
    bins = labels.right_closed_bin(F.col("p_size"), [0, 10, 30, 50], ["small", "medium", "large"])
    return table(spark, sf, "part").select("p_partkey", bins.alias("bin"))


@query("f23_words_for_thresholds", """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_tax < 0.001 THEN '***' WHEN l_tax < 0.01 THEN '**' WHEN l_tax < 0.05 THEN '*' ELSE 'ns' END AS stars,
  CASE WHEN l_quantity / 50 >= 0.8 THEN 'Large' WHEN l_quantity / 50 >= 0.5 THEN 'Medium' WHEN l_quantity / 50 >= 0.2 THEN 'Small' ELSE 'Negligible' END AS effect,
  CASE WHEN l_quantity / 50 >= 0.7 THEN 'Strong' WHEN l_quantity / 50 >= 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength,
  CASE WHEN l_quantity * 2 >= 90 THEN 'excellent' WHEN l_quantity * 2 >= 75 THEN 'good' WHEN l_quantity * 2 >= 60 THEN 'fair' ELSE 'poor' END AS level
FROM lineitem""")
def f23_words_for_thresholds(spark, sf):
    part = F.col("l_quantity") / 50
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", labels.stars(F.col("l_tax")).alias("stars"),
        labels.effect_word(part).alias("effect"), labels.correlation_strength(part).alias("strength"),
        labels.quality_level(F.col("l_quantity") * 2).alias("level"))


@query("f24_guarded_arithmetic", """SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_nationkey > 0 THEN round(log2(c_acctbal / c_nationkey), 6) END AS log2fc,
  CASE WHEN c_nationkey > 0 THEN round((c_acctbal + 1e-6) / (c_nationkey + 1e-6), 4) ELSE CAST('inf' AS DOUBLE) END AS ratio FROM customer""")
def f24_guarded_arithmetic(spark, sf):
    a, b = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    ratio = labels.guarded_ratio(a, b)
    return table(spark, sf, "customer").select(
        "c_custkey", F.round(labels.log2_fold_change(a, b), 6).alias("log2fc"),
        F.when(ratio < float("inf"), F.round(ratio, 4)).otherwise(ratio).alias("ratio"))


@query("f25_ordered_distinct", """WITH f AS (SELECT o_custkey, o_orderpriority, min(struct_pack(d := o_orderdate, k := o_orderkey)) AS first FROM orders GROUP BY 1, 2)
SELECT o_custkey, count(*) AS n, string_agg(o_orderpriority, ',' ORDER BY first) AS priorities FROM f GROUP BY 1""")
def f25_ordered_distinct(spark, sf):
    # first-seen order: each value's first place, then the values in that order
    first = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("first", "o_orderpriority"))), lambda e: e["o_orderpriority"])
    return first.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(packed, ",").alias("priorities"))


@query("f11_dataset_types", rf"""WITH {ATTRS}, m AS (SELECT *, lower(text) AS low, regexp_matches(lower(text), 'time|day|hour') AS timed, regexp_matches(lower(text), 'control|treatment|disease|normal|patient|group') AS grouped,
  regexp_extract(lower(text), '(\d+)\s*(day|hour|h|d)', 1) || substr(regexp_extract(lower(text), '(\d+)\s*(day|hour|h|d)', 2), 1, 1) AS short FROM attrs),
l AS (SELECT dataset, sample, arg_max(CASE WHEN short <> '' THEN short ELSE text END, pos) FILTER (timed) AS t, arg_max(text, pos) FILTER (grouped AND NOT timed) AS g FROM m GROUP BY 1, 2),
c AS (SELECT dataset, count(DISTINCT t) AS times, count(DISTINCT g) AS groups, coalesce(bool_or(regexp_matches(lower(g), 'disease|patient|control|normal|treatment')), false) AS w FROM l GROUP BY 1)
SELECT dataset, times, groups, CASE WHEN times >= 3 THEN 'time_series' WHEN groups >= 2 AND w THEN 'disease_control' ELSE 'other' END AS type FROM c""")
def f11_dataset_types(spark, sf):
    from tallyloom.operators import design as dz
    return dz.dataset_types(dz.simple_labels(attributes(spark, sf)))


@query("f26_json_fields", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  '{"type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS summary FROM events""")
def f26_json_fields(spark, sf):
    parsed = F.from_json("props", "k int")
    return table(spark, sf, "events").select(
        "event_id", parsed["k"].alias("k"),
        F.to_json(F.struct(F.col("event_type").alias("type"), parsed["k"].alias("k"))).alias("summary"))


@query("f27_varying_fields", """WITH x AS (SELECT c_nationkey AS dataset, CASE WHEN contains(lower(c_mktsegment), 'build') THEN 'site'
  WHEN contains(lower(c_mktsegment), 'auto') THEN 'car' ELSE 'other' END AS kind FROM customer)
SELECT dataset, kind, count(*) AS n FROM x WHERE dataset IN (SELECT dataset FROM x GROUP BY 1 HAVING count(DISTINCT kind) > 1) GROUP BY 1, 2""")
def f27_varying_fields(spark, sf):
    from tallyloom.functions.rules import first_rule
    kind = first_rule(F.lower("c_mktsegment"), [("build", "site"), ("auto", "car")], "other")
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("dataset"), kind.alias("kind"))
    counts = rows.groupBy("dataset", "kind").agg(F.count(F.lit(1)).alias("n"))
    varied = counts.groupBy("dataset").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1")
    return counts.join(varied, "dataset", "left_semi")


@query("f28_value_maps", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS state,
  'orders' AS origin FROM orders""")
def f28_value_maps(spark, sf):
    from tallyloom.functions.rules import mapped
    state = mapped(F.col("o_orderstatus"), {"F": "finished", "O": "open"}, "other")
    return table(spark, sf, "orders").select("o_orderkey", state.alias("state"), F.lit("orders").alias("origin"))


@query("f30_cleaned_text", r"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(
  regexp_replace(lower(text), '[^a-z\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 3 AND w NOT IN ('the', 'and', 'with', 'from')), ' ') AS words
FROM documents""")
def f30_cleaned_text(spark, sf):
    cleaned = F.split(F.regexp_replace(F.lower("text"), r"[^a-z\s]", " "), r"\s+")
    kept = F.filter(cleaned, lambda w: (F.length(w) > 3) & ~w.isin("the", "and", "with", "from"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(kept, " ").alias("words"))
