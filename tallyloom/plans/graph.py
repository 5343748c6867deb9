"""Ontology operators on a multi-parent graph over the parts.

Part k has the parents k div 2 and k div 3 (k > 1), so part 1 is the root.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import graph as gr
from tallyloom.plans.common import r6
from tallyloom.plans.registry import query
from tallyloom.session import cut, table

def edges(spark, sf):
    terms = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") > 1, F.array(F.expr("p_partkey div 2"))).otherwise(F.array().cast("array<bigint>")).alias("is_a"),
        F.when(F.col("p_partkey") > 2, F.array(F.expr("p_partkey div 3"))).otherwise(F.array().cast("array<bigint>")).alias("part_of"))
    return gr.edges_of(terms, "id", {"is_a": "is_a", "part_of": "part_of"})


def closure_pairs(spark, sf):
    return gr.closure(cut(edges(spark, sf)))


def ancestor_lists(spark, sf):
    return gr.ancestor_lists(cut(edges(spark, sf)))


def written(spark, sf):
    """Edges, closure, information content and depth, each written once for the query that asks."""
    e = cut(edges(spark, sf))
    layered = gr.layers(e)
    pairs = gr.unpacked(gr.closure_lists(e, layered))
    return e, pairs, cut(gr.intrinsic_information(gr.nodes_of(e), pairs)), cut(gr.depths(e, pairs, layered))


EDGES = """e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent, 'is_a' AS relation FROM part WHERE p_partkey > 1
  UNION SELECT p_partkey, p_partkey // 3, 'part_of' FROM part WHERE p_partkey > 2)"""
CLOSURE = f"""RECURSIVE {EDGES}, w AS (SELECT DISTINCT child AS node, parent AS ancestor, 1 AS distance FROM e
  UNION SELECT w.node, e.parent, w.distance + 1 FROM w JOIN e ON w.ancestor = e.child),
clo AS (SELECT node, ancestor, min(distance) AS distance FROM w GROUP BY 1, 2),
nd AS (SELECT child AS node FROM e UNION SELECT parent FROM e),
rc AS (SELECT node, ancestor FROM clo UNION ALL SELECT node, node FROM nd),
dp AS (SELECT nd.node, coalesce(min(distance), 0) AS depth FROM nd LEFT JOIN clo ON nd.node = clo.node AND clo.ancestor = 1 GROUP BY 1),
ds AS (SELECT nd.node, count(clo.node) + 1 AS descendants FROM nd LEFT JOIN clo ON clo.ancestor = nd.node GROUP BY 1),
ic AS (SELECT node, descendants, -ln(descendants * 1.0 / (SELECT max(descendants) FROM ds)) AS ic FROM ds)"""


@query("d1_edges", f"WITH {EDGES} SELECT child, parent, relation FROM e")
def d1_edges(spark, sf):
    return edges(spark, sf)


@query("d2_cycles", f"WITH {CLOSURE} SELECT count(*) AS cycle_nodes FROM clo WHERE node = ancestor")
def d2_cycles(spark, sf):
    return gr.cycles(edges(spark, sf)).agg(F.count(F.lit(1)).alias("cycle_nodes"))


# lines link a supplier to the one seven further on by part, so suppliers form rings; every third ring is cut open
RINGS = """e AS (SELECT DISTINCT l_suppkey AS child, CASE WHEN l_suppkey % 5 < 4 THEN l_suppkey + 1 WHEN l_suppkey % 15 < 10 THEN l_suppkey - 4 ELSE l_suppkey + 1 END AS parent FROM lineitem)"""


@query("d2_cycle_members", f"""WITH RECURSIVE {RINGS}, w AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT w.node, e.parent FROM w JOIN e ON w.ancestor = e.child)
SELECT x.node, min(x.ancestor) AS cycle FROM w x JOIN w y ON y.node = x.ancestor AND y.ancestor = x.node GROUP BY 1""")
def d2_cycle_members(spark, sf):
    key = F.col("l_suppkey")
    up = F.when(key % 5 < 4, key + 1).when(key % 15 < 10, key - 4).otherwise(key + 1)
    return gr.cycles(table(spark, sf, "lineitem").select(key.alias("child"), up.alias("parent")))


@query("g14_graph_statistics", f"""WITH {EDGES} SELECT (SELECT count(*) FROM part) AS nodes, count(*) AS edges, count(*) FILTER (relation = 'is_a') AS is_a, count(*) FILTER (relation = 'part_of') AS part_of,
  (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT child FROM e)) AS roots, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT parent FROM e)) AS leaves, true AS acyclic FROM e""")
def g14_graph_statistics(spark, sf):
    """Nodes, edges by relation, roots, leaves, and whether there is no cycle."""
    e = cut(edges(spark, sf))
    return gr.graph_statistics(table(spark, sf, "part").select(F.col("p_partkey").alias("node")), e, ["is_a", "part_of"])


@query("d3_ancestors", f"WITH {CLOSURE} SELECT node, ancestor, distance FROM clo")
def d3_ancestors(spark, sf):
    return closure_pairs(spark, sf)


@query("d4_depths", f"WITH {CLOSURE} SELECT node, depth FROM dp")
def d4_depths(spark, sf):
    return gr.depths(cut(edges(spark, sf)))


@query("d5_ancestor_names", f"""WITH {CLOSURE}, nm AS (SELECT c.node, p_name, row_number() OVER (PARTITION BY c.node ORDER BY distance, ancestor) AS i, count(*) OVER (PARTITION BY c.node) AS n FROM clo c JOIN part ON p_partkey = c.ancestor)
SELECT node, max(n) AS ancestors, string_agg(p_name, '; ' ORDER BY i) AS names FROM nm WHERE i <= 5 GROUP BY 1""")
def d5_ancestor_names(spark, sf):
    from tallyloom.operators.ordering import top_rows
    pairs = closure_pairs(spark, sf)
    named = pairs.join(table(spark, sf, "part").select(F.col("p_partkey").alias("ancestor"), "p_name"), "ancestor")
    counts = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("ancestors"))
    near = top_rows(named, ["node"], [F.col("distance"), F.col("ancestor")], 5).groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("place", "p_name"))).alias("_n"))
    return counts.join(near, "node").select("node", "ancestors", F.array_join(F.transform("_n", lambda e: e["p_name"]), "; ").alias("names"))


@query("d6_intrinsic_information", f"WITH {CLOSURE} SELECT node, descendants, round(ic, 6) + 0 AS ic FROM ic")
def d6_intrinsic_information(spark, sf):
    e = cut(edges(spark, sf))
    return gr.intrinsic_information(gr.nodes_of(e), gr.unpacked(gr.ancestor_lists(e))).select("node", "descendants", (F.round("ic", 6) + 0).alias("ic"))


@query("d7_annotation_information", f"""WITH {CLOSURE}, k AS (SELECT l_partkey AS node, count(*) AS n FROM lineitem GROUP BY 1),
u AS (SELECT ancestor AS node, n FROM k JOIN clo USING (node) UNION ALL SELECT node, n FROM k), s AS (SELECT node, sum(n) AS a FROM u GROUP BY 1)
SELECT node, CAST(a AS BIGINT) AS annotations, round(-ln(a / (SELECT sum(n) FROM k)), 6) + 0 AS ic FROM s""")
def d7_annotation_information(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    out = gr.annotation_information(counts, ancestor_lists(spark, sf))
    return out.select("node", "annotations", (F.round("ic", 6) + 0).alias("ic"))


PAIRS = """pr AS (SELECT l_partkey AS a, (l_partkey * 7 + 3) % (SELECT max(p_partkey) FROM part) + 1 AS b FROM lineitem GROUP BY 1)"""
COMMON = f"""{CLOSURE}, {PAIRS}, cm AS (SELECT a, b, x.ancestor FROM pr JOIN rc x ON x.node = a JOIN rc y ON y.node = b AND y.ancestor = x.ancestor),
lo AS (SELECT * FROM cm WHERE (a, b, ancestor) NOT IN (SELECT cm.a, cm.b, c.ancestor FROM cm JOIN clo c ON c.node = cm.ancestor))"""


def node_pairs(spark, sf):
    most = table(spark, sf, "part").agg(F.max("p_partkey")).first()[0]
    nodes = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a")).distinct()
    return nodes.withColumn("b", (F.col("a") * 7 + 3) % most + 1)


@query("d8_lowest_common_ancestors", f"WITH {COMMON} SELECT a, b, ancestor FROM lo")
def d8_lowest_common_ancestors(spark, sf):
    _, pairs, information, _ = written(spark, sf)
    common = gr.common_ancestors(node_pairs(spark, sf), gr.with_self(pairs, information))
    return gr.lowest_common_ancestors(cut(common), pairs)


SIM = f"""cs AS (SELECT a, b, count(*) AS k, max(ic) AS mi FROM cm JOIN ic ON ic.node = ancestor GROUP BY 1, 2),
ls AS (SELECT a, b, max(depth) AS ld FROM lo JOIN dp ON dp.node = ancestor GROUP BY 1, 2),
nn AS (SELECT node, count(*) AS n FROM rc GROUP BY 1),
j AS (SELECT pr.a, pr.b, coalesce(k, 0) AS k, coalesce(mi, 0) AS mi, coalesce(ld, 0) AS ld, ia.ic AS ia, ib.ic AS ib, greatest(da.depth, db.depth) AS dd,
  coalesce(na.n, 0) + coalesce(nb.n, 0) AS t, (SELECT max(ic) FROM ic) AS mx FROM pr JOIN ic ia ON ia.node = a JOIN ic ib ON ib.node = b JOIN dp da ON da.node = a JOIN dp db ON db.node = b
  LEFT JOIN nn na ON na.node = a LEFT JOIN nn nb ON nb.node = b LEFT JOIN cs USING (a, b) LEFT JOIN ls USING (a, b)),
sim AS (SELECT a, b, CASE WHEN a = b THEN 1 WHEN k > 0 THEN mi / mx ELSE 0 END AS resnik, CASE WHEN a = b THEN 1 WHEN k > 0 AND ia + ib > 0 THEN 2 * mi / (ia + ib) ELSE 0 END AS lin,
  CASE WHEN a = b THEN 1 WHEN k > 0 THEN 1 - (ia + ib - 2 * mi) / (2 * mx) ELSE 0 END AS jiang, CASE WHEN a = b THEN 1 WHEN k > 0 AND dd > 0 THEN ld * 1.0 / dd ELSE 0 END AS depth,
  CASE WHEN a = b THEN 1 WHEN k > 0 THEN k * 1.0 / (t - k) ELSE 0 END AS jaccard FROM j)"""
MEASURES = ["resnik", "lin", "jiang", "depth", "jaccard"]


@query("d9_similarities", f"WITH {COMMON}, {SIM} SELECT a, b, {', '.join(f'round({m}, 6) + 0 AS {m}' for m in MEASURES)} FROM sim")
def d9_similarities(spark, sf):
    e = cut(edges(spark, sf))
    layered = gr.layers(e)
    lists = gr.ancestor_lists(e, layered)
    information = cut(gr.intrinsic_information(gr.nodes_of(e), gr.unpacked(lists)))
    out = gr.similarities(node_pairs(spark, sf), lists, information, cut(gr.depths(e, layered=layered)), e)
    return out.select("a", "b", *[(F.round(m, 6) + 0).alias(m) for m in MEASURES])


@query("d10_overlap_similarities", f"""WITH {CLOSURE}, {PAIRS}, nn AS (SELECT node, count(*) AS n FROM clo GROUP BY 1),
c AS (SELECT a, b, count(*) AS k, max(depth) AS md FROM pr JOIN clo x ON x.node = a JOIN clo y ON y.node = b AND y.ancestor = x.ancestor JOIN dp ON dp.node = x.ancestor GROUP BY 1, 2),
j AS (SELECT pr.a, pr.b, coalesce(k, 0) AS k, coalesce(md, 0) AS md, greatest(da.depth, db.depth) AS dd, coalesce(na.n, 0) + coalesce(nb.n, 0) AS t
  FROM pr JOIN dp da ON da.node = a JOIN dp db ON db.node = b LEFT JOIN nn na ON na.node = a LEFT JOIN nn nb ON nb.node = b LEFT JOIN c USING (a, b))
SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN k > 0 AND dd > 0 THEN round(md * 1.0 / dd, 6) ELSE 0 END AS depth,
  CASE WHEN a = b THEN 1.0 WHEN k > 0 THEN round(k * 1.0 / (t - k), 6) ELSE 0 END AS jaccard, CASE WHEN a = b THEN 1.0 WHEN k > 0 THEN round(k / (t / 2.0), 6) ELSE 0 END AS simple FROM j""")
def d10_overlap_similarities(spark, sf):
    e = cut(edges(spark, sf))
    layered = gr.layers(e)
    out = gr.overlap_similarities(node_pairs(spark, sf), gr.ancestor_lists(e, layered), cut(gr.depths(e, layered=layered)))
    return out.select("a", "b", *[F.round(m, 6).alias(m) for m in ("depth", "jaccard", "simple")])


def vectors_sql(column: str, tag: str = "") -> str:
    """Vectors, totals and the measures within and between the groups of a part column."""
    return f"""mem{tag} AS (SELECT {column} AS g, p_partkey AS node FROM part),
vec{tag} AS (SELECT g, ancestor, count(*) AS c, sum(1 / sqrt(n)) AS s FROM mem{tag} JOIN clo USING (node) JOIN sz USING (node) GROUP BY 1, 2),
sq{tag} AS (SELECT g, sum(c * (c - 1) / 2.0) AS shared, sum(s * s) AS norm FROM vec{tag} GROUP BY 1),
tot{tag} AS (SELECT g, k, total, placed, coalesce(shared, 0) AS shared, coalesce(norm, 0) AS norm FROM (SELECT g, count(*) AS k, coalesce(sum(n), 0) AS total, count(n) AS placed
  FROM mem{tag} LEFT JOIN sz USING (node) GROUP BY 1) LEFT JOIN sq{tag} USING (g)),
win{tag} AS (SELECT g, k, k * (k - 1) // 2 AS pairs, shared * 2 / (k * (k - 1)) AS mean_shared, coalesce(shared / nullif((k - 1) * total - shared, 0), 0) AS shared_ratio,
  (norm - placed) / (k * (k - 1)) AS similarity, greatest(placed - norm / k, 0) AS spread FROM tot{tag} WHERE k > 1),
dot{tag} AS (SELECT x.g, y.g AS o, sum(x.c * y.c) AS shared, sum(x.s * y.s) AS dot FROM vec{tag} x JOIN vec{tag} y ON x.ancestor = y.ancestor AND x.g < y.g GROUP BY 1, 2),
bet{tag} AS (SELECT d.g, d.o, a.k * b.k AS pairs, d.shared / (a.k * b.k) AS mean_shared, coalesce(d.shared / nullif(b.k * a.total + a.k * b.total - d.shared, 0), 0) AS shared_ratio,
  dot / (a.k * b.k) AS similarity, sqrt(greatest(a.norm / (a.k * a.k) + b.norm / (b.k * b.k) - 2 * dot / (a.k * b.k), 0)) AS distance
  FROM dot{tag} d JOIN tot{tag} a ON a.g = d.g JOIN tot{tag} b ON b.g = d.o)"""


SIZES = "sz AS (SELECT node, count(*) AS n FROM clo GROUP BY 1)"
GROUPS = f"{CLOSURE}, {SIZES}, {vectors_sql('p_type')}"


def groups(spark, sf, column="p_type", lists=None):
    """Vectors, and the measures within and between groups."""
    members = table(spark, sf, "part").select(F.col(column).alias("group"), F.col("p_partkey").alias("node"))
    vectors, totals = gr.group_vectors(members, lists or ancestor_lists(spark, sf))
    return vectors, gr.within_groups(vectors, totals), totals


def between(spark, sf):
    vectors, _, totals = groups(spark, sf)
    return gr.between_groups(vectors, totals)


@query("d12_within_groups", f"""WITH {GROUPS} SELECT g AS "group", k AS members, pairs, round(mean_shared, 6) AS mean_shared, round(shared_ratio, 6) AS shared_ratio,
  round(similarity, 6) AS similarity, round(spread, 6) AS spread FROM win""")
def d12_within_groups(spark, sf):
    return groups(spark, sf)[1].select("group", "members", "pairs", *[r6(c, c) for c in ("mean_shared", "shared_ratio", "similarity", "spread")])


@query("d13_between_groups", f"""WITH {GROUPS} SELECT g AS "group", o AS other, pairs, round(mean_shared, 6) AS mean_shared, round(shared_ratio, 6) AS shared_ratio,
  round(similarity, 6) AS similarity, round(distance, 5) AS distance FROM bet""")
def d13_between_groups(spark, sf):
    return between(spark, sf).select("group", "other", "pairs", *[r6(c, c) for c in ("mean_shared", "shared_ratio", "similarity")],
                                       F.round("distance", 5).alias("distance"))


COHERENCE = """SELECT intra, inter, intra / inter AS ratio, separation, groups, intra / inter >= 1.5 AS valid,
  ((means - whole / n) / (groups - 1)) / (spread / (n - groups)) AS calinski_harabasz FROM
  (SELECT avg(similarity) AS intra, sum(spread) AS spread, count(*) AS groups, sum(k) AS n FROM win{t}),
  (SELECT avg(similarity) AS inter, avg(1 - similarity) AS separation FROM bet{t}),
  (SELECT sum(norm / k) AS means FROM tot{t} WHERE k > 1), (SELECT sum(s * s) AS whole FROM (SELECT ancestor, sum(s) AS s FROM vec{t} JOIN win{t} USING (g) GROUP BY 1))"""
COHERENCE_COLUMNS = ["intra", "inter", "ratio", "separation", "calinski_harabasz"]


@query("d14_coherence", f"""WITH {GROUPS} SELECT {", ".join(f"round({c}, 5) AS {c}" for c in COHERENCE_COLUMNS)}, groups, valid FROM ({COHERENCE.format(t="")})""")
def d14_coherence(spark, sf):
    vectors, within, totals = groups(spark, sf)
    out = gr.coherence(within, vectors, totals)
    return out.select(*[F.round(c, 5).alias(c) for c in COHERENCE_COLUMNS], "groups", "valid")


@query("d15_group_separation", f"""WITH {GROUPS}, sd AS (SELECT g, o, similarity, distance FROM bet UNION ALL SELECT o, g, similarity, distance FROM bet),
x AS (SELECT sd.g, a.similarity AS own, sd.similarity, (sqrt(a.spread / a.k) + sqrt(b.spread / b.k)) / nullif(distance, 0) AS worst FROM sd JOIN win a ON a.g = sd.g JOIN win b ON b.g = sd.o),
y AS (SELECT g, max(own) AS intra, max(similarity) AS nearest, max(worst) AS davies_bouldin FROM x GROUP BY 1)
SELECT g AS "group", round(intra, 6) AS intra, round(nearest, 6) AS nearest, round(davies_bouldin, 3) AS davies_bouldin,
  round((intra - nearest) / greatest(1 - intra, 1 - nearest), 6) AS silhouette FROM y""")
def d15_group_separation(spark, sf):
    vectors, within, totals = groups(spark, sf)
    out = gr.group_separation(within, gr.between_groups(vectors, totals))
    return out.select("group", *[r6(c, c) for c in ("intra", "nearest", "silhouette")], F.round("davies_bouldin", 3).alias("davies_bouldin"))


# parts by oddness: the parent keeps it, so there are two hierarchies that share no ancestor
FOREST = """RECURSIVE e AS (SELECT p_partkey AS child, (p_partkey // 4) * 2 + p_partkey % 2 AS parent FROM part WHERE p_partkey > 3),
clo AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT w.node, e.parent FROM clo w JOIN e ON w.ancestor = e.child),
mem AS (SELECT p_type || p_partkey % 2 AS g, p_partkey AS node FROM part), sz AS (SELECT node, count(*) AS n FROM clo GROUP BY 1),
vec AS (SELECT g, ancestor, count(*) AS c, sum(1 / sqrt(n)) AS s FROM mem JOIN clo USING (node) JOIN sz USING (node) GROUP BY 1, 2),
tot AS (SELECT g, count(*) AS k, coalesce(sum(n), 0) AS total, count(n) AS placed FROM mem LEFT JOIN sz USING (node) GROUP BY 1),
dots AS (SELECT a.g, b.g AS o, coalesce(sum(x.s * y.s), 0) AS dot, coalesce(sum(x.c * y.c), 0) AS shared, max(a.k) AS ka, max(b.k) AS kb
  FROM tot a JOIN tot b ON a.g < b.g LEFT JOIN vec x ON x.g = a.g LEFT JOIN vec y ON y.g = b.g AND y.ancestor = x.ancestor GROUP BY 1, 2),
bet AS (SELECT *, dot / (ka * kb) AS similarity FROM dots)"""


def forest(spark, sf, closed=gr.closure):
    key = F.col("p_partkey")
    part = table(spark, sf, "part")
    e = part.filter(key > 3).select(key.alias("child"), (F.expr("p_partkey div 4") * 2 + key % 2).alias("parent"))
    members = part.select(F.concat("p_type", (key % 2).cast("string")).alias("group"), key.alias("node"))
    return members, closed(e)


@query("d13_groups_of_two_hierarchies", f"""WITH {FOREST} SELECT g AS "group", o AS other, ka * kb AS pairs, round(shared / (ka * kb), 6) AS mean_shared, round(similarity, 6) AS similarity FROM bet""")
def d13_groups_of_two_hierarchies(spark, sf):
    """Groups of different hierarchies have no common ancestor and still a row."""
    vectors, totals = gr.group_vectors(*forest(spark, sf))
    return gr.between_groups(vectors, totals).select("group", "other", "pairs", r6("mean_shared", "mean_shared"), r6("similarity", "similarity"))


@query("d14_coherence_of_two_hierarchies", f"""WITH {FOREST}, nm AS (SELECT g, sum(s * s) AS norm FROM vec GROUP BY 1),
win AS (SELECT g, (norm - placed) / (k * (k - 1)) AS similarity FROM tot JOIN nm USING (g) WHERE k > 1)
SELECT round(intra, 6) AS intra, round(inter, 6) AS inter, round(intra / inter, 5) AS ratio, intra / inter >= 1.5 AS valid, groups FROM
 (SELECT avg(similarity) AS intra, count(*) AS groups FROM win), (SELECT avg(similarity) AS inter FROM bet WHERE ka > 1 AND kb > 1)""")
def d14_coherence_of_two_hierarchies(spark, sf):
    vectors, totals = gr.group_vectors(*forest(spark, sf))
    out = gr.coherence(gr.within_groups(vectors, totals), vectors, totals)
    return out.select(r6("intra", "intra"), r6("inter", "inter"), F.round("ratio", 5).alias("ratio"), "valid", "groups")


@query("d18_permutation_test")
def d18_permutation_test(spark, sf):
    """Whether the two hierarchies' groups are more alike than labels dealt at random."""
    return gr.significant(gr.permutation_test(*forest(spark, sf, gr.ancestor_lists))).withColumn("intra", F.round("intra", 6))


LABELINGS = {"brand": "p_brand", "type": "p_type"}


@query("d16_labelings_compared", f"""WITH {CLOSURE}, {SIZES}, {", ".join(vectors_sql(c, "_" + n) for n, c in LABELINGS.items())},
l AS ({" UNION ALL ".join(f"SELECT '{n}' AS labeling, * FROM ({COHERENCE.format(t='_' + n)})" for n in LABELINGS)})
SELECT labeling, round(intra, 5) AS intra, round(inter, 5) AS inter, round(ratio, 5) AS ratio, valid, row_number() OVER (ORDER BY round(ratio, 5) DESC, labeling) AS place FROM l""")
def d16_labelings_compared(spark, sf):
    lists, out = ancestor_lists(spark, sf), None
    for name, column in LABELINGS.items():
        vectors, within, totals = groups(spark, sf, column, lists)
        one = gr.coherence(within, vectors, totals).select(
            F.lit(name).alias("labeling"), *[F.round(c, 5).alias(c) for c in ("intra", "inter", "ratio")], "valid")
        out = one if out is None else out.unionByName(one)
    # as many rows as labelings
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("ratio").desc(), "labeling")))


@query("d18_best_and_worst_group", f"""WITH {GROUPS}, m AS (SELECT g, round(similarity, 9) AS m FROM win)
SELECT arg_max(g, struct_pack(a := m, b := g)) AS best, arg_min(g, struct_pack(a := m, b := g)) AS worst FROM m""")
def d18_best_and_worst_group(spark, sf):
    return gr.extremes(groups(spark, sf)[1].withColumn("mean", F.round("similarity", 9)), F.col("group"))


@query("d18_most_and_least_similar_groups", f"""WITH {GROUPS}, m AS (SELECT g || '|' || o AS p, round(similarity, 9) AS m FROM bet)
SELECT arg_max(p, struct_pack(a := m, b := p)) AS best, arg_min(p, struct_pack(a := m, b := p)) AS worst FROM m""")
def d18_most_and_least_similar_groups(spark, sf):
    return gr.extremes(between(spark, sf).withColumn("mean", F.round("similarity", 9)), F.concat_ws("|", "group", "other"))
