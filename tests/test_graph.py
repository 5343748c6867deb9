"""Closure, depth, information and similarity on a small diamond."""

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import graph as gr
from tallyloom.session import cut

#   1 <- 2 <- 4 <- 5     1 <- 3 <- 4     7 -> 6 (second root)
EDGES = [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (7, 6)]


@pytest.fixture
def diamond(spark):
    edges = spark.createDataFrame(EDGES, "child int, parent int")
    return edges, gr.closure(edges)


def test_closure_and_depth(diamond):
    edges, pairs = diamond
    got = {(r.node, r.ancestor): r.distance for r in pairs.collect()}
    assert got[(5, 1)] == 3 and got[(4, 1)] == 2 and len(got) == 5 + 4 + 1
    depth = {r.node: r.depth for r in gr.depths(edges, pairs).collect()}
    assert depth == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3, 6: 0, 7: 1}
    assert gr.cycle_nodes(pairs).count() == 0


def test_cycle_is_found_and_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "child int, parent int")
    assert {r.node for r in gr.cycle_nodes(gr.closure(edges)).collect()} == {1, 2, 3}
    assert {tuple(r) for r in gr.cycles(edges).collect()} == {(1, 1), (1, 2), (1, 3)}


def test_peeling(spark, diamond):
    assert gr.peeled(diamond[0]).isEmpty() and gr.is_acyclic(diamond[0]) and gr.cycles(diamond[0]).isEmpty()
    # two rings with a path between them, a tail above and one below, a loop of one node
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 6), (6, 4), (6, 7), (7, 8), (0, 1), (9, 9), (10, 9)], "child int, parent int")
    left = {tuple(r) for r in gr.peeled(edges).collect()}
    assert left == {(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 6), (6, 4), (9, 9)}
    assert {tuple(r) for r in gr.cycles(edges).collect()} == {(1, 1), (1, 2), (4, 4), (4, 5), (4, 6), (9, 9)} and not gr.is_acyclic(edges)


def brute_between(members, ancestors):
    groups = {}
    for g, v in members:
        groups.setdefault(g, []).append(ancestors.get(v, set()))
    cosine = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0
    return {(g, h): [cosine(a, b) for a in groups[g] for b in groups[h]] for g in groups for h in groups if g < h}


@pytest.mark.parametrize("hot", [64, 0])
def test_groups_without_a_common_ancestor(spark, monkeypatch, hot):
    monkeypatch.setattr(gr, "HOT_GROUPS", hot)
    monkeypatch.setattr(gr, "HOT_ANCESTORS", 2)
    edges = [(k, k // 2) for k in range(2, 30)] + [(100 + k, 100 + k // 2) for k in range(2, 20)]
    pairs = gr.closure(spark.createDataFrame(edges, "child int, parent int"))
    ancestors = {}
    for r in pairs.collect():
        ancestors.setdefault(r.node, set()).add(r.ancestor)
    members = [(f"g{k % 3}", k) for k in range(1, 30)] + [(f"h{k % 2}", 100 + k) for k in range(1, 20)] + [("lone", 1000), ("lone", 1001), ("one", 5)]
    df = spark.createDataFrame(members, "group string, node int")
    vectors, totals = gr.group_vectors(df, pairs)
    want = brute_between(members, ancestors)
    between = gr.between_groups(vectors, totals)
    got = {(r.group, r.other): r for r in between.collect()}
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key].similarity == pytest.approx(sum(values) / len(values)) and got[key].pairs == len(values)
    assert got["g0", "h1"].similarity == 0.0 and got["g0", "lone"].mean_shared == 0.0
    within = gr.within_groups(vectors, totals)
    one = gr.coherence(within, vectors, totals).first()
    several = {k: v for k, v in want.items() if "one" not in k}
    assert one.inter == pytest.approx(sum(sum(v) / len(v) for v in several.values()) / len(several)) and one.groups == 6
    assert one.separation == pytest.approx(1 - one.inter)
    apart = {r.group: r for r in gr.group_separation(within, between).collect()}
    assert apart["lone"].nearest == 0.0 and set(apart) == {"g0", "g1", "g2", "h0", "h1", "lone"}


def test_permutations_against_all_labelings(spark):
    from itertools import permutations as orders

    edges = [(11, 1), (12, 1), (13, 1), (21, 2), (22, 2), (23, 2)]
    pairs = gr.closure(spark.createDataFrame(edges, "child int, parent int"))
    nodes = [11, 12, 13, 21, 22, 23]
    members = spark.createDataFrame([("a" if v < 20 else "b", v) for v in nodes], "group string, node int")
    got = gr.permutation_test(members, pairs, permutations=400).first()
    assert got.intra == 1.0
    every = [order for order in orders(nodes) if len({v // 10 for v in order[:3]}) == 1]
    exact = len(every) / math.factorial(6)  # labelings that keep both families together
    assert abs(got.p_value - exact) < 0.05
    assert not gr.significant(spark.createDataFrame([(0.2,), (None,)], "p_value double")).filter("significant").count()
    assert gr.significant(spark.createDataFrame([(0.01,)], "p_value double")).first().significant


def test_graph_statistics(spark, diamond):
    edges = diamond[0].withColumn("relation", F.lit("is_a"))
    nodes = gr.nodes_of(edges).union(spark.createDataFrame([(50,)], "node int"))
    got = gr.graph_statistics(nodes, edges, ["is_a", "part_of"]).first().asDict()
    assert got == {"nodes": 8, "roots": 3, "leaves": 3, "edges": 6, "is_a": 6, "part_of": 0, "acyclic": True}


def test_dangling_parents_drop_out(spark):
    terms = spark.createDataFrame([("a", ["b", "zz"]), ("b", [])], "id string, is_a array<string>")
    assert [tuple(r) for r in gr.edges_of(terms, "id", {"is_a": "is_a"}).collect()] == [("a", "b", "is_a")]


def test_similarities(spark, diamond):
    edges, pairs = diamond
    info = gr.intrinsic_information(gr.nodes_of(edges), pairs)
    depth = gr.depths(edges, pairs)
    asked = spark.createDataFrame([(2, 3), (3, 2), (4, 5), (5, 5), (5, 7)], "a int, b int")
    got = {(r.a, r.b): r for r in gr.similarities(asked, pairs, info, depth).collect()}
    assert got[(2, 3)].lin == got[(3, 2)].lin == 0.0
    assert got[(5, 5)].lin == got[(5, 5)].jaccard == 1.0
    assert got[(5, 7)].resnik == got[(5, 7)].depth == 0.0
    ic4, ic5 = -math.log(2 / 5), -math.log(1 / 5)
    assert got[(4, 5)].lin == pytest.approx(2 * ic4 / (ic4 + ic5))
    assert got[(4, 5)].depth == pytest.approx(2 / 3) and got[(4, 5)].jaccard == pytest.approx(4 / 5)
    for row in got.values():
        for m in ("resnik", "lin", "jiang", "depth", "jaccard"):
            assert -1e-12 <= row[m] <= 1 + 1e-12


def test_annotation_information(spark, diamond):
    counts = spark.createDataFrame([(5, 3), (2, 1)], "node int, n int")
    got = {r.node: (r.annotations, r.ic) for r in gr.annotation_information(counts, diamond[1]).collect()}
    assert got[1] == (4, 0.0) and got[4][0] == 3 and got[4][1] == pytest.approx(-math.log(3 / 4))


def shuffled_rows(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_closure_grows_with_its_pairs(spark):
    edges = spark.createDataFrame([(k, k // d) for k in range(2, 6000) for d in (2, 3) if k >= d], "child int, parent int").distinct()
    before = shuffled_rows(spark)
    n = gr.closure(edges).count()
    assert shuffled_rows(spark) - before < 3 * n


@pytest.mark.parametrize("levels", [0, 2, 64])
def test_depths_without_the_closure(spark, monkeypatch, levels):
    monkeypatch.setattr(gr, "LEVELS", levels)
    # a shortcut, a ring that no root is above with a tail below it, and one below a root
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (4, 1), (5, 4), (11, 12), (12, 11), (13, 12), (14, 13), (14, 5), (21, 1), (21, 22), (22, 21)], "child int, parent int")
    got = {r.node: r.depth for r in gr.depths(edges).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 1, 5: 2, 11: 0, 12: 0, 13: 0, 14: 3, 21: 1, 22: 2}
    assert got == {r.node: r.depth for r in gr.depths(edges, gr.closure(edges)).collect()}


def test_vectors_are_summed_from_packed_lists(spark):
    edges = spark.createDataFrame([(k, k // d) for k in range(2, 3000) for d in (2, 3) if k >= d], "child int, parent int").distinct()
    lists = cut(gr.closure_lists(edges))
    n = gr.unpacked(lists).count()
    members = spark.range(1, 3000).select((F.col("id") % 3).alias("group"), F.col("id").cast("int").alias("node"))
    before = shuffled_rows(spark)
    vectors, totals = gr.group_vectors(members, lists)
    assert shuffled_rows(spark) - before < n and totals.agg(F.sum("ancestors")).first()[0] == vectors.agg(F.sum("c")).first()[0] == n


@pytest.mark.parametrize("levels", [0, 2, 64])
def test_closure_below_the_levels_and_on_cycles(spark, monkeypatch, levels):
    monkeypatch.setattr(gr, "LEVELS", levels)
    # a chain with shortcuts, a ring between two tails
    edges = [(k, k - 1) for k in range(1, 12)] + [(k, k - 4) for k in range(4, 12, 3)] + [(20, 5), (21, 20), (22, 21), (20, 22), (23, 22), (24, 23), (24, 2)]
    up = {}
    for child, parent in edges:
        up.setdefault(child, set()).add(parent)
    want = {}
    for node in up:
        front, distance = {node}, 0
        while front:
            distance += 1
            front = {p for v in front for p in up.get(v, ()) if (node, p) not in want}
            want.update({(node, p): distance for p in front})
    got = gr.closure(spark.createDataFrame(edges, "child int, parent int")).collect()
    assert {(r.node, r.ancestor): r.distance for r in got} == want and len(got) == len(want)


def test_permutations_send_no_table_of_members(spark, monkeypatch):
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString())
        return cut(df)

    edges = spark.createDataFrame([(k, k // 2) for k in range(2, 200)], "child int, parent int")
    pairs = gr.closure(edges)
    members = cut(spark.createDataFrame([(f"g{k % 3}", k) for k in range(1, 200)], "group string, node int"))
    monkeypatch.setattr(gr, "cut", kept)
    gr.permutation_test(members, pairs, permutations=3)
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]


@pytest.mark.parametrize("levels", [0, 2, 64])
@pytest.mark.parametrize("rows, broadcast", [(64, 200_000), (1, 200_000), (64, 0)])
def test_ancestor_lists_hold_what_the_closure_holds(spark, monkeypatch, levels, rows, broadcast):
    monkeypatch.setattr(gr, "LEVELS", levels)
    monkeypatch.setattr(gr, "ROW_LISTS", rows)
    monkeypatch.setattr(gr, "LIST_EDGES", 3)
    monkeypatch.setattr(gr, "TASK_EDGES", 4)
    monkeypatch.setattr(gr, "broadcast_rows", lambda _: broadcast)
    # shortcuts, an edge given twice, a node of many parents, a ring between two tails
    edges = spark.createDataFrame([(k, k - 1) for k in range(1, 9)] + [(8, k) for k in range(7)] + [(8, 7), (20, 5), (21, 20), (20, 21), (22, 21), (23, 22)],
                                  "child int, parent int")
    lists = gr.ancestor_lists(edges)
    got = [(r.node, a) for r in lists.collect() for a in r.ancestors]
    assert lists.columns == ["node", "ancestors"] and lists.groupBy("node").count().filter("count > 1").isEmpty()
    assert len(got) == len(set(got)) and set(got) == {(r.node, r.ancestor) for r in gr.closure(edges).collect()}
    assert gr.ancestor_lists(edges.limit(0)).count() == 0


def test_ancestors_are_counted_from_whole_lists(spark):
    edges = cut(spark.createDataFrame([(k, k // d) for k in range(2, 3000) for d in (2, 3) if k >= d], "child int, parent int").distinct())
    layered = gr.layers(edges)
    before = shuffled_rows(spark)
    pairs = gr.closure_lists(edges, layered)
    by_distance = shuffled_rows(spark) - before
    lists = gr.ancestor_lists(edges, layered)
    whole = shuffled_rows(spark) - before - by_distance
    # one row an edge and list, not one for each distance in it
    assert whole < by_distance / 3
    nodes = gr.nodes_of(edges)
    want = {tuple(r) for r in gr.intrinsic_information(nodes, gr.unpacked(pairs)).collect()}
    assert {tuple(r) for r in gr.intrinsic_information(nodes, gr.unpacked(lists)).collect()} == want


def tasks_of(df):
    """Numbers of tasks that the plan asks for by itself."""
    import re
    return {int(n) for n in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())}


def test_annotations_are_counted_once_and_spread_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(gr, "LIST_EDGES", 10)
    edges = spark.createDataFrame([(k, k // 2) for k in range(2, 100)], "child int, parent int")
    seen = spark.sparkContext.accumulator(0)

    def counted(k):
        seen.add(1)
        return k

    counts = spark.range(1, 100).select(F.udf(counted, "int")(F.col("id").cast("int")).alias("node"), F.lit(2).cast("long").alias("n"))
    out = gr.annotation_information(counts, gr.ancestor_lists(edges))
    assert tasks_of(out) == {1 + 98 // 10}
    got = {r.node: r.annotations for r in out.collect()}
    assert got[1] == 198 and got[2] == 2 * 63 and got[99] == 2 and len(got) == 99
    assert seen.value == 99


@pytest.mark.parametrize("task", [7, 500_000])
def test_overlaps_meet_in_bounded_tasks(spark, monkeypatch, task):
    monkeypatch.setattr(gr, "LIST_EDGES", 10)
    monkeypatch.setattr(gr, "TASK_EDGES", task)
    edges = [(k, k // d) for k in range(2, 60) for d in (2, 3) if k >= d]
    up = {k: set() for k in range(60)}
    for child, parent in edges:
        up[child] |= {parent} | up[parent]
    depth = {k: 0 for k in range(2)}
    for k in range(2, 60):
        depth[k] = 1 + min(depth[p] for c, p in edges if c == k)
    df = spark.createDataFrame(edges, "child int, parent int").distinct()
    asked = spark.createDataFrame([(k, (7 * k + 3) % 59 + 1) for k in range(1, 60)], "a int, b int")
    out = gr.overlap_similarities(asked, gr.ancestor_lists(df), gr.depths(df))
    assert not task == 7 or min(tasks_of(out)) > 1
    rows = {(r.a, r.b): r for r in out.collect()}
    assert len(rows) == 59
    for (a, b), r in rows.items():
        both, most = up[a] & up[b], max(depth[a], depth[b])
        want = 1.0 if a == b else max(depth[c] for c in both) / most if both and most else 0.0
        assert r.depth == pytest.approx(want)
        assert r.jaccard == pytest.approx(1.0 if a == b else len(both) / len(up[a] | up[b]) if both else 0.0)


@pytest.mark.parametrize("hot", [65_536, 20])
def test_labels_dealt_by_cuts_are_those_dealt_by_position(spark, monkeypatch, hot):
    monkeypatch.setattr(gr, "HOT_MEMBERS", hot)
    for name in ("TASK_NODES", "TASK_PAIRS", "BLOCK_PAIRS", "BLOCK_SUMS"):
        monkeypatch.setattr(gr, name, 150)
    edges = spark.createDataFrame([(f"n{k}", f"n{k // d}") for k in range(2, 400) for d in (2, 3) if k >= d], "child string, parent string").distinct()
    members = cut(spark.createDataFrame([(f"g{k * k % 7}", f"n{k}") for k in range(1, 420)] + [("alone", "x")], "group string, node string"))  # some have no ancestor
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).orderBy("group").toArrow()
    lists = gr.ancestor_lists(edges)
    by_cuts = {(r.draw, names[r.group]): r for names in [sizes.column("group").to_pylist()] for r in gr._sums_by_cuts(members, lists, sizes, 30, 42).collect()}
    by_position = gr._sums_by_position(members, gr.unpacked(lists), 30, 42).collect()
    assert len(by_cuts) == len(by_position) == 31 * sizes.num_rows
    for r in by_position:
        got = by_cuts[r.draw, r.group]
        assert (got.n, got.placed) == (r.n, r.placed) and got.norm == pytest.approx(r.norm or 0.0)
    assert [tuple(r) for r in gr.permutation_test(members, lists, 30).collect()] == [tuple(r) for r in gr.permutation_test(members, gr.closure(edges), 30).collect()]


@pytest.mark.parametrize("task", [500_000, 20])
def test_similarities_send_no_table_of_nodes(spark, monkeypatch, task):
    edges = cut(spark.createDataFrame([(k, k // d) for k in range(2, 200) for d in (2, 3) if k >= d], "child int, parent int").distinct())
    asked = cut(spark.createDataFrame([(k, k * 7 % 199 + 1) for k in range(1, 200)], "a int, b int"))
    pairs = cut(gr.closure(edges))
    info = cut(gr.intrinsic_information(gr.nodes_of(edges), pairs))
    depth = cut(gr.depths(edges))
    up, plans = {}, []
    for r in pairs.collect():
        up.setdefault(r.node, {r.node}).add(r.ancestor)
    above = {}
    for r in edges.collect():
        above.setdefault(r.child, set()).add(r.parent)
    deep = {r.node: r.depth for r in depth.collect()}

    def kept(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return cut(df)

    monkeypatch.setattr(gr, "cut", kept)
    monkeypatch.setattr(gr, "TASK_EDGES", task)
    monkeypatch.setattr(gr, "LIST_EDGES", task)
    out = gr.similarities(asked, gr.ancestor_lists(edges), info, depth, edges)
    got = {(r.a, r.b): r for r in out.collect()}
    whole = {(r.a, r.b): r for r in gr.similarities(asked, pairs, info, depth).collect()}
    assert len(got) == 199
    for (a, b), r in got.items():
        common = up.get(a, {a}) & up.get(b, {b})
        lowest = common - {p for c in common for p in above.get(c, ())}
        want = 1.0 if a == b else max(deep[c] for c in lowest) / max(deep[a], deep[b]) if common and max(deep[a], deep[b]) else 0.0
        assert r.depth == pytest.approx(want) and tuple(r) == pytest.approx(tuple(whole[a, b]))
    # the only table that is sent holds the ancestors that would fill a task alone
    last = out._jdf.queryExecution().sparkPlan().toString()
    assert not [p for p in plans if "BroadcastHashJoin" in p and "_hot" not in p] and last.count("BroadcastHashJoin") <= 2


def test_terms_are_not_sent_to_find_edges(spark):
    terms = cut(spark.createDataFrame([(k, [k // 2]) for k in range(1, 200)], "id int, is_a array<int>"))
    edges = gr.edges_of(terms, "id", {"is_a": "is_a"})
    assert "BroadcastHashJoin" not in edges._jdf.queryExecution().sparkPlan().toString() and edges.count() == 198
