"""Ancestor closures, information content, similarity and coherence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.joins import small_side
from tallyloom.operators.ordering import running, top_rows
from tallyloom.session import add, broadcast_rows, cut, new_table

#: Layers of a graph that are taken away and finished one by one.
LEVELS = 64
#: Edges whose lists one task merges.
LIST_EDGES = 25_000
#: Edges that one task joins while layers are taken away.
TASK_EDGES = 500_000
#: Lists of a node with at most this many parents are merged in one row.
ROW_LISTS = 64
#: Group names in one packed row when every two groups are laid out.
GROUP_CHUNK = 1000
#: Ancestors of more groups than this are carried as dense vectors, so many of them at most.
HOT_GROUPS, HOT_ANCESTORS = 64, 256
#: Labels dealt without ordering the members: groups that there may be, and numbers for all groups and draws.
DEALT_GROUPS, DEALT_NUMBERS = 4096, 4_000_000
#: Leading bits of a draw's keys that are counted, members (or pairs) of one task, pairs and sums looked at at once.
KEY_BITS, TASK_NODES, TASK_PAIRS, BLOCK_PAIRS, BLOCK_SUMS = 16, 500_000, 1_000_000, 65_536, 262_144
#: An ancestor of more of a task's members than this is added up there; the others' pairs travel.
HOT_MEMBERS = 65_536


def edges_of(terms: DataFrame, key: str, relations: dict[str, str]) -> DataFrame:
    """(child, parent, relation) out of array columns; parents that are no term
    themselves drop out."""
    parts = None
    for relation, column in relations.items():
        part = terms.select(F.col(key).alias("child"), F.explode(column).alias("parent"), F.lit(relation).alias("relation"))
        parts = part if parts is None else parts.unionByName(part)
    # terms are not sent: a compressed file of them looks small enough
    return parts.join(terms.select(F.col(key).alias("parent")).hint("merge"), "parent", "left_semi").select(
        "child", "parent", "relation").distinct()


def layers(edges: DataFrame) -> tuple[list[tuple[DataFrame, int]], DataFrame, bool]:
    """Edges dealt by when their children are taken away from below, nodes without children first.

    Returns the layers from the top down, each with its number of edges, then the edges that
    ``LEVELS`` rounds did not reach and whether there are any: cycles, what lies above them, the
    top of very long chains.  Parents of a layer's children lie in layers above it or in the
    rest.  A round reads only what the one before it left, so where most nodes lie low all
    rounds together read little more than the first.
    """
    left, dealt, more = cut(edges.select("child", "parent").distinct()), [], True
    kept = left.count()
    for _ in range(LEVELS):
        tasks = 1 + kept // TASK_EDGES
        inner = left.select(F.col("parent").alias("child")).repartition(tasks, "child").distinct().withColumn("_inner", F.lit(True))
        marked = cut(left.repartition(tasks, "child").join(inner.hint("merge"), "child", "left"))
        n, kept = marked.agg(F.count_if(F.col("_inner").isNull()), F.count("_inner")).first()
        if n:
            dealt.append((marked.filter("_inner IS NULL").select("child", "parent"), n))
        left, more = marked.filter("_inner").select("child", "parent"), kept > 0
        if not n or not kept:
            break
    return dealt[::-1], left, more if LEVELS else not left.isEmpty()


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance) for every pair, distance by the shortest path."""
    return unpacked(closure_lists(edges))


def closure_lists(edges: DataFrame, layered: tuple | None = None) -> DataFrame:
    """The closure as ``(node, distance, ancestors)``, the ancestors of a node at one distance in one list.

    Nodes are finished layer by layer from the roots on: a node whose parents
    are all finished takes over their lists, so a pair is derived once for each
    parent that has it, and travels packed.  What the ``layers`` don't reach is
    closed by doubling first.
    """
    levels, rest, more = layered or layers(edges)
    path = new_table(edges.sparkSession)
    finished = add(_packed(_doubled(rest)), path) if more else None
    for ready, n in levels:
        finished = add(_lists(ready, finished, n), path)
    return _lists(rest, None, 0) if finished is None else finished


def _lists(ready: DataFrame, finished: DataFrame | None, n: int) -> DataFrame:
    """(node, distance, ancestors) of nodes whose parents are finished; ``n`` edges."""
    one = F.lit(1).cast("long")
    taken = ready.select("child", one.alias("distance"), F.array("parent").alias("ancestors"))
    if finished is not None:
        above = finished.withColumnRenamed("node", "parent")
        taken = taken.unionByName(ready.join(above.hint("merge"), "parent").select("child", (F.col("distance") + 1).alias("distance"), "ancestors"))
    # lists are unpacked only once they have come to their node; a task has a bounded number of them
    each = taken.repartition(1 + n // LIST_EDGES, "child").select(F.col("child").alias("node"), "distance", F.explode("ancestors").alias("ancestor"))
    return _packed(each.groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))


def ancestor_lists(edges: DataFrame, layered: tuple | None = None) -> DataFrame:
    """The closure without distances as ``(node, ancestors)``, all ancestors of a node in one list.

    For whoever asks only which ancestors a node has: the lists of its parents
    are merged whole, where ``closure_lists`` has to look at each pair to find
    its distance.  A graph in which some node has over ``ROW_LISTS`` parents
    is merged pair by pair, as that node's lists together may fill no row.
    """
    levels, rest, more = layered or layers(edges)
    wide = (edges.select("child", "parent").distinct().groupBy("child").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > ROW_LISTS
    path = new_table(edges.sparkSession)
    finished, above = None, 0
    if more:
        finished, above = add(_whole(_doubled(rest)), path), rest.count()
    for ready, n in levels:
        finished = add(_merged(ready, finished, n, above, wide), path)
        above += n
    return _merged(rest, None, 0, 0, wide) if finished is None else finished


def _merged(ready: DataFrame, finished: DataFrame | None, n: int, above: int, wide: bool) -> DataFrame:
    """(node, ancestors) of nodes whose parents are finished; ``n`` edges, below about ``above`` finished nodes at most."""
    taken = ready.select("child", F.array("parent").alias("ancestors"))
    if finished is not None:
        taken = taken.unionByName(_upward(ready, finished, n, 1 + max(n, above) // LIST_EDGES).select("child", "ancestors"))
    dealt = taken.repartition(1 + n // LIST_EDGES, "child").withColumnRenamed("child", "node")
    if wide:
        return _whole(dealt.select("node", F.explode("ancestors").alias("ancestor")).distinct())
    return dealt.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("ancestors"))).alias("ancestors"))


def _upward(ready: DataFrame, finished: DataFrame, n: int, tasks: int) -> DataFrame:
    """Edges with what is known of their parents; a bounded number of edges goes to the finished nodes, which then stay."""
    known = finished.withColumnRenamed("node", "parent")
    if n <= broadcast_rows(ready.sparkSession):
        return known.join(F.broadcast(ready), "parent")
    return ready.repartition(tasks, "parent").join(known.repartition(tasks, "parent").hint("merge"), "parent")


def _whole(pairs: DataFrame) -> DataFrame:
    """One row a node, with all of its ancestors; such rows stay as they are."""
    if "ancestors" not in pairs.columns:
        return pairs.groupBy("node").agg(F.collect_list("ancestor").alias("ancestors"))
    if "distance" not in pairs.columns:
        return pairs
    return pairs.groupBy("node").agg(F.flatten(F.collect_list("ancestors")).alias("ancestors"))


def _packed(pairs: DataFrame) -> DataFrame:
    """Pairs as lists; lists stay as they are."""
    if "ancestors" in pairs.columns:
        return pairs
    return pairs.groupBy("node", "distance").agg(F.sort_array(F.collect_list("ancestor")).alias("ancestors"))


def unpacked(lists: DataFrame) -> DataFrame:
    return lists.select("node", F.explode("ancestors").alias("ancestor"), *[c for c in lists.columns if c == "distance"])


def _doubled(edges: DataFrame) -> DataFrame:
    """The closure by doubling: a round joins the pairs of exactly the longest distance so far with all that lie above
    their ends, which gives every pair up to twice as far; it ends once no pair is that far, so on cycles too."""
    known = cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")).distinct())
    reach = 1
    while True:
        far = known.filter(F.col("distance") == reach)
        if far.isEmpty():
            return known
        upper = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_up"), F.col("distance").alias("_more"))
        further = far.join(upper, "ancestor").select("node", F.col("_up").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance"))
        known = cut(known.unionByName(further).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        reach *= 2


def cycle_nodes(pairs: DataFrame) -> DataFrame:
    """Nodes that are their own ancestors; none in an acyclic graph."""
    return pairs.filter(F.col("node") == F.col("ancestor")).select("node")


def nearest_ancestors(edges: DataFrame, n: int = 5) -> DataFrame:
    """``(node, ancestor, distance, place)``: the ``n`` nearest ancestors of every node, equally near ones in order.

    Climbs level by level, and a node stops once it has ``n``: at most ``n``
    rounds, and no closure.
    """
    up = cut(edges.select("child", "parent").distinct())
    level = up.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    known = cut(top_rows(level, ["node"], [F.col("ancestor")], n).drop("place"))
    front = known
    for distance in range(2, n + 1):
        full = known.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select("node")
        # a level is only climbed from by nodes that are not full, and those hold the whole level
        above = front.join(full, "node", "left_anti").join(up.withColumnRenamed("child", "ancestor"), "ancestor").select(
            "node", F.col("parent").alias("ancestor")).distinct().join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
        front = cut(top_rows(above.filter("node <> ancestor"), ["node"], [F.col("ancestor")], n).drop("place").withColumn("distance", F.lit(distance)))
        if front.isEmpty():
            break
        known = cut(known.unionByName(front))
    return top_rows(known, ["node"], [F.col("distance"), F.col("ancestor")], n)


def ancestor_names(nearest: DataFrame, names: DataFrame) -> DataFrame:
    """``(node, ancestor_names)``: names of the nearest ancestors, nearest first; ``names (node, name)``."""
    named = nearest.join(names.select(F.col("node").alias("ancestor"), "name"), "ancestor")
    return named.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda e: e["name"]).alias("ancestor_names"))


def peeled(edges: DataFrame) -> DataFrame:
    """``(child, parent)``: what is left of the edges once nodes without parents,
    and nodes without children, are taken away round by round.

    Nothing is left of an acyclic graph.  Else every cycle is left, and the
    paths that lead from one cycle to another.  A round reads only the edges
    that the one before it left; there are half as many as the longest path
    has nodes.
    """
    left = cut(edges.select("child", "parent").distinct())
    n = left.count()
    while n:
        below, above = left.select(F.col("child").alias("parent")).distinct(), left.select(F.col("parent").alias("child")).distinct()
        # an edge stays if its parent has a parent itself, and its child a child
        left = cut(left.join(below, "parent", "left_semi").join(above, "child", "left_semi"))
        now = left.count()
        if now == n:
            break
        n = now
    return left


def is_acyclic(edges: DataFrame) -> bool:
    return peeled(edges).isEmpty()


def cycles(edges: DataFrame) -> DataFrame:
    """``(cycle, node)``: nodes that lie on a common cycle, named by the smallest of them.

    Two nodes are on one cycle if each can be reached from the other; reach is
    only worked out for what peeling left.
    """
    reach = closure(peeled(edges)).select("node", "ancestor")
    back = reach.select(F.col("ancestor").alias("node"), F.col("node").alias("ancestor"))
    mutual = reach.join(back, ["node", "ancestor"], "left_semi")
    return mutual.groupBy("node").agg(F.min("ancestor").alias("cycle")).select("cycle", "node")


def graph_statistics(nodes: DataFrame, edges: DataFrame, relations: Sequence[str]) -> DataFrame:
    """One row: nodes, edges, edges of each relation, roots, leaves, and ``acyclic``."""
    above = edges.select(F.col("child").alias("node")).distinct().withColumn("_up", F.lit(1))
    below = edges.select(F.col("parent").alias("node")).distinct().withColumn("_down", F.lit(1))
    of_nodes = nodes.select("node").distinct().join(above, "node", "left").join(below, "node", "left").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("_up").isNull()).alias("roots"), F.count_if(F.col("_down").isNull()).alias("leaves"))
    of_edges = edges.agg(F.count(F.lit(1)).alias("edges"), *[F.count_if(F.col("relation") == r).alias(r) for r in relations])
    return of_nodes.join(F.broadcast(of_edges)).withColumn("acyclic", F.lit(is_acyclic(edges)))  # one row each


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()


def depths(edges: DataFrame, pairs: DataFrame | None = None, layered: tuple | None = None) -> DataFrame:
    """Shortest distance from a root (a node without parents); roots are 0, and so are nodes without a root above them.

    Layers take it over from their parents, without the closure; only what the
    ``layers`` don't reach needs the ``pairs`` among itself.
    """
    levels, rest, more = layered or layers(edges)
    nodes = nodes_of(edges)
    roots = nodes.join(edges.select(F.col("child").alias("node")).hint("merge"), "node", "left_anti")
    path = new_table(edges.sparkSession)
    known = add(roots.select("node", F.lit(0).cast("long").alias("depth")), path)
    if more:
        below = (_doubled(rest) if pairs is None else pairs.join(rest.select(F.col("child").alias("node")).hint("merge"), "node", "left_semi"))
        known = add(below.join(small_side(cut(roots.select(F.col("node").alias("ancestor")))), "ancestor", "left_semi").groupBy("node").agg(
            F.min("distance").alias("depth")), path)
    placed = 0
    for ready, n in levels:
        placed += n
        met = _upward(ready, known, n, 1 + placed // TASK_EDGES)
        known = add(met.groupBy(F.col("child").alias("node")).agg((F.min("depth") + 1).alias("depth")), path)
    return nodes.join(known.hint("merge"), "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))


def intrinsic_information(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """-ln of the share of descendants (self included) of the largest such count."""
    below = pairs.groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("_n"))
    sized = cut(nodes.join(below.hint("merge"), "node", "left").select("node", (F.coalesce("_n", F.lit(0)) + 1).alias("descendants")))
    most = sized.agg(F.max("descendants")).first()[0]
    return sized.withColumn("ic", -F.ln(F.col("descendants") / F.lit(most)))


def annotation_information(counts: DataFrame, pairs: DataFrame, node: str = "node", n: str = "n") -> DataFrame:
    """-ln of the share of annotations at or below each node."""
    counts = cut(counts)
    total = counts.agg(F.sum(n)).first()[0]
    lists = cut(_whole(pairs)) if "ancestor" in pairs.columns else pairs
    tasks = 1 + lists.count() // LIST_EDGES
    up = counts.repartition(tasks, node).join(lists.withColumnRenamed("node", node).repartition(tasks, node).hint("merge"), node).select(
        F.explode("ancestors").alias("node"), n)
    spread = up.unionByName(counts.select(F.col(node).alias("node"), n)).groupBy("node").agg(F.sum(n).alias("annotations"))
    return spread.withColumn("ic", -F.ln(F.col("annotations") / F.lit(total)))


def common_ancestors(node_pairs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor) that both sides have."""
    left = node_pairs.join(pairs.select(F.col("node").alias("a"), "ancestor"), "a")
    return left.join(pairs.select(F.col("node").alias("b"), "ancestor"), ["b", "ancestor"]).select("a", "b", "ancestor")


def lowest_common_ancestors(common: DataFrame, pairs: DataFrame) -> DataFrame:
    """Common ancestors no other common ancestor lies below.

    All ancestors of a common one are common too, so one that has others below it has one of them as a child.
    """
    higher = common.join(pairs.filter("distance = 1").select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_up")), "ancestor").select(
        "a", "b", F.col("_up").alias("ancestor"))
    return common.join(higher, ["a", "b", "ancestor"], "left_anti")


def with_self(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The closure with every node as its own ancestor at distance 0."""
    return pairs.select("node", "ancestor", "distance").unionByName(
        nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")))


def _guarded(condition: Column, value: Column) -> Column:
    """1 for a node with itself, ``value`` where anything is shared, else 0."""
    return F.when(F.col("a") == F.col("b"), 1.0).when((F.col("_common") > 0) & condition, value).otherwise(0.0)


def similarities(node_pairs: DataFrame, pairs: DataFrame, information: DataFrame, depth: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Resnik, Lin, Jiang, depth and Jaccard similarity of each pair, every
    node counting as its own ancestor.

    Information falls towards the root, so its maximum over all common
    ancestors is the one over the lowest; depth needs the lowest themselves.
    ``pairs`` may be the closure's lists; without distances they need the ``edges``.
    No table as long as the nodes is sent: a written one looks small enough, as its files are compressed.
    """
    if edges is None:
        edges = pairs.filter("distance = 1").select(F.col("node").alias("child"), F.col("ancestor").alias("parent"))
    own = cut(_whole(pairs)) if "ancestor" in pairs.columns else _whole(pairs)
    node_pairs = cut(node_pairs)
    of_nodes, of_pairs = 1 + information.count() // LIST_EDGES, 1 + node_pairs.count() // LIST_EDGES
    by_node = lambda df: df.repartition(of_nodes, "node").hint("merge")
    known = by_node(information.select("node", "ic")).join(by_node(depth), "node")
    every = F.concat(F.array("node"), F.coalesce("ancestors", F.array().cast(own.schema["ancestors"].dataType)))
    side = known.join(by_node(own), "node", "left").withColumn("_all", every)
    end = lambda s: side.select(F.col("node").alias(s), F.col("ic").alias(f"_ic_{s}"), F.col("depth").alias(f"_d_{s}"),
                                F.col("_all").alias(f"_all_{s}")).repartition(of_pairs, s).hint("merge")
    # a node's list travels to its pair whole; only what both have is unpacked
    met = cut(node_pairs.repartition(of_pairs, "a").join(end("a"), "a").repartition(of_pairs, "b").join(end("b"), "b").select(
        "a", "b", "_ic_a", "_ic_b", "_d_a", "_d_b", F.size("_all_a").alias("_n_a"), F.size("_all_b").alias("_n_b"), F.array_intersect("_all_a", "_all_b").alias("_both")))
    largest = information.agg(F.max("ic")).first()[0]
    parents = edges.groupBy(F.col("child").alias("node")).agg(F.collect_set("parent").alias("_up"))
    values = cut(known.join(by_node(parents), "node", "left").select(F.col("node").alias("ancestor"), "ic", "depth", "_up"))
    each = met.select("a", "b", F.explode("_both").alias("ancestor"))
    held = cut(each.groupBy("ancestor").agg(F.count(F.lit(1)).alias("_n")))
    tasks = 1 + (held.agg(F.sum("_n")).first()[0] or 0) // TASK_EDGES
    # ancestors that would fill a task alone are fewer than tasks: what is known of them is sent, only the others are joined
    hot = cut(held.filter(F.col("_n") > TASK_EDGES).select("ancestor").hint("merge").join(values, "ancestor").select("ancestor", F.struct("ic", "depth", "_up").alias("_hot")))
    split = each.join(F.broadcast(hot), "ancestor", "left")
    cold = split.filter("_hot IS NULL").select("a", "b", "ancestor").repartition(tasks, "ancestor").join(
        values.repartition(tasks, "ancestor").hint("merge"), "ancestor").select("a", "b", "ancestor", "ic", "depth", "_up")
    common = split.filter("_hot IS NOT NULL").select("a", "b", "ancestor", "_hot.*").unionByName(cold)
    # all ancestors of a common one are common too, so one that has others below it has one of them as a child
    by_pair = common.repartition(tasks, "a", "b").groupBy("a", "b").agg(
        F.max("ic").alias("_ic"), F.collect_list(F.struct("ancestor", "depth")).alias("_each"), F.flatten(F.collect_list("_up")).alias("_higher")).withColumn(
        "_lowest", F.array_except(F.transform("_each", lambda e: e["ancestor"]), "_higher")).select(
        "a", "b", "_ic", F.array_max(F.transform(F.filter("_each", lambda e: F.array_contains("_lowest", e["ancestor"])), lambda e: e["depth"])).alias("_low"))
    rows = met.repartition(tasks, "a", "b").join(by_pair.hint("merge"), ["a", "b"], "left").withColumn("_common", F.size("_both")).fillna(0, ["_ic", "_low"])
    ic_sum, deepest = F.col("_ic_a") + F.col("_ic_b"), F.greatest("_d_a", "_d_b")
    total = F.col("_n_a") + F.col("_n_b")
    return rows.select(
        "a", "b",
        _guarded(F.lit(largest > 0), F.col("_ic") / F.lit(largest)).alias("resnik"),
        _guarded(ic_sum > 0, 2 * F.col("_ic") / ic_sum).alias("lin"),
        _guarded(F.lit(largest > 0), 1 - (ic_sum - 2 * F.col("_ic")) / F.lit(2 * largest)).alias("jiang"),
        _guarded(deepest > 0, F.col("_low") / deepest).alias("depth"),
        _guarded(total > 0, F.col("_common") / (total - F.col("_common"))).alias("jaccard"),
    )


def overlap_similarities(node_pairs: DataFrame, pairs: DataFrame, depth: DataFrame) -> DataFrame:
    """Depth (over all common ancestors), Jaccard and simple similarity on
    proper ancestors, as the coherence report uses them."""
    own = (cut(_whole(pairs)) if "ancestor" in pairs.columns else _whole(pairs)).withColumnRenamed("ancestors", "_all")
    # a task has a bounded number of nodes and of pairs, each with its lists
    node_pairs = cut(node_pairs)
    of_nodes, of_pairs = 1 + depth.count() // LIST_EDGES, 1 + node_pairs.count() // LIST_EDGES
    side = depth.repartition(of_nodes, "node").join(own.repartition(of_nodes, "node").hint("merge"), "node", "left")
    end = lambda s: side.select(F.col("node").alias(s), F.col("depth").alias(f"_d_{s}"), F.col("_all").alias(f"_all_{s}")).repartition(of_pairs, s).hint("merge")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    # a node's list travels to its pair whole; only what both have is unpacked
    met = cut(node_pairs.repartition(of_pairs, "a").join(end("a"), "a").repartition(of_pairs, "b").join(end("b"), "b").select(
        "a", "b", "_d_a", "_d_b", size("_all_a").alias("_n_a"), size("_all_b").alias("_n_b"), F.array_intersect("_all_a", "_all_b").alias("_both")))
    dp = depth.select(F.col("node").alias("ancestor"), "depth")
    each = met.select("a", "b", F.explode("_both").alias("ancestor"))
    held = cut(each.groupBy("ancestor").agg(F.count(F.lit(1)).alias("_n")))
    tasks = 1 + (held.agg(F.sum("_n")).first()[0] or 0) // TASK_EDGES
    # ancestors that would fill a task alone are fewer than tasks: their depths are sent, only the others are joined
    hot = cut(held.filter(F.col("_n") > TASK_EDGES).select("ancestor").join(dp, "ancestor").withColumnRenamed("depth", "_hot"))
    split = each.join(F.broadcast(hot), "ancestor", "left")
    cold = split.filter("_hot IS NULL").select("a", "b", "ancestor").repartition(tasks, "ancestor").join(
        dp.repartition(tasks, "ancestor").hint("merge"), "ancestor").select("a", "b", "depth")
    deep = split.filter("_hot IS NOT NULL").select("a", "b", F.col("_hot").alias("depth")).unionByName(cold).repartition(tasks, "a", "b").groupBy(
        "a", "b").agg(F.max("depth").alias("_deep"))
    rows = met.repartition(tasks, "a", "b").join(deep.hint("merge"), ["a", "b"], "left").withColumn("_common", size("_both")).fillna(0, ["_deep"])
    deepest, total = F.greatest("_d_a", "_d_b"), F.col("_n_a") + F.col("_n_b")
    return rows.select(
        "a", "b",
        _guarded(deepest > 0, F.col("_deep") / deepest).alias("depth"),
        _guarded(total > 0, F.col("_common") / (total - F.col("_common"))).alias("jaccard"),
        _guarded(total > 0, F.col("_common") / (total / 2)).alias("simple"),
    )


def group_vectors(members: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums from which the similarity of all pairs of members follows, without a pair row.

    Vectors ``(group, ancestor, c, s)``: how many members have the ancestor,
    and the sum of the members' unit vectors.  Totals ``(group, members,
    ancestors, placed)``: members, their ancestors together, and those that
    have any.  Both are written once.  ``pairs`` may be the closure's lists.
    """
    lists = _packed(pairs)
    sizes = cut(lists.groupBy("node").agg(F.sum(F.size("ancestors").cast("long")).alias("_n")))
    # lists are unpacked only once their node's group is known, and are added up before they travel
    weighed = members.join(sizes.hint("merge"), "node").join(lists.hint("merge"), "node").select("group", "_n", F.explode("ancestors").alias("ancestor"))
    vectors = cut(weighed.groupBy("group", "ancestor").agg(F.count(F.lit(1)).alias("c"), F.sum(1 / F.sqrt("_n")).alias("s")))
    totals = cut(members.join(sizes.hint("merge"), "node", "left").groupBy("group").agg(
        F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("_n"), F.lit(0)).alias("ancestors"), F.count("_n").alias("placed")))
    return vectors, totals


def within_groups(vectors: DataFrame, totals: DataFrame) -> DataFrame:
    """Over all pairs of a group's members: mean shared ancestors, ratio of sums
    of shared to joint ancestors, mean cosine; and the spread of the unit
    vectors around their mean.  Groups of one member have no pair and drop out."""
    sums = vectors.groupBy("group").agg(
        F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("_shared"), F.sum(F.col("s") * F.col("s")).alias("_norm"))
    rows = totals.filter("members > 1").join(sums, "group", "left").fillna(0.0, ["_shared", "_norm"])
    pairs = F.col("members") * (F.col("members") - 1) / 2
    joint = (F.col("members") - 1) * F.col("ancestors") - F.col("_shared")
    return rows.select(
        "group", "members", pairs.cast("long").alias("pairs"), (F.col("_shared") / pairs).alias("mean_shared"),
        F.coalesce(F.try_divide(F.col("_shared"), joint), F.lit(0.0)).alias("shared_ratio"),
        ((F.col("_norm") - F.col("placed")) / 2 / pairs).alias("similarity"),
        F.greatest(F.col("placed") - F.col("_norm") / F.col("members"), F.lit(0.0)).alias("spread"))


def every_two_groups(totals: DataFrame) -> DataFrame:
    """``(group, other)``, group before other, from packed lists of the groups; as many rows as the result has to have."""
    groups = totals.select("group").distinct()
    chunks = max(1, -(-groups.count() // GROUP_CHUNK))
    packed = groups.groupBy(F.pmod(F.xxhash64("group"), F.lit(chunks)).alias("_chunk")).agg(F.array_sort(F.collect_list("group")).alias("_groups"))
    each = groups.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    later = F.filter("_groups", lambda g: g > F.col("group"))
    return each.join(small_side(packed), "_chunk").select("group", F.explode(later).alias("other"))


def between_groups(vectors: DataFrame, totals: DataFrame) -> DataFrame:
    """The same measures over all pairs of members of every two groups (group < other), and the distance of their mean vectors.

    Groups without a common ancestor have a similarity of 0.  The ancestors
    that most groups hold, a bounded number, would meet all groups in one
    task: they are carried along with each group as a dense vector, and only
    the others are joined.
    """
    held = vectors.groupBy("ancestor").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_GROUPS)
    hot = cut(held.orderBy(F.col("_n").desc(), "ancestor").limit(HOT_ANCESTORS).select("ancestor", F.lit(True).alias("_hot")))
    split = cut(vectors.join(F.broadcast(hot), "ancestor", "left"))
    dense = split.filter("_hot").groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("ancestor", F.struct("c", "s")))).alias("_dense"))
    cold = split.filter("_hot IS NULL")
    right = cold.select(F.col("group").alias("other"), "ancestor", F.col("c").alias("_c"), F.col("s").alias("_s"))
    both = cold.join(right, "ancestor").filter("group < other").groupBy("group", "other").agg(
        F.sum(F.col("c") * F.col("_c")).alias("_cold_shared"), F.sum(F.col("s") * F.col("_s")).alias("_cold_dot"))
    norms = totals.join(vectors.groupBy("group").agg(F.sum(F.col("s") * F.col("s")).alias("norm")), "group", "left").fillna(0.0, ["norm"]).join(dense, "group", "left")
    side = lambda name, end: norms.select(F.col("group").alias(name), *[F.col(c).alias(c + end) for c in ("members", "ancestors", "norm", "_dense")])
    rows = every_two_groups(totals).join(side("group", "_a"), "group").join(side("other", "_b"), "other").join(both, ["group", "other"], "left")
    common = F.array_intersect(F.map_keys("_dense_a"), F.map_keys("_dense_b"))

    def product(field: str, start: Column) -> Column:
        return F.coalesce(F.aggregate(common, start, lambda t, a: t + F.col("_dense_a")[a][field] * F.col("_dense_b")[a][field]), start)

    rows = rows.withColumns({
        "_shared": F.coalesce("_cold_shared", F.lit(0)) + product("c", F.lit(0).cast("long")),
        "_dot": F.coalesce("_cold_dot", F.lit(0.0)) + product("s", F.lit(0.0))})
    n_a, n_b = F.col("members_a"), F.col("members_b")
    joint = n_b * F.col("ancestors_a") + n_a * F.col("ancestors_b") - F.col("_shared")
    square = F.col("norm_a") / (n_a * n_a) + F.col("norm_b") / (n_b * n_b) - 2 * F.col("_dot") / (n_a * n_b)
    return rows.select(
        "group", "other", (n_a * n_b).alias("pairs"), (F.col("_shared") / (n_a * n_b)).alias("mean_shared"),
        F.coalesce(F.try_divide(F.col("_shared"), joint), F.lit(0.0)).alias("shared_ratio"),
        (F.col("_dot") / (n_a * n_b)).alias("similarity"), F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance"))


def pair_statistics(scored: DataFrame, keys: list[str], score: str) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.min(score).alias("min"),
        F.max(score).alias("max"), F.count(F.lit(1)).alias("pairs"))


def coherence(within: DataFrame, vectors: DataFrame, totals: DataFrame, threshold: float = 1.5) -> DataFrame:
    """One row: mean similarity within and between groups, their ratio and
    verdict, and the Calinski-Harabasz ratio of the unit vectors.

    Groups of two members or more count.  The mean over all pairs of groups
    follows from the sum of the groups' mean vectors, so no pair of groups is
    looked at, and those without a common ancestor count as 0.
    """
    inner = within.agg(F.avg("similarity").alias("intra"), F.sum("spread").alias("spread"),
                       F.count(F.lit(1)).alias("groups"), F.sum("members").alias("_members"))
    several = vectors.join(totals.filter("members > 1").select("group", "members"), "group").withColumn("_mean", F.col("s") / F.col("members"))
    own = several.agg(F.sum(F.col("s") * F.col("_mean")).alias("_means"), F.sum(F.col("_mean") * F.col("_mean")).alias("_squares"))
    whole = several.groupBy("ancestor").agg(F.sum("s").alias("_s"), F.sum("_mean").alias("_m")).agg(
        F.sum(F.col("_s") * F.col("_s")).alias("_whole"), F.sum(F.col("_m") * F.col("_m")).alias("_sum"))
    one = inner
    for part in (own, whole):  # one row each
        one = one.join(F.broadcast(part))
    pairs = F.col("groups") * (F.col("groups") - 1) / 2
    one = one.withColumn("inter", F.when(pairs > 0, F.coalesce((F.col("_sum") - F.col("_squares")) / 2, F.lit(0.0)) / pairs))
    apart = F.col("_means") - F.col("_whole") / F.col("_members")
    # what rounding leaves of groups that share nothing is no similarity
    ratio = F.when(F.col("inter") > 1e-12, F.col("intra") / F.col("inter")).otherwise(F.lit(float("inf")))
    spread = F.try_divide(apart / (F.col("groups") - 1), F.col("spread") / (F.col("_members") - F.col("groups")))
    return one.withColumns({"separation": 1 - F.col("inter"), "ratio": ratio, "valid": ratio >= threshold, "calinski_harabasz": spread}).select(
        "intra", "spread", "groups", "inter", "separation", "ratio", "valid", "calinski_harabasz")


def group_separation(within: DataFrame, between: DataFrame) -> DataFrame:
    """Per group: centroid silhouette, the worst spread-to-distance ratio, and the mean similarity to the other groups
    with the score it gives; ``between`` must hold every two groups."""
    sides = between.select("group", "other", "similarity", "distance").unionByName(
        between.select(F.col("other").alias("group"), F.col("group").alias("other"), "similarity", "distance"))
    width = F.sqrt(F.col("spread") / F.col("members"))
    own = within.select("group", F.col("similarity").alias("_intra"), width.alias("_width"))
    mate = within.select(F.col("group").alias("other"), width.alias("_width_other"))
    out = sides.join(own, "group").join(mate, "other").groupBy("group").agg(
        F.max("_intra").alias("intra"), F.max("similarity").alias("nearest"), F.avg("similarity").alias("others"),
        F.max(F.try_divide(F.col("_width") + F.col("_width_other"), F.col("distance"))).alias("davies_bouldin"))
    a, b = 1 - F.col("intra"), 1 - F.col("nearest")
    most = F.greatest("intra", "others")
    return out.withColumns({
        "silhouette": F.when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(0.0),
        "score": F.when(most > 0, (F.col("intra") - F.col("others")) / most)})


def significant(tests: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Tests with ``significant``: p below ``alpha``; without a p it is not."""
    return tests.withColumn("significant", F.coalesce(F.col(p) < alpha, F.lit(False)))


def _sums_by_position(known: DataFrame, pairs: DataFrame, permutations: int, seed: int) -> DataFrame:
    """``(draw, group, n, placed, norm)``: members, those with ancestors, and the square of their unit vectors' sum; draw 0 has the members' own labels.

    All permutations are labels of one aggregation over the members' ancestors.
    Tables as long as the members are merged: a written table looks small
    enough for the driver to send, as its files are compressed.
    """
    labels = running(known.withColumn("_all", F.lit(0)), ["_all"], [F.col("group"), F.col("node")], position="_at").select("_at", "group")
    drawn = known.select("node", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("draw")).withColumn(
        "_key", F.xxhash64("node", "draw", F.lit(seed)))
    dealt = running(drawn, ["draw"], [F.col("_key"), F.col("node")], position="_at").join(labels.hint("merge"), "_at").select("draw", "group", "node")
    every = cut(dealt.unionByName(known.withColumn("draw", F.lit(0))))
    sizes = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    weighed = pairs.select("node", "ancestor").join(sizes.hint("merge"), "node")
    keys = ["draw", "group"]
    sums = every.join(weighed.hint("merge"), "node").groupBy(*keys, "ancestor").agg(F.sum(1 / F.sqrt("_n")).alias("s")).groupBy(*keys).agg(
        F.sum(F.col("s") * F.col("s")).alias("norm"))
    totals = every.join(sizes.hint("merge"), "node", "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("_n").alias("placed"))
    return totals.join(sums, keys, "left")


def draw_keys(hashed: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """``xxhash64(node, draw, seed)`` out of ``xxhash64(node)`` (as unsigned numbers), so that a key costs no row."""
    p1, p2, p3, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    key = hashed.copy()
    for number in (draw, seed):
        key += p5 + np.uint64(4)
        key ^= np.uint64((number & 0xFFFFFFFF) * int(p1) & 0xFFFFFFFFFFFFFFFF)
        key = (key << np.uint64(23)) | (key >> np.uint64(41))
        key *= p2
        key += p3
        key ^= key >> np.uint64(33)
        key *= p2
        key ^= key >> np.uint64(29)
        key *= p3
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def key_bins(keys: np.ndarray) -> np.ndarray:
    return (keys >> (64 - KEY_BITS)) + (1 << (KEY_BITS - 1))


def _cuts(hashed: DataFrame, ends: np.ndarray, permutations: int, seed: int) -> np.ndarray | None:
    """The least key of each label but the first, (draws, labels - 1), for ``ends``: where labels end in a draw's order of keys.

    Keys are counted by their leading bits; of those in whose run a label ends
    the keys themselves are ordered.  None if a label ends between equal keys.
    """
    spark, bins = hashed.sparkSession, 1 << KEY_BITS
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "draw int, bytes binary"

    def row(draw: int, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([draw], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["draw", "bytes"])

    def each_draw(batches):
        parts = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if parts:
            all_of = np.concatenate(parts).view(np.uint64)
            for draw in range(1, permutations + 1):
                yield draw, draw_keys(all_of, draw, seed)

    def by_draw(batches):
        held = {}
        for batch in batches:
            for draw, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(draw, []).append(np.frombuffer(values.as_py(), np.int64))
        return held.items()

    def count(batches):
        for draw, keys in each_draw(batches):
            yield row(draw, np.bincount(key_bins(keys), minlength=bins))

    def place(batches):
        for draw, counts in by_draw(batches):
            upto = np.cumsum(np.sum(counts, axis=0))
            at = np.searchsorted(upto, ends, side="right")  # the bin with the first key after the end
            yield row(draw, np.concatenate([at, ends - np.where(at > 0, upto[at - 1], 0)]))

    counted = hashed.mapInArrow(count, schema).repartition(parts, "draw").mapInArrow(place, schema).toArrow()
    placed = np.zeros((permutations, 2, len(ends)), np.int64)
    for draw, values in zip(counted.column(0).to_pylist(), counted.column(1)):
        placed[draw - 1] = np.frombuffer(values.as_py(), np.int64).reshape(2, -1)

    def pick(batches):
        for draw, keys in each_draw(batches):
            wanted = np.zeros(bins, bool)
            wanted[placed[draw - 1, 0]] = True
            yield row(draw, keys[wanted[key_bins(keys)]])

    def cut_at(batches):
        for draw, picked in by_draw(batches):
            keys = np.sort(np.concatenate(picked))
            first = np.searchsorted(key_bins(keys), placed[draw - 1, 0])
            at = first + placed[draw - 1, 1]
            apart = np.all((at == 0) | (keys[at] != keys[np.maximum(at - 1, 0)]))
            yield row(draw, np.append(keys[at], int(apart)))

    out = hashed.mapInArrow(pick, schema).repartition(parts, "draw").mapInArrow(cut_at, schema).toArrow()
    cuts, apart = np.zeros((permutations, len(ends)), np.int64), True
    for draw, values in zip(out.column(0).to_pylist(), out.column(1)):
        values = np.frombuffer(values.as_py(), np.int64)
        cuts[draw - 1], apart = values[:-1], apart and bool(values[-1])
    return cuts if apart else None


def _sums_by_cuts(known: DataFrame, lists: DataFrame, sizes: pa.Table, permutations: int, seed: int) -> DataFrame | None:
    """``_sums_by_position`` for few groups, without a row for each member and draw.

    A draw is known by the keys at which its labels end, so a task works out
    the labels of its members itself.  Pairs travel once, to their ancestor,
    and are added up there draw by draw; ancestors of very many members are
    added up before.  None where equal keys leave a label open.
    """
    spark, n_of = known.sparkSession, sizes.column("n").to_numpy()
    groups, members = len(n_of), int(n_of.sum())
    if not groups or permutations < 1:
        return None
    tasks = 1 + members // TASK_NODES
    hashed = cut(known.select(F.xxhash64("node").alias("h")).repartition(tasks))
    cuts = _cuts(hashed, np.cumsum(n_of)[:-1], permutations, seed)
    if cuts is None:
        return None
    sent = spark.sparkContext.broadcast(cuts)
    names = sizes.column("group").combine_chunks()
    own = known.withColumn("h", F.xxhash64("node")).repartition(tasks, "node").join(lists.repartition(tasks, "node").hint("merge"), "node").select("h", "group", "ancestors")
    key_type = lists.schema["ancestors"].dataType.elementType.simpleString()
    travelling = f"ancestor {key_type}, h long, g int, n int, sums binary"
    draws, bins, unsure = permutations + 1, 1 << KEY_BITS, groups

    def label_table():
        """Of each draw the label of each run of keys; ``unsure`` where a label ends in it."""
        table = np.zeros((draws, bins), np.int32)
        for draw in range(1, draws):
            ends = sent.value[draw - 1]
            at = key_bins(ends)
            table[draw] = np.searchsorted(at, np.arange(bins), side="left")
            table[draw][at] = unsure
        return table

    def labels(table, draw: int, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        if not draw:
            return g
        keys = draw_keys(h, draw, seed)
        out = table[draw][key_bins(keys)]
        open_ = np.flatnonzero(out == unsure)
        out[open_] = np.searchsorted(sent.value[draw - 1], keys[open_], side="right")
        return out

    def own_pairs(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        data, table = pa.Table.from_batches(batches).combine_chunks(), label_table()
        h, g = data.column("h").to_numpy().view(np.uint64), pc.index_in(data.column("group"), value_set=names).to_numpy()
        lists = data.column("ancestors").combine_chunks()
        n = lists.value_lengths().to_numpy().astype(np.int32)
        every = lists.flatten()
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        there = n > 0
        placed = np.array([np.bincount(labels(table, draw, h, g)[there], minlength=groups) for draw in range(draws)], np.float64)
        yield travel(pa.nulls(1, every.type), [None], [None], [None], [placed.tobytes()])
        coded = every.dictionary_encode()
        of = coded.indices.to_numpy()
        held = np.bincount(of, minlength=len(coded.dictionary))
        for hot in np.flatnonzero(held > HOT_MEMBERS):
            mine = row[of == hot]
            weights = 1 / np.sqrt(n[mine])
            sums = np.array([np.bincount(labels(table, draw, h[mine], g[mine]), weights, groups) for draw in range(draws)])
            yield travel(coded.dictionary.slice(int(hot), 1), [None], [None], [None], [sums.tobytes()])
        rest = np.flatnonzero(held[of] <= HOT_MEMBERS)
        for start in range(0, len(rest), TASK_PAIRS):
            some = rest[start:start + TASK_PAIRS]
            at = row[some]
            yield travel(every.take(pa.array(some)), h[at].view(np.int64), g[at], n[at], pa.nulls(len(some), pa.binary()))

    def travel(ancestor, h, g, n, sums) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ancestor, pa.array(h, pa.int64()), pa.array(g, pa.int32()), pa.array(n, pa.int32()), sums if isinstance(sums, pa.Array) else pa.array(sums, pa.binary())],
                                          names=["ancestor", "h", "g", "n", "sums"])

    def add_up(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        data, table = pa.Table.from_batches(batches), label_table()
        norm, placed, added = np.zeros((draws, groups)), np.zeros((draws, groups)), {}
        of = data.column("ancestor").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        whole = data.column("sums").is_valid().to_numpy()
        for k in np.flatnonzero(whole):
            sums = np.frombuffer(data.column("sums")[int(k)].as_py()).reshape(draws, groups)
            if of[k] < 0:
                placed += sums
            else:
                added[of[k]] = added.get(of[k], 0) + sums
        each = np.flatnonzero(~whole)
        each = each[np.argsort(of[each], kind="stable")]
        of = of[each]
        h, g, n = (data.column(c).fill_null(0).to_numpy()[each] for c in ("h", "g", "n"))
        h, weights = h.view(np.uint64), 1 / np.sqrt(np.maximum(n, 1))
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, int)
        ends = np.append(starts[1:], len(of))
        first = 0
        while first < len(starts):
            last = int(np.searchsorted(ends, starts[first] + BLOCK_PAIRS, side="right"))
            last = max(first + 1, min(last, first + max(1, BLOCK_SUMS // groups)))
            some = slice(starts[first], ends[last - 1])
            place = np.repeat(np.arange(last - first) * groups, ends[first:last] - starts[first:last])
            more = [(k, added.pop(of[starts[first + k]])) for k in range(last - first) if of[starts[first + k]] in added]
            for draw in range(draws):
                sums = np.bincount(place + labels(table, draw, h[some], g[some]), weights[some], (last - first) * groups).reshape(-1, groups)
                for k, extra in more:
                    sums[k] += extra[draw]
                norm[draw] += np.einsum("ij,ij->j", sums, sums)
            first = last
        for sums in added.values():
            norm += sums * sums
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(draws, dtype=np.int32), groups)), pa.array(np.tile(np.arange(groups, dtype=np.int32), draws)),
                                          pa.array(np.tile(n_of, draws)), pa.array(placed.ravel()), pa.array(norm.ravel())], names=["draw", "group", "n", "placed", "norm"])

    pairs = lists.agg(F.sum(F.size("ancestors").cast("long"))).first()[0] or 0
    parts = own.mapInArrow(own_pairs, travelling).repartition(1 + pairs // TASK_PAIRS, "ancestor").mapInArrow(
        add_up, "draw int, group int, n long, placed double, norm double")
    # groups of which no member has an ancestor
    none = spark.createDataFrame(pa.table({"draw": np.repeat(np.arange(draws, dtype=np.int32), groups), "group": np.tile(np.arange(groups, dtype=np.int32), draws),
                                           "n": np.tile(n_of, draws), "placed": np.zeros(draws * groups), "norm": np.zeros(draws * groups)}))
    return parts.unionByName(none).groupBy("draw", "group").agg(F.max("n").alias("n"), F.sum("placed").alias("placed"), F.sum("norm").alias("norm"))


def permutation_test(members: DataFrame, pairs: DataFrame, permutations: int = 99, seed: int = 42) -> DataFrame:
    """One row ``(intra, permutations, as_high, p_value)``: how often labels dealt at random make groups as alike as theirs.

    Each permutation orders the members by a seeded hash and deals the labels
    out in that order, so group sizes stay.  ``pairs`` may be the closure's lists.
    """
    known = cut(members.select("group", "node"))
    sizes = known.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.count()
    rows = None
    if groups <= DEALT_GROUPS and groups * (permutations + 1) <= DEALT_NUMBERS and known.agg(F.count(F.lit(1)) == F.count_distinct("node")).first()[0]:
        rows = _sums_by_cuts(known, _whole(pairs), sizes.orderBy("group").toArrow(), permutations, seed)
    if rows is None:
        rows = _sums_by_position(known, pairs if "ancestor" in pairs.columns else unpacked(pairs), permutations, seed)
    alike = (F.coalesce("norm", F.lit(0.0)) - F.col("placed")) / (F.col("n") * (F.col("n") - 1))
    means = cut(rows.filter("n > 1").groupBy("draw").agg(F.avg(alike).alias("intra")))
    own = means.filter("draw = 0").select(F.col("intra").alias("_own"))
    # rounding keeps equal means equal whatever the order of the sums
    as_high = F.count_if((F.col("draw") > 0) & (F.round("intra", 10) >= F.round("_own", 10)))
    out = means.join(F.broadcast(own)).agg(F.max("_own").alias("intra"), F.lit(permutations).alias("permutations"), as_high.alias("as_high"))
    return out.withColumn("p_value", (F.col("as_high") + 1) / (F.col("permutations") + 1))


def extremes(statistics: DataFrame, label: Column, value: str = "mean") -> DataFrame:
    """Label with the highest and the lowest value."""
    order = F.struct(F.col(value), label.alias("_l"))
    return statistics.agg(F.max_by(label, order).alias("best"), F.min_by(label, order).alias("worst"))
