"""Prefix trie of conversations by time-forward processing.

A node is a distinct sequence of first turns.  Below a node of one
conversation lies a chain, so only nodes that conversations share need totals
from below.  Those nodes are sorted by reverse level order; each takes the
messages that its children left for it in a priority queue and leaves one for
its parent.  Shards are the subtrees of nodes with few members whose parent
has many; what the shard roots send up is added by parent, and the same pass
over the few nodes above them ends it.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.skew import join_counted
from tallyloom.operators.ordering import fits_window, running
from tallyloom.session import cut

#: A node with more than this share of all conversations lies above the shards: at each depth fewer than its inverse.
UPPER_SHARE = 1 / 1024
#: Messages that a queue holds in memory.
QUEUE = 200_000
#: Widths of the four running sums that name a node: 128 bits in all.
LANES, LANE = 4, 1 << 32
KEY = ["depth", "k1", "k2"]
SHARD = ["s0", "s1", "s2"]


class SpillingQueue:
    """Priority queue of tuples.  Beyond ``limit`` its later half goes, sorted, to an unnamed file in the folders that
    Spark itself spills to; only this task reads it, and the system removes it when the task ends."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self.heap.sort()
            half = len(self.heap) // 2
            run = self.stored(self.heap[half:])
            del self.heap[half:]
            heapq.heappush(self.runs, (next(run), len(self.runs), run))

    @staticmethod
    def stored(items: list[tuple]) -> Iterator[tuple]:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        file = tempfile.TemporaryFile(dir=folder)
        for k in range(0, len(items), 1000):
            pickle.dump(items[k:k + 1000], file)
        pickle.dump(None, file)
        file.seek(0)

        def read():
            with file:
                while (part := pickle.load(file)) is not None:
                    yield from part

        return read()

    def first(self) -> tuple | None:
        heads = ([self.heap[0]] if self.heap else []) + ([self.runs[0][0]] if self.runs else [])
        return min(heads, default=None)

    def pop(self) -> tuple:
        if not self.runs or self.heap and self.heap[0] <= self.runs[0][0]:
            return heapq.heappop(self.heap)
        head, number, run = self.runs[0]
        following = next(run, None)
        if following is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (following, number, run))
        return head


def turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, at, a, b, size)``: turns in order, each by a hash of 128 bits and the code points of its text."""
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hashed = cut(rows.select("conv", "turn", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b"),
                             F.length("text").cast("long").alias("size")))
    # rows of one turn: by their hashes, which is any order, but the same one in every run
    return running(hashed, ["conv"], [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], position="at").drop("turn")


def rebuilt(rows: DataFrame, family: int, most_shared: int) -> DataFrame:
    """``(conv, depth, a, b, size, length)`` of the rebuilt conversations, and a row of depth 0 for each of them."""
    h = F.crc32(F.col("conv").cast("string")) % most_shared
    ids = rows.groupBy("conv").agg(F.count("*").alias("own")).withColumns({"h": h, "base": F.col("conv") - F.col("conv") % family})
    heads = rows.where(F.col("at") < most_shared).select(F.col("conv").alias("base"), "at", "a", "b", "size")
    of_base = heads.groupBy("base").agg(F.collect_list(F.struct("at", "a", "b", "size")).alias("head"))  # fewer than most_shared rows each
    known = cut(ids.join(of_base, "base", "left").withColumn(
        "head", F.filter(F.coalesce("head", F.array().cast("array<struct<at:long,a:long,b:long,size:long>>")), lambda t: t["at"] <= F.col("h")))
        .select("conv", F.col("own").alias("n"), "h", "head", (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    start = known.select("conv", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("a", "b", "size")), "length")
    first = known.select("conv", "length", F.explode("head").alias("t")).select("conv", F.col("t.at").alias("depth"), "t.a", "t.b", "t.size", "length")
    lengths = known.select("conv", "n", "h", F.size("head").alias("taken"), "length")
    own = join_counted(rows, lengths, ["conv"]).where("at > h").select(
        "conv", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "size", "length")
    return start.union(first).union(own)


def with_keys(path: DataFrame, small: bool) -> DataFrame:
    """``path`` with the name of its node, ``k1, k2``, and of the node above, ``p1, p2``: sums of hashes of (depth, turn)."""
    hashes = F.xxhash64("depth", "a", "b"), F.xxhash64("b", "depth", "a")
    lanes = [lane for h in hashes for lane in (h.bitwiseAND(LANE - 1), F.shiftrightunsigned(h, 32))]
    own = {f"lane{i}": F.when(F.col("depth") > 0, lane).otherwise(0) for i, lane in enumerate(lanes)}
    summed = running(path.withColumns(own), ["conv"], [F.col("depth")], {f"sum{i}": f"lane{i}" for i in range(LANES)}, position="_at", small=small)

    def packed(low: Column, high: Column) -> Column:
        return F.shiftleft(high.bitwiseAND(LANE - 1).cast("long"), 32).bitwiseOR(low.bitwiseAND(LANE - 1))

    name = lambda at: [packed(at(0), at(1)), packed(at(2), at(3))]
    here, above = name(lambda i: F.col(f"sum{i}")), name(lambda i: F.col(f"sum{i}") - F.col(f"lane{i}"))
    return summed.select("conv", "depth", "size", (F.col("depth") == F.col("length")).alias("ends"),
                         here[0].alias("k1"), here[1].alias("k2"), above[0].alias("p1"), above[1].alias("p2"))


def totals_from_below(nodes: DataFrame, parts: int) -> DataFrame:
    """``(depth, k1, k2, n_leaves, saved_tokens)`` of ``nodes (s0, s1, s2, depth, k1, k2, p1, p2, leaves, saved)``.

    ``leaves`` and ``saved`` are a node's own; nodes of one shard (without
    ``s0, s1, s2``: all) are in one task, which reads them in reverse level
    order.
    """
    columns = [*KEY, "p1", "p2", "leaves", "saved"]
    dealt = nodes.repartition(parts, *(c for c in nodes.columns if c in SHARD))
    ordered = dealt.sortWithinPartitions(F.desc("depth"), "k1", "k2").select(*columns)

    def forward(batches):
        queue = SpillingQueue()
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in columns)))
            out = []
            for depth, k1, k2, p1, p2, leaves, saved in rows:
                label = (-depth, k1, k2)
                while (head := queue.first()) is not None and head[:3] <= label:
                    message = queue.pop()
                    if message[:3] == label:  # else its parent lies above this shard
                        leaves, saved = leaves + message[3], saved + message[4]
                out.append((depth, k1, k2, leaves, saved))
                if depth:
                    queue.push((1 - depth, p1, p2, leaves, saved))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5,
                                             names=[*KEY, "n_leaves", "saved_tokens"])

    return ordered.mapInArrow(forward, "depth long, k1 long, k2 long, n_leaves long, saved_tokens long")


def end_hashes(path: DataFrame, parts: int) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)``: conversations that end at a node, ascending, read as a stream, however many they are."""
    ends = path.where("ends").select(*KEY, "conv").repartition(parts, *KEY).sortWithinPartitions(*KEY, "conv")

    def hashed(batches):
        current, digest = None, None
        for batch in batches:
            out = []
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv"))):
                if key != current:
                    if current is not None:
                        out.append((*current, digest.hexdigest()))
                    current, digest = key, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            yield rows_of(out)
        if current is not None:
            yield rows_of([(*current, digest.hexdigest())])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"])

    return ends.mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = 100, most_shared: int = 6, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """One row for every node of the trie of rebuilt conversations.

    A conversation ``c`` takes the first ``h = crc32(decimal c) % most_shared``
    turns of conversation ``c - c % family`` (of a negative ``c`` the remainder
    is negative too), as many as there are, and goes on with its own turns
    after its first ``h``.  Turns are ordered by turn, null first, rows of one
    turn by the hashes of role and text; null roles and texts are empty.  Rows
    without a conversation id belong to no conversation and are left out.  An
    empty table has no root and gives no row.
    """
    spark = conversations.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(turns(conversations, conv, turn, role, text))
    path = cut(with_keys(rebuilt(rows, family, most_shared), fits_window(rows, ["conv"])))
    nodes = cut(path.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("size").alias("size")))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    parents = cut(nodes.join(kids, KEY).select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"),
        F.col("n_convs").alias("parent_convs"), "n_children", "single", F.col("n_children").alias("n")))
    below = join_counted(nodes.where("depth > 0"), parents.select("depth", "p1", "p2", "parent_conv_id", "parent_convs", "n"), ["depth", "p1", "p2"]).drop("n")
    root = nodes.where("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "parent_convs": F.lit(None).cast("long")})
    own = parents.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children", "single")
    known = cut(below.unionByName(root).join(own, KEY, "left").fillna(0, ["n_children", "single"]))
    sums = shared_totals(known, path, parts)
    out = known.join(end_hashes(path, parts), KEY, "left").join(sums, KEY, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        # below a node of one conversation lies a chain with one end
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def shared_totals(known: DataFrame, path: DataFrame, parts: int) -> DataFrame:
    """Totals of the nodes with two members or more: within the shards, then above the shard roots."""
    n = known.where("depth = 0").agg(F.max("n_convs")).first()[0] or 0
    most = max(1, int(n * UPPER_SHARE))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(F.col("single"))
    own = known.where("n_convs > 1").select(
        *KEY, "p1", "p2", "conv_id", "n_convs", "parent_convs", leaf.cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    low = own.where(F.col("n_convs") <= most)
    tops = cut(low.where(F.col("parent_convs") > most).select(*KEY, "p1", "p2", F.col("n_convs").alias("n")))
    # a conversation passes through one shard root at most; a node lies in the shard of any of its members
    member = join_counted(path.select(*KEY, "conv"), tops.select(*KEY, "n"), KEY).select("conv", *(F.col(c).alias(s) for c, s in zip(KEY, SHARD)))
    inside = cut(totals_from_below(low.join(member.withColumnRenamed("conv", "conv_id"), "conv_id"), parts))
    sent = inside.join(tops.select(*KEY, "p1", "p2"), KEY).groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")) \
        .agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    upper = own.where(F.col("n_convs") > most).join(sent, KEY, "left").fillna(0, ["more_leaves", "more_saved"]).withColumns(
        {"leaves": F.col("leaves") + F.col("more_leaves"), "saved": F.col("saved") + F.col("more_saved")})
    return inside.union(totals_from_below(upper, 1))
