"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

Equal fingerprints are one leaf of the trie.  The upper trie is cut into
subtrees of bounded size from the counts of its nodes.  Pairs of subtrees
whose prefixes are within the error budget are handed to tasks, which walk
both subtrees together from bit to bit, add up the differing bits and give up
a pair of nodes once the budget is exceeded.  A task returns a spanning forest
of the links it found, never all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.columns import named
from tallyloom.llm.components import connected_components
from tallyloom.session import cut

BITS = 64
#: Fingerprints of a subtree at most; more than one in 2048 of all fingerprints
#: are also allowed, so that the driver never sees more than 2048 x 16 counts.
SUBTREE = 8192
MOST_HEAVY = 2048
STEP = 4
#: Min-hash bands for texts beyond the fingerprint's budget: at a similarity of
#: 0.8 a band agrees with a chance of 0.41, one of all with 0.99997.
BANDS, ROWS = 20, 4
#: Texts and shingles of a block that meets another block of its band (one text alone may have more shingles).
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20


def fingerprint_of(text: str | None, size: int) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    total, n = np.zeros(BITS, np.int64), 0
    shingles = zip(*(words[i:] for i in range(size))) if len(words) >= size else iter([words])
    digest, last = xxhash.xxh64_intdigest, max(1, len(words) - size + 1)
    while n < last:
        take = min(1 << 16, last - n)
        hashes = np.fromiter((digest(b" ".join(next(shingles)), 42) for _ in range(take)), np.uint64, take)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += take
    bits = np.packbits(total * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    import xxhash

    grams = zip(*(words[i:] for i in range(size))) if len(words) >= size else iter([words] if words else [])
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams), np.uint64)


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """One number for each band of min-hashes: equal with a chance of similarity ** ROWS for each band."""
    rng = np.random.default_rng(11)
    factors, shifts = (rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
    least = np.array([(hashes * (f | np.uint64(1)) + s).min() for f, s in zip(factors, shifts)]).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def sketch(text, size: int):
    """Column: struct of the fingerprint, the sorted set of 32-bit shingle hashes, and its bands (none without words)."""

    @F.pandas_udf("fingerprint long, shingles array<int>, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            hashes = np.unique(shingle_hashes((text or "").encode().lower().split(), size))
            bands = bands_of(hashes) if len(hashes) else np.zeros(0, np.int64)
            out.append((fingerprint_of(text, size), np.unique(hashes.astype(np.uint32)).view(np.int32), bands))
        return pd.DataFrame(out, columns=["fingerprint", "shingles", "bands"])

    return of(text)


def fingerprint(text, size: int = 5):
    """Column: the fingerprint of ``size``-word shingles as a long.

    A-Z is lower-cased, words are runs without ASCII white space, repeated
    shingles count as often as they occur.  A text of fewer words is one
    shingle; a null text or one without words has fingerprint zero.
    """

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, size) for t in texts], dtype="int64")

    return of(text)


def pairs_within(a: np.ndarray, b: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with at most ``budget`` differing bits between the sorted unsigned ``a[i]`` and ``b[j]``.

    A node of the trie is a range of a sorted array.  If ``a is b``, every
    pair comes once (i < j).
    """
    same = a is b
    empty = np.zeros(0, np.int64)
    if not len(a) or not len(b):
        return empty, empty
    nodes = np.array([[0, len(a), 0, len(b), 0]], np.int64)
    out_i, out_j = [], []
    for bit in range(BITS - 1, -1, -1):
        ones = [np.concatenate([[0], np.cumsum((x >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)]) for x in ((a,) if same else (a, b))]
        a_lo, a_hi, b_lo, b_hi, diff = nodes.T
        a_mid = a_hi - (ones[0][a_hi] - ones[0][a_lo])
        b_mid = b_hi - (ones[-1][b_hi] - ones[-1][b_lo])
        joint = (a_lo == b_lo) & (a_hi == b_hi) if same else np.zeros(len(nodes), bool)
        children = [
            np.stack([a_lo, a_mid, b_lo, b_mid, diff], 1), np.stack([a_mid, a_hi, b_mid, b_hi, diff], 1),
            np.stack([a_lo, a_mid, b_mid, b_hi, diff + 1], 1), np.stack([a_mid, a_hi, b_lo, b_mid, diff + 1], 1)[~joint],
        ]
        nodes = np.concatenate(children)
        nodes = nodes[(nodes[:, 4] <= budget) & (nodes[:, 1] > nodes[:, 0]) & (nodes[:, 3] > nodes[:, 2])]
        single = (nodes[:, 1] - nodes[:, 0] == 1) & (nodes[:, 3] - nodes[:, 2] == 1)
        if single.any():  # two leaves: their remaining bits are counted at once
            i, j = nodes[single, 0], nodes[single, 2]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i != j
            out_i.append(i[near])
            out_j.append(j[near])
            nodes = nodes[~single]
        if not len(nodes):
            break
    return np.concatenate([empty, *out_i]), np.concatenate([empty, *out_j])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        apart = low != high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while (root != root[root]).any():
            root = root[root]


def subtrees(prints: DataFrame, column: str, n: int) -> list[tuple[int, int]]:
    """(prefix, depth) of disjoint subtrees that hold all of ``prints``, each of bounded size.

    Levels are counted ``STEP`` bits at a time, and only below nodes that are
    still too large: at most ``MOST_HEAVY`` nodes a round, whatever the input.
    """
    most = max(SUBTREE, n // MOST_HEAVY)
    done, heavy, depth = [], [0], 0
    while heavy and depth < BITS:
        below = depth + STEP
        # shifts by 64 - depth: unsigned, and split in two for depth 0
        at = F.shiftrightunsigned(column, BITS - below)
        node = F.shiftright(F.shiftright(column, 1), BITS - 1 - depth).bitwiseAND((1 << depth) - 1) if depth else F.lit(0).cast("long")
        rows = prints.where(node.isin(heavy)) if depth else prints
        count = {r.node & ((1 << below) - 1): r.n for r in rows.groupBy(at.alias("node")).agg(F.count("*").alias("n")).collect()}
        level = {below: count}
        for d in range(below - 1, depth - 1, -1):
            level[d] = {}
            for p, c in level[d + 1].items():
                level[d][p >> 1] = level[d].get(p >> 1, 0) + c
        now, heavy = list(level[depth]), []
        for d in range(depth, below + 1):
            small = [p for p in now if level[d][p] <= most]
            done += [(p, d) for p in small]
            large = [p for p in now if level[d][p] > most]
            if d == below:
                heavy = large
            else:
                now = [q for p in large for q in (2 * p, 2 * p + 1) if q in level[d + 1]]
        depth = below
    return sorted(done + [(p, depth) for p in heavy], key=lambda x: x[0] << (BITS - x[1]))


def subtree_pairs(parts: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Indices of subtrees whose common prefix bits differ in at most ``budget`` places: the same walk, from the root."""
    lows = np.array([p << (BITS - d) for p, d in parts], np.uint64)
    depths = [d for _, d in parts]
    out, todo = [], [(0, len(parts), 0, len(parts), BITS - 1, 0)]
    while todo:
        a0, a1, b0, b1, bit, diff = todo.pop()
        if a0 >= a1 or b0 >= b1 or diff > budget:
            continue
        a_leaf, b_leaf = a1 - a0 == 1 and depths[a0] <= BITS - 1 - bit, b1 - b0 == 1 and depths[b0] <= BITS - 1 - bit
        if a_leaf or b_leaf:  # below a subtree's root nothing is known of its bits
            out += [(i, j) for i in range(a0, a1) for j in range(b0, b1) if i <= j]
            continue
        half = lambda lo, hi: lo + int(((lows[lo:hi] >> np.uint64(bit)) & np.uint64(1) == 0).sum())  # noqa: E731, B023
        am, bm = half(a0, a1), half(b0, b1)
        todo += [(a0, am, b0, bm, bit - 1, diff), (am, a1, bm, b1, bit - 1, diff), (a0, am, bm, b1, bit - 1, diff + 1)]
        if (a0, a1) != (b0, b1):
            todo.append((am, a1, b0, bm, bit - 1, diff + 1))
    return out


def near_links(prints: DataFrame, column: str = "fingerprint", budget: int = 2) -> DataFrame:
    """``(a long, b long)``: links that connect all distinct ``prints`` within ``budget`` bits of each other, directly or over others."""
    spark = prints.sparkSession
    parts = subtrees(prints, column, prints.count())
    pairs = subtree_pairs(parts, budget)
    lows = np.array([p << (BITS - d) for p, d in parts], np.uint64)

    @F.pandas_udf("int")
    def part_of(value: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(lows, value.to_numpy(np.int64).view(np.uint64), side="right") - 1, dtype="int32")

    trees = cut(prints.select(F.col(column).alias("print"), part_of(F.col(column)).alias("part"))
                .groupBy("part").agg(F.collect_list("print").alias("prints")))
    pair_rows = spark.createDataFrame(pairs, "x int, y int") if pairs else spark.createDataFrame([], "x int, y int")
    work = pair_rows.join(trees.select(F.col("part").alias("x"), F.col("prints").alias("left")), "x") \
        .join(trees.select(F.col("part").alias("y"), F.col("prints").alias("right")), "y")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = work.select("x", "y", "left", "right").repartition(n, "x", "y")

    def walk(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                left, right = (np.sort(batch.column(c)[k].values.to_numpy().view(np.uint64)) for c in (2, 3))
                both = left if x == y else np.concatenate([left, right])
                i, j = pairs_within(left, left if x == y else right, budget)
                root = forest(len(both), i, j if x == y else j + len(left))
                linked = np.flatnonzero(root != np.arange(len(both)))
                signed = both.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[root[linked]])], names=["a", "b"])

    return work.mapInArrow(walk, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint long, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links; ids
    that are null come last.  Texts without words all have fingerprint zero
    and are linked like any other.  An empty table gives no row.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), size).alias("fingerprint")))
    return with_components(rows, budget).select(F.col("id").alias(id_col), "fingerprint", F.col("component_id"))


def with_components(rows: DataFrame, budget: int) -> DataFrame:
    """``rows (id, fingerprint long, ...)``, a written table, with ``component_id``."""
    prints = cut(rows.groupBy("fingerprint").agg(F.min("id").alias("first")))
    classes = connected_components(near_links(prints, budget=budget))
    known = prints.join(classes.withColumnRenamed("node", "fingerprint"), "fingerprint", "left") \
        .select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    first = known.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = known.join(first, "root").select("fingerprint", "component_id")
    return rows.join(of_print.hint("merge"), "fingerprint")


def similar_links(rows: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """``(a long, b long)``: links that connect, with ``links``, all texts of a common band whose shingle sets are ``similarity`` alike or more.

    ``rows (row, id, fingerprint, shingles, bands)``, ``links (a, b)`` of
    fingerprints.  Every row of a band meets the band's first row (of least
    id), which joins most of a group at the price of its members.  The rows of
    a band that are still in different components then meet each other, block
    by block.  All checks are exact.
    """
    # first by id, so that the order of the input's files changes nothing
    at = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    sets = rows.groupBy("fingerprint", F.xxhash64("shingles").alias("digest")).agg(
        F.min(at).alias("at"), F.first("bands").alias("bands"), F.first(F.size("shingles")).alias("size"))
    in_band = sets.select("at", F.col("at.row").alias("row"), "fingerprint", "size", F.explode("bands").alias("band"))
    first = in_band.groupBy("band").agg(F.min(F.struct("at", "row", "fingerprint")).alias("first"), F.count("*").alias("n")).where("n > 1")
    met = cut(in_band.join(first, "band").where("row != first.row").select(
        "band", "row", "size", "fingerprint", F.col("first.row").alias("other"), F.col("first.fingerprint").alias("first")))
    pairs = cut(met.where("fingerprint != first").select("row", "other", F.col("fingerprint").alias("a"), F.col("first").alias("b")).distinct())
    wanted = met.select("row").union(met.select("other")).distinct()
    shingles = cut(rows.select("row", "shingles").join(wanted, "row", "left_semi"))
    both = F.size(F.array_intersect("mine", "theirs"))
    alike = cut(links.union(
        pairs.join(shingles.withColumnRenamed("shingles", "mine"), "row")
        .join(shingles.select(F.col("row").alias("other"), F.col("shingles").alias("theirs")), "other")
        .where(both >= similarity * (F.size("mine") + F.size("theirs") - both)).select("a", "b")
    ))
    roots = connected_components(alike).withColumnRenamed("node", "fingerprint")
    return alike.union(block_links(met, roots, shingles, similarity))


def block_links(met: DataFrame, roots: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """``(a long, b long)``: links between rows of a band whose fingerprints have different ``roots (fingerprint, root)``.

    ``met (band, row, size, fingerprint)``, ``shingles (row, shingles)``.
    Bands of the same rows are one.  A band's rows are dealt into blocks of
    bounded size, those of a large component into blocks of their own, which
    needn't meet each other.  A task checks one pair of blocks and returns a
    spanning forest of its links.
    """
    spark = met.sparkSession
    known = met.join(roots, "fingerprint", "left").select("band", "row", "size", "fingerprint", F.coalesce("root", "fingerprint").alias("root"))
    mixed = known.groupBy("band").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.hash("row").cast("long")).alias("y")).where("low != high")
    left = cut(known.join(mixed.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band"), "band", "left_semi"))
    if left.isEmpty():
        return spark.createDataFrame([], "a long, b long")

    need = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    of_root = left.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("total")).withColumn("own", need)
    of_band = of_root.where("own = 1").groupBy("band").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select("band", need.alias("shared"))
    large = of_root.where("own > 1").select("band", "root", "own")
    salt = F.pmod(F.xxhash64("row"), F.coalesce("own", "shared")).cast("int")
    owner = F.when(F.col("own").isNotNull(), F.col("root"))
    dealt = cut(left.join(large, ["band", "root"], "left").join(of_band, "band", "left")
                .select("band", "row", "fingerprint", "root", F.struct(owner.alias("owner"), salt.alias("salt")).alias("block")))
    blocks = dealt.select("band", "block").distinct()
    met_blocks = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), "band") \
        .where("x <= y AND (x.owner IS NULL OR y.owner IS NULL OR x.owner != y.owner)")
    sides = met_blocks.select("band", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    work = dealt.join(sides, ["band", "block"]).join(shingles, "row").select(
        "band", "x", "y", (F.col("block") == F.col("x")).alias("on_x"), (F.col("block") == F.col("y")).alias("on_y"), "fingerprint", "root", "shingles")

    def check(members: pa.Table) -> pa.Table:
        fingerprints, group = (members.column(c).to_numpy() for c in ("fingerprint", "root"))
        lists = [x.values.to_numpy() for x in members.column("shingles")]
        on_x, on_y = (np.flatnonzero(members.column(c).to_numpy()) for c in ("on_x", "on_y"))
        i, j = alike_forest(lists, group.copy(), on_x, on_y, similarity)
        return pa.table({"a": fingerprints[i], "b": fingerprints[j]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return work.groupBy("band", "x", "y").applyInArrow(check, "a long, b long")


def alike_forest(lists: list[np.ndarray], group: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i of ``x``, j of ``y``) between sets that are ``similarity`` alike, as few as join their ``group`` numbers, which are changed."""
    out: list[tuple[int, int]] = []
    sizes = np.array([len(v) for v in lists], np.int64)
    values = np.concatenate([lists[j] for j in y]) if len(y) else np.zeros(0, np.int32)
    owners = np.repeat(np.arange(len(y)), sizes[y])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    for i in x:
        if (group[y] == group[i]).all():
            continue
        low, high = (np.searchsorted(values, lists[i], side) for side in ("left", "right"))
        n = high - low
        places = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owners[places], minlength=len(y))
        for j in y[common >= similarity * (sizes[i] + sizes[y] - common)]:
            if group[j] != group[i]:
                out.append((i, j))
                group[group == group[j]] = group[i]
    return tuple(np.array(out, np.int64).reshape(-1, 2).T)


def keep_one(docs: DataFrame, size: int = 5, budget: int = 3, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of least id (null last), of equal ones the first row.

    Texts are linked by fingerprints within ``budget`` bits (the trie), and
    beyond it by the share of common ``size``-word shingles.  All columns are
    kept as they are.  Texts without words are one group.
    """
    rows = cut(docs.select(
        F.struct(*named(docs.columns)).alias("doc"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        sketch(F.col(text_col), size).alias("s")).select("doc", "id", "row", "s.*"))
    prints = cut(rows.select("fingerprint").distinct())
    links = similar_links(rows.select("row", "id", "fingerprint", "shingles", "bands"), near_links(prints, budget=budget), similarity)
    classes = connected_components(links).withColumnRenamed("node", "fingerprint")
    first_of_print = rows.groupBy("fingerprint").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    kept = first_of_print.join(classes, "fingerprint", "left").groupBy(F.coalesce("root", "fingerprint").alias("root")) \
        .agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    # few rows go, so the wide rows meet those and not the many that stay
    gone = cut(rows.select("row").join(kept, "row", "left_anti"))
    return rows.select("doc", "row").join(gone, "row", "left_anti").select("doc.*")
