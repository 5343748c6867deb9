"""MinHash near-duplicates by an inverted join of signature coordinates.

A document is posted under the (coordinate, value) pairs of its MinHash
signature.  Only pairs that more than one document has are posted at all, and
of these only a prefix in the order of rarity: two documents that agree in
``MATCHES`` coordinates share one of their prefixes.  Lists are merged to count
the agreeing coordinates; what reaches the threshold is confirmed on the full
shingle sets.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import connected_components
from tallyloom.llm.skew import join_counted
from tallyloom.session import cut

#: Coordinates, and how many must agree: at a similarity of 0.85 fewer agree with a chance of 7e-8.
COORDINATES, MATCHES = 48, 26
#: Documents and shingles of a block of one list (one document alone may have more shingles).
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence where there are fewer words, nothing without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    grams = zip(*(words[i:] for i in range(size))) if len(words) >= size else iter([words] if words else [])
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), 7) for g in grams), np.uint64))


@functools.cache
def orders() -> tuple[np.ndarray, np.ndarray]:
    """The coordinates' orders of the hashes: odd factors, and shifts as a column."""
    rng = np.random.default_rng(3)
    factors, shifts = (rng.integers(0, 1 << 64, COORDINATES, np.uint64) for _ in range(2))
    return factors | np.uint64(1), shifts[:, None]


def coordinate_values(hashes: np.ndarray) -> np.ndarray:
    """One number a coordinate: its index in the upper half, its least hash in the lower."""
    factors, shifts = orders()
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 4096):
        ordered = np.multiply.outer(factors, hashes[k:k + 4096])
        ordered += shifts
        np.minimum(least, ordered.min(1), out=least)
    return (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32) | least >> np.uint64(32)).view(np.int64)


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, row, text, n_shingles, digest, tokens)`` of every row; ``digest`` tells the set, ``tokens`` is empty without words."""
    import xxhash

    def sign(batches):
        for batch in batches:
            texts = batch.column(2)
            n, digests, tokens = [], [], []
            for text in texts:
                hashes = shingle_set(text.as_py(), size)
                n.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                tokens.append(coordinate_values(hashes) if len(hashes) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))],
                names=["id", "row", "text", "n_shingles", "digest", "tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return cut(rows.mapInArrow(sign, f"id {id_type}, row long, text string, n_shingles long, digest binary, tokens array<long>"))


def posting_lists(sets: DataFrame) -> DataFrame:
    """``(row, n_shingles, token, place)``: the prefix of every document of ``sets (row, n_shingles, tokens)`` that can have a partner.

    The order is that of (how many have it, token).  Pairs that no other
    document has come first in it and join nothing, so they only shorten the
    prefix; a document with fewer than ``MATCHES`` others can't reach the
    threshold.
    """
    posted = sets.select("row", "n_shingles", F.explode("tokens").alias("token"))
    counts = cut(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"))
    shared = join_counted(posted, counts, ["token"]).groupBy("row", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
    prefix = shared.where(F.size("held") >= MATCHES).select(
        "row", "n_shingles", F.posexplode(F.slice("held", F.lit(1), F.size("held") - MATCHES + 1)).alias("place", "e"))
    return cut(prefix.select("row", "n_shingles", F.col("e.token").alias("token"), F.col("e.n").alias("held_by"), "place"))


def similar_links(sketches: DataFrame, sets: DataFrame, percent: int, size: int) -> DataFrame:
    """``(a long, b long)``: links that connect all rows of ``sets`` that are ``percent`` alike or more, directly or over others.

    Every document of a list first meets one of its members, which joins most
    of a group at the price of its members.  Documents of a list that are
    still apart then meet each other, block by block.
    """
    posted = posting_lists(sets)
    hubs = cut(posted.groupBy("token").agg(F.min("row").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    pairs = cut(join_counted(posted.select("token", "row"), hubs, ["token"]).where("row != hub").select("row", "hub").distinct())
    met = F.size(F.array_intersect("tokens", "hub_tokens"))
    tokens = sets.select("row", "tokens")
    likely = cut(pairs.join(tokens, "row").join(tokens.select(F.col("row").alias("hub"), F.col("tokens").alias("hub_tokens")), "hub")
                 .where(met >= MATCHES).select("row", "hub"))
    # lists of two are done once their pair is known
    crowded = hubs.where("n > 2").select("token")
    in_crowd = posted.join(crowded, "token", "left_semi")
    wanted = cut(likely.select("row").union(likely.select("hub")).union(in_crowd.select("row")).distinct())
    shingles = shingle_table(sketches, wanted, size)
    both = F.size(F.array_intersect("mine", "theirs"))
    links = cut(
        likely.join(shingles.withColumnRenamed("shingles", "mine"), "row")
        .join(shingles.select(F.col("row").alias("hub"), F.col("shingles").alias("theirs")), "hub")
        .where(100 * both >= percent * (F.size("mine") + F.size("theirs") - both)).select(F.col("row").alias("a"), F.col("hub").alias("b")))
    roots = connected_components(links).select(F.col("node").alias("row"), "root")
    return links.union(list_links(in_crowd, roots, tokens, shingles, percent))


def shingle_table(sketches: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(row, shingles array<long>)``, written, of the ``wanted (row)``."""

    def hashed(batches):
        for batch in batches:
            lists = [shingle_set(text.as_py(), size).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["row", "shingles"])

    return cut(sketches.select("row", "text").join(wanted, "row", "left_semi").mapInArrow(hashed, "row long, shingles array<long>"))


def list_links(posted: DataFrame, roots: DataFrame, tokens: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """``(a long, b long)``: links between documents of a list with different ``roots (row, root)``.

    Lists of the same documents are one.  A list's documents are dealt into
    blocks of bounded size; a task merges the lists of one pair of blocks and
    returns a spanning forest of its links.
    """
    spark = posted.sparkSession
    known = cut(posted.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")))
    mixed = known.groupBy("token").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("total"),
        F.min("held_by").alias("held_by"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.hash("row").cast("long")).alias("y")).where("low != high")
    # of lists with the same documents the first in the order of prefixes: it is the first that any of their pairs has in common
    kept = mixed.groupBy("n", "x", "y").agg(F.min(F.struct("held_by", "token")).alias("first"), F.max("total").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    kept = cut(kept.select(F.col("first.token").alias("token"), "n", blocks.alias("blocks")))
    if kept.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    dealt = join_counted(known.select("token", "row", "root"), kept, ["token"]).withColumn("block", block)
    # block b meets blocks 0..blocks-1, each pair of blocks once
    sides = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    prefixes = posted.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("p")).select("row", F.col("p.token").alias("prefix"))
    documents = cut(prefixes.join(tokens, "row").join(shingles, "row"))
    work = sides.select("token", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "row", "root").join(documents, "row")

    def check(members: pa.Table) -> pa.Table:
        token, x, y = (members.column(c)[0].as_py() for c in ("token", "x", "y"))
        rows, group, place = (members.column(c).to_numpy() for c in ("row", "root", "block"))
        lists = [[v.values.to_numpy() for v in members.column(c)] for c in ("tokens", "prefix", "shingles")]
        i, j = merged_forest(token, *lists, group.copy(), np.flatnonzero(place == x), np.flatnonzero(place == y), percent)
        return pa.table({"a": rows[i], "b": rows[j]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return work.groupBy("token", "x", "y").applyInArrow(check, "a long, b long")


def collisions(lists: list[np.ndarray], matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that at least ``matches`` of the sorted ``lists`` hold, and how many do.

    A number in that many lists is in one of the shortest
    ``len(lists) - matches + 1``: those are merged.  The longer lists are only
    probed at the numbers found, and a number is skipped for good once the
    lists left can't bring it to the threshold.
    """
    lists = sorted(lists, key=len)
    short = max(0, len(lists) - matches + 1)
    found, counts = np.unique(np.concatenate(lists[:short]) if short else np.zeros(0, np.int64), return_counts=True)
    for k in range(short, len(lists)):
        still = counts + (len(lists) - k) >= matches
        found, counts = found[still], counts[still]
        if not len(found):
            break
        at = np.searchsorted(lists[k], found)
        counts = counts + ((at < len(lists[k])) & (lists[k][np.minimum(at, len(lists[k]) - 1)] == found))
    enough = counts >= matches
    return found[enough], counts[enough]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Numbers that two sets have in common, both sorted alike."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def merged_forest(token: int, tokens: list[np.ndarray], prefixes: list[np.ndarray], shingles: list[np.ndarray], group: np.ndarray,
                  x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i of ``x``, j of ``y``) between documents ``percent`` alike, as few as join their ``group`` numbers, which are changed.

    A pair is only confirmed in the list of the first prefix token it has in common.
    """
    out: list[tuple[int, int]] = []
    values = np.concatenate([tokens[j] for j in y])
    owners = np.repeat(np.arange(len(y)), [len(tokens[j]) for j in y])
    order = np.lexsort((owners, values))
    values, owners = values[order], owners[order]
    first_in, held = [p.tolist() for p in prefixes], {}
    for i in x:
        if (group[y] == group[i]).all():
            continue
        low, high = (np.searchsorted(values, tokens[i], side) for side in ("left", "right"))
        for k in collisions([owners[a:b] for a, b in zip(low, high)], MATCHES)[0]:
            j = y[k]
            if group[j] == group[i]:
                continue
            if j not in held:
                held[j] = set(first_in[j])
            if next(t for t in first_in[i] if t in held[j]) != token:
                continue
            both = common(shingles[i], shingles[j])
            if 100 * both >= percent * (len(shingles[i]) + len(shingles[j]) - both):
                out.append((i, j))
                group[group == group[j]] = group[i]
    return tuple(np.array(out, np.int64).reshape(-1, 2).T)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    A-Z is lower-cased, words are runs without ASCII white space, a document is
    the set of its ``size``-word shingles (of fewer words: the whole sequence).
    Documents whose sets have ``percent`` or more of their union in common are
    linked; equal sets are one from the start.  ``component_id`` is the
    smallest id that can be reached, null ids come last; ``kept`` says that it
    is the row's own id (null equals null).  Null texts and texts without words
    have an empty set and are linked with nothing.  Rows with the same id are
    documents of their own.  An empty table gives no row.
    """
    rows = signatures(docs, size, id_col, text_col)
    at = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    sets = cut(rows.where("n_shingles > 0").groupBy("n_shingles", "digest").agg(
        F.min(at).alias("at"), F.count("*").alias("n"), F.first("tokens").alias("tokens")).withColumn("row", F.col("at.row")))
    links = cut(similar_links(rows, sets.select("row", "n_shingles", "tokens"), percent, size))
    roots = connected_components(links).select(F.col("node").alias("row"), "root")
    rooted = sets.select("n_shingles", "digest", "at", "n", "row").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    classes = cut(rooted.select("n_shingles", "digest", "at", "n", "root"))
    first = classes.groupBy("root").agg(F.min("at").alias("first"))
    known = cut(classes.join(first, "root").select("n_shingles", "digest", F.col("first.id").alias("component_id"), "n"))
    narrow = rows.select("id", "n_shingles", "digest")
    worded = join_counted(narrow, known, ["n_shingles", "digest"]).select("id", "n_shingles", "component_id")
    bare = narrow.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return worded.union(bare).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
