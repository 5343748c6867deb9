"""Best-fit packing by minimum bin slack.

All pieces of one length are alike, so the bins are planned on the histogram
of lengths, which has at most as many rows as a bin has tokens, whatever the
number of documents.  For each bin a subset-sum program over the lengths still
at hand, one bit for each reachable fill, finds the fullest combination that
holds the longest piece; it is taken out and repeated while its lengths last.
Pieces then find their place by their rank among those of the same length.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.tokens import end_bytes, word_ids
from tallyloom.llm.columns import named
from tallyloom.session import cut


def fullest(left: Mapping[int, int], capacity: int) -> dict[int, int]:
    """Length -> copies of the fullest bin with the longest piece in it.

    ``reach`` has bit f set if fill f can be reached.  Longer pieces come
    first, so of two equally full bins the one that needs fewer short pieces
    tends to win; the search ends once the bin can be filled to the brim.
    """
    longest = max(left)
    room = capacity - longest
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for size in sorted((s for s in left if s <= room), reverse=True):
        before, copies = reach, min(left[size] - (size == longest), room // size)
        for _ in range(copies):
            more = (reach | reach << size) & mask
            if more == reach:
                break
            reach = more
        steps.append((size, before))
        if reach >> room & 1:
            break
    fill, out = reach.bit_length() - 1, {longest: 1}
    for size, before in reversed(steps):
        while not before >> fill & 1:
            fill -= size
            out[size] = out.get(size, 0) + 1
    return out


def plan_bins(counts: Mapping[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many alike, length -> copies)."""
    left = {size: n for size, n in counts.items() if n > 0}
    if left and (max(left) > capacity or min(left) < 1):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    plan = []
    while left:
        one = fullest(left, capacity)
        times = min(left[size] // n for size, n in one.items())
        plan.append((times, one))
        for size, n in one.items():
            left[size] -= times * n
            if not left[size]:
                del left[size]
    return plan


def slots(plan: list[tuple[int, dict[int, int]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Length -> (first rank, first bin, offset, copies in a bin) in ascending order of rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for times, one in plan:
        offset = 0
        for size in sorted(one, reverse=True):
            out.setdefault(size, []).append((ranks.get(size, 0), base, offset, one[size]))
            ranks[size] = ranks.get(size, 0) + times * one[size]
            offset += size * one[size]
        base += times
    return out


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int = 2048,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece int, start long, length long, ids binary)``.

    Whole documents with their end id; only longer ones are cut, into pieces
    of ``capacity`` tokens.  ``ids`` are little-endian, two bytes each if the
    vocabulary allows it, else four.  Null and empty texts have the end id
    alone; without an end id they have no piece.
    """

    def cut_up(batches):
        words = word_ids(tokenizer)
        end, step = end_bytes(end_id, words.width), capacity * words.width
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    rows.append((doc_id, piece, at // words.width, len(part) // words.width, part))
                    held += len(part)
                    if held > 1 << 23:
                        yield piece_batch(rows)
                        rows, held = [], 0
            if rows:
                yield piece_batch(rows)

    def piece_batch(rows):
        kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                          names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)) \
        .mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """``pieces`` (any columns, lengths 1..capacity) plus ``sequence_id long, offset long``.

    Sequences are numbered from 0 and filled without gaps; which of the pieces
    of equal length goes where is arbitrary.  The input is written once.  A
    length that most pieces share is dealt over salts, whose counts, summed
    up, give each piece its rank.  Lengths are checked; a null length is an error.
    Columns called ``sequence_id`` or ``offset`` are replaced.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    salts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(pieces.select(
        F.struct(*named(own)).alias("row"),
        F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("size"),
        F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"),
    ))
    counts = rows.groupBy("size", "salt").count()
    plan = plan_bins({r.size_: r.n for r in counts.groupBy(F.col("size").alias("size_")).agg(F.sum("count").alias("n")).collect()}, capacity)
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("size", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    in_salt = Window.partitionBy("size", "salt").orderBy(F.lit(0))
    ranked = rows.join(base.hint("merge"), ["size", "salt"]).select(
        "row", "size", (F.col("base") + F.row_number().over(in_salt) - 1).alias("rank"))
    # one row for each length, at most ``capacity``
    places = pieces.sparkSession.createDataFrame(
        list(slots(plan).items()), "size long, slots array<struct<rank:bigint,bin:bigint,offset:bigint,copies:bigint>>")
    slot = F.element_at(F.filter("slots", lambda s: s["rank"] <= F.col("rank")), -1)
    rest = F.col("rank") - F.col("slot.rank")
    return ranked.join(F.broadcast(places), "size").withColumn("slot", slot).select(
        "row.*",
        (F.col("slot.bin") + F.floor(rest / F.col("slot.copies"))).cast("long").alias("sequence_id"),
        (F.col("slot.offset") + rest % F.col("slot.copies") * F.col("size")).cast("long").alias("offset"),
    )
