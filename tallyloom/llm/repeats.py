"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``span`` bytes that covers it also starts somewhere
else.  Suffixes are only sorted against those they can share a string with:

1. Equal texts, told by a 64-bit hash and the length, become one with a count.
   They are shuffled and written once, bucketed by that key, so later joins
   do not shuffle them.
2. Every string of ``span`` bytes is owned by an anchor, the least hash of its
   ``GRAM``-byte grams.  Equal strings have equal anchors.  An anchor that
   occurs once in the corpus needs no further look.
3. The stretch of text around an anchor that covers the strings it owns is a
   slice.  A slice that occurs twice repeats as a whole; of slices that differ
   one of each kind goes on.
4. Slices of an anchor meet in one task, where two-stage sorting builds their
   suffix array: suffixes smaller than their successor are sorted directly,
   the rest is induced by scans over the buckets.  Neighbours that share
   ``span`` bytes are repeats.  Anchors with very many different slices take
   ``MOST_KINDS``'s way.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

SPAN = 200
GRAM = 32
#: Bytes of slices that are sorted together; a group of one anchor is never cut.
BATCH_BYTES = 1 << 20
#: An anchor with more different slices than this, such as the edge of a passage
#: that very many texts share, is not sorted in one task: its strings are
#: counted by their own 128-bit hash, each in its own group.
MOST_KINDS = 4096
#: Texts are hashed in stretches of this many bytes.
STRETCH = 1 << 22
PLACE_BITS = 23
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as an unsigned integer, big-endian; zeros behind the end."""
    n = len(data)
    padded = np.zeros((n + 15) // 8 * 8 + 8, np.uint8)
    padded[:n] = data
    out = np.empty(len(padded), np.uint64)
    for shift in range(8):
        part = padded[shift: shift + (len(padded) - shift) // 8 * 8].view(">u8")
        out[shift::8][:len(part)] = part
    return out[:n]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    words = words_at(data)
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k, factor in enumerate(MIX):
        h += words[8 * k: 8 * k + n]
        h *= np.uint64(factor)
        h ^= h >> np.uint64(29)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by running minima within blocks from both ends."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def anchors(text: bytes, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, last start) of runs of strings owned by one anchor."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    width = span - GRAM + 1
    for base in range(0, len(text) - span + 1, STRETCH):
        data = np.frombuffer(text, np.uint8, min(STRETCH + span - 1, len(text) - base), base)
        h = gram_hashes(data)
        # upper bits of the hash, then the place counted down: of equal hashes the rightmost is the least.
        # Only so do equal strings of one text never share an owner, which would hide them in one slice.
        places = np.uint64((1 << PLACE_BITS) - 1) - np.arange(len(h)).astype(np.uint64)
        least = sliding_least(h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | places, width)
        place = (1 << PLACE_BITS) - 1 - (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        out.append((h[place[first]].view(np.int64), first + base, last + base))
    return tuple(np.concatenate(c) for c in zip(*out))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes of ``text`` (small integers, ends with its least one) in order of their first ``depth`` entries.

    Type B: smaller than the suffix behind it.  The B suffixes of each first
    letter are sorted directly and stand at the end of its bucket.  The rest
    follows bucket by bucket: in order, the predecessor of each suffix goes to
    the next free place at the front of its own bucket.
    """
    n = len(text)
    # a run of equal letters has the type of its last letter against the next run
    change = np.flatnonzero(text[1:] != text[:-1])
    run_end = np.concatenate([change, [n - 1]])
    rises = np.concatenate([text[change] < text[change + 1], [False]])
    lengths = np.diff(np.concatenate([[-1], run_end]))
    is_b = np.repeat(rises, lengths)
    raw = text.astype(">u2").tobytes()
    b_places = np.array(sorted(np.flatnonzero(is_b).tolist(), key=lambda i: raw[2 * i:2 * (i + depth)]), np.int64)
    top = int(text.max()) + 1
    size = np.bincount(text, minlength=top)
    n_b = np.bincount(text[b_places], minlength=top)
    starts = np.cumsum(size) - size
    order = np.full(n, -1, np.int64)
    at = np.repeat(starts + size - n_b, n_b) + np.arange(len(b_places)) - np.repeat(np.cumsum(n_b) - n_b, n_b)
    order[at] = b_places
    front = starts.copy()

    def put(places):
        """Non-B places, in the order found, to the fronts of their buckets."""
        letters = text[places]
        by = np.argsort(letters, kind="stable")
        letters, places = letters[by], places[by]
        counts = np.bincount(letters, minlength=top)
        at = np.repeat(front, counts) + np.arange(len(places)) - np.repeat(np.cumsum(counts) - counts, counts)
        order[at] = places
        front[:] += counts

    put(np.array([n - 1]))  # the last suffix has nothing behind it, so it is induced from the end
    for letter in np.flatnonzero(size):
        done, end_a = starts[letter], starts[letter] + size[letter] - n_b[letter]
        while done < end_a:  # places put into this bucket while it is scanned are scanned in turn
            now = order[done:front[letter]]
            done += len(now)
            before = now[now > 0] - 1
            put(before[~is_b[before]])
        tail = order[end_a:end_a + n_b[letter]]
        before = tail[tail > 0] - 1
        put(before[~is_b[before]])
    return order


def repeated_starts(slices: list[bytes], span: int = SPAN) -> list[np.ndarray]:
    """For each slice a flag for each start of a ``span``-byte string: does it occur again in these slices?"""
    # letters 1..256, each slice ended by 0
    text = np.concatenate([x for s in slices for x in (np.frombuffer(s, np.uint8).astype(np.int64) + 1, np.zeros(1, np.int64))])
    ends = np.cumsum([len(s) + 1 for s in slices])
    lengths = np.array([len(s) for s in slices])
    room = np.repeat(ends - 1, lengths + 1) - np.arange(len(text))  # bytes to the end of the slice
    order = suffix_array(text, span)
    order = order[room[order] >= span]  # those that hold a whole string
    a, b = order[:-1], order[1:]
    data = words_at(np.frombuffer(b"".join(s + b"\0" for s in slices), np.uint8))
    same = np.ones(len(a), bool)
    for k in range(0, span - 7, 8):  # common prefixes, eight bytes at a time
        live = np.flatnonzero(same)
        if not len(live):
            break
        same[live] = data[a[live] + k] == data[b[live] + k]
    if span % 8:
        live = np.flatnonzero(same)
        same[live] = data[a[live] + span - 8] == data[b[live] + span - 8]
    hit = np.zeros(len(text), bool)
    hit[a[same]] = hit[b[same]] = True
    return [hit[e - 1 - n:e - 1][:max(0, n - span + 1)] for e, n in zip(ends, lengths)]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def packed(first, last, span: int):
    """First start and number of further starts in one long; the starts of one anchor lie within a span."""
    return first * span + (last - first)


def find_repeats(docs: DataFrame, span: int = SPAN, text_col: str = "text") -> tuple[DataFrame, DataFrame, str]:
    """(texts, repeats, table): distinct texts ``(key, size, text, copies)`` and their runs of repeated starts ``(key, size, runs)``.

    ``table`` names the bucketed table in the warehouse that holds the texts;
    drop it when the result is written.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = f"repeats_{uuid.uuid4().hex}"
    docs.select(F.xxhash64(text).alias("key"), F.octet_length(text).alias("size"), text.alias("text")) \
        .groupBy("key", "size").agg(F.min("text").alias("text"), F.count("*").alias("copies")) \
        .write.option("compression", "zstd").bucketBy(n, "key", "size").saveAsTable(name)
    texts = spark.table(name)

    def owned(batches):
        for batch in batches:
            rows = [anchors(t.as_buffer().to_pybytes(), span) for t in batch.column(2)]
            counts = [len(r[0]) for r in rows]
            if sum(counts):
                anchor, first, last = (np.concatenate(c) for c in zip(*rows))
                keys = (np.repeat(batch.column(c).to_numpy(), counts) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, *keys, packed(first, last, span))], names=["anchor", "key", "size", "run"])

    long_texts = texts.where(F.col("size") >= span).select("key", "size", F.col("text").cast("binary"))
    runs = cut(long_texts.mapInArrow(owned, "anchor long, key long, size int, run long"))
    # written, so that both sides of the join are plain exchanges, which Spark splits where an anchor is hot
    twice = cut(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    wanted = runs.join(twice, "anchor").groupBy("key", "size").agg(F.collect_list(F.struct("run", "anchor")).alias("runs"))

    def sliced(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                part = batch.slice(at, 64)
                for key, size, data, runs in zip(*(c.to_pylist() for c in part.columns)):
                    for r in runs:
                        first, more = divmod(r["run"], span)
                        piece = data[first:first + more + span]
                        out.append((r["anchor"], hashlib.blake2b(piece, digest_size=16).digest(), key, size, r["run"], piece))
                kinds = pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["anchor", "slice", "key", "size", "run", "piece"])

    slices = cut(texts.select("key", "size", F.col("text").cast("binary").alias("data")).join(wanted, ["key", "size"]).select("key", "size", "data", "runs")
                 .mapInArrow(sliced, "anchor long, slice binary, key long, size int, run long, piece binary"))
    kinds = slices.groupBy("anchor", "slice").agg(F.count("*").alias("n"), F.min("piece").alias("piece"))
    kinds = cut(kinds)
    differing = cut(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    to_sort = kinds.join(differing.where(F.col("kinds") <= MOST_KINDS), "anchor").repartition(n, "anchor").sortWithinPartitions("anchor").select("anchor", "slice", "piece")

    def sort(batches):
        held, size, last = [], 0, None

        def found():
            flags = repeated_starts([p for _, _, p in held], span)
            rows = [(a, s, [{"first": x, "last": y} for x, y in runs_of(f)]) for (a, s, _), f in zip(held, flags) if f.any()]
            kinds = pa.int64(), pa.binary(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((), (), ()), kinds)], names=["anchor", "slice", "hits"])

        for batch in batches:
            for anchor, name, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if held and anchor != last and size > BATCH_BYTES:
                    yield found()
                    held, size = [], 0
                held.append((anchor, name, piece))
                size, last = size + len(piece), anchor
        if held:
            yield found()

    def strings(batches):
        for batch in batches:
            for anchor, name, piece in zip(*(c.to_pylist() for c in batch.columns)):
                starts = range(len(piece) - span + 1)
                hashes = [hashlib.blake2b(piece[i:i + span], digest_size=16).digest() for i in starts]
                yield pa.RecordBatch.from_arrays([
                    pa.array([anchor] * len(hashes), pa.int64()), pa.array([name] * len(hashes), pa.binary()),
                    pa.array(starts, pa.int32()), pa.array(hashes, pa.binary())], names=["anchor", "slice", "at", "string"])

    counted = cut(kinds.join(differing.where(F.col("kinds") > MOST_KINDS), "anchor").select("anchor", "slice", "piece")
                  .mapInArrow(strings, "anchor long, slice binary, at int, string binary"))
    again = cut(counted.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string"))
    counted_hits = counted.join(again, "string").groupBy("anchor", "slice").agg(
        F.collect_list(F.struct(F.col("at").alias("first"), F.col("at").alias("last"))).alias("hits"))
    hits = to_sort.mapInArrow(sort, "anchor long, slice binary, hits array<struct<first:int,last:int>>").union(counted_hits)
    whole = kinds.where("n > 1").select("anchor", "slice", F.lit(True).alias("whole"))
    flagged = cut(whole.join(hits, ["anchor", "slice"], "full").select("anchor", "slice", F.coalesce("whole", F.lit(False)).alias("whole"), "hits"))
    first = F.floor(F.col("run") / span)
    all_starts = F.array(F.struct(F.lit(0).alias("first"), (F.col("run") % span).cast("int").alias("last")))
    repeats = slices.select("anchor", "slice", "key", "size", "run").join(flagged, ["anchor", "slice"]) \
        .select("key", "size", F.explode(F.when(F.col("whole"), all_starts).otherwise(F.col("hits"))).alias("h"), first.alias("at")) \
        .groupBy("key", "size").agg(F.collect_list(F.struct((F.col("at") + F.col("h.first")).alias("first"), (F.col("at") + F.col("h.last")).alias("last"))).alias("runs"))
    return texts, repeats, name


def removed_runs(size: int, copies: int, runs: list[dict], span: int = SPAN) -> list[list[int]]:
    """Merged byte ranges [from, to) covered by repeated strings."""
    if copies > 1 and size >= span:
        return [[0, size]]
    out: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in runs or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + span)
        else:
            out.append([first, last + span])
    return out


def without_repeats(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes long, removed array<struct<from, to>>, kept binary)`` for every row of ``docs``.

    ``kept`` are the UTF-8 bytes that remain.  A null text counts as empty;
    texts shorter than ``span`` keep everything; repeated rows lose everything
    if they are long enough.
    """
    per_text, name = _kept_texts(docs, span, text_col)
    out = _joined(docs, cut(per_text), id_col, text_col)
    docs.sparkSession.sql(f"DROP TABLE {name}")
    return out


def repeat_digests(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``without_repeats`` as numbers: ``n_bytes, n_removed, n_spans, kept_sha256``."""
    per_text, name = _kept_texts(docs, span, text_col)
    digest = per_text.select("key", "size", F.col("n_bytes"), (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                             F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    out = _joined(docs, cut(digest), id_col, text_col)
    docs.sparkSession.sql(f"DROP TABLE {name}")
    return out


def _kept_texts(docs: DataFrame, span: int, text_col: str) -> tuple[DataFrame, str]:
    texts, repeats, name = find_repeats(docs, span, text_col)

    def keep(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                removed, kept = [], []
                for size, copies, data, runs in zip(*(c.to_pylist() for c in part.columns[1:])):
                    gone = removed_runs(size, copies, runs, span)
                    edges = [0, *(x for r in gone for x in r), size]
                    removed.append([{"from": a, "to": b} for a, b in gone])
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(1).cast(pa.int64()),
                    pa.array(removed, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.binary()),
                ], names=["key", "size", "n_bytes", "removed", "kept"])

    rows = texts.join(repeats, ["key", "size"], "left").select("key", "size", "copies", F.col("text").cast("binary").alias("data"), "runs")
    return rows.mapInArrow(keep, "key long, size int, n_bytes long, removed array<struct<from:bigint,to:bigint>>, kept binary"), name


def _joined(docs: DataFrame, per_text: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.octet_length(text).alias("size"))
    return keys.join(per_text, ["key", "size"]).drop("key", "size").withColumnRenamed("id", id_col)
