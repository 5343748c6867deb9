"""Token files: canonical length-limited Huffman codes in independent blocks.

A token file is a folder of two Parquet tables.

``codebook``  ``(token int, bits int)``.  Code words are canonical: ordered by
(bits, token) and counted upwards, so the lengths say everything.

``frames``  one row for a run of whole documents in ascending order:
``shard int, before long, n_tokens long, doc_ids array<long>,
lengths array<long>, blocks array<binary>``; ``before`` counts the ids of the
frames before it in its shard.  A block holds at most
``BLOCK`` tokens and can be decoded alone: ``tokens u32, bits u32``, then the
bit offset (u32) of every ``STEP``-th token, then the code bits, high bit
first.  The offsets let a reader start anywhere, and let this one decode all
stretches of a frame side by side, one table look-up for each token.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.tokens import ids_array, token_counts, token_table, word_ids
from tallyloom.session import cut

BLOCK = 1 << 18
STEP = 128
#: Longest code word; the decoding table has two to this power entries.
MAX_BITS = 20

FRAME = "shard int, before long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, blocks array<binary>"


def code_lengths(counts: Sequence[int], limit: int = MAX_BITS) -> np.ndarray:
    """Code lengths of least total cost with none above ``limit``.

    Package-merge: in each of ``limit`` rounds neighbours of the sorted list
    are packed in pairs and merged with the symbols again; a symbol's length
    is how often it is among the first 2n - 2 entries over the rounds.  Ties
    go to the lower position.  One symbol alone gets one bit.
    """
    counts = np.asarray(counts, np.int64)
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    own = counts[order]
    rounds, weights = [], own
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([own, pairs])
        at = np.argsort(both, kind="stable")
        rounds.append(at < n)
        weights = both[at]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_symbol in reversed(rounds):
        symbols = int(is_symbol[:take].sum())
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Code words of a token set from their lengths."""

    def __init__(self, tokens: Sequence[int], bits: Sequence[int]):
        tokens, bits = np.asarray(tokens, np.int64), np.asarray(bits, np.int64)
        order = np.lexsort((tokens, bits))
        self.tokens, self.bits = tokens[order], bits[order]
        self.longest = int(self.bits[-1]) if len(bits) else 1
        # in canonical order each word is the sum of the shares of those before it
        share = np.int64(1) << (self.longest - self.bits)
        self.first = np.cumsum(share) - share
        size = int(self.tokens.max()) + 1 if len(tokens) else 0
        self.word, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.word[self.tokens] = self.first >> (self.longest - self.bits)
        self.length[self.tokens] = self.bits
        self.share = share

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Next ``longest`` bits -> (token, bits)."""
        tokens, bits = np.zeros(1 << self.longest, np.uint32), np.ones(1 << self.longest, np.int64)
        n = int(self.share.sum())
        tokens[:n], bits[:n] = np.repeat(self.tokens, self.share), np.repeat(self.bits, self.share)
        return tokens, bits

    def block(self, ids: np.ndarray) -> bytes:
        bits = self.length[ids]
        ends = np.cumsum(bits)
        starts, total = ends - bits, int(ends[-1])
        # each word lies within two neighbouring 32-bit cells; bits never overlap, so sums join them
        cell, window = starts >> 5, self.word[ids] << (64 - (starts & 31) - bits).astype(np.uint64)
        n = (total >> 5) + 2
        cells = np.bincount(cell, (window >> np.uint64(32)).astype(np.float64), n)
        cells += np.bincount(cell + 1, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        packed = cells.astype(np.uint32).astype(">u4").tobytes()[: (total + 7) >> 3]
        return np.array([len(ids), total], "<u4").tobytes() + starts[::STEP].astype("<u4").tobytes() + packed


def decode_blocks(blocks: Sequence[bytes], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Tokens of the blocks in order, as unsigned 32-bit integers."""
    tokens, bits = table
    longest = len(tokens).bit_length() - 1
    buffers, lanes, sizes, base = [], [], [], 0
    for b in blocks:
        n, total = np.frombuffer(b, "<u4", 2)
        marks = -(-int(n) // STEP)
        lanes.append(np.frombuffer(b, "<u4", marks, 8).astype(np.int64) + base * 8)
        size = np.full(marks, STEP, np.int64)
        size[-1] = int(n) - STEP * (marks - 1)
        sizes.append(size)
        buffers.append(np.frombuffer(b, np.uint8, offset=8 + 4 * marks))
        base += len(buffers[-1])
    data = np.concatenate([*buffers, np.zeros(4, np.uint8)]).astype(np.int64)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at, size = np.concatenate(lanes), np.concatenate(sizes)
    out = np.zeros((STEP, len(at)), np.uint32)
    mask, top = (1 << longest) - 1, 32 - longest
    for i in range(int(size.max())):
        # a lane that has ended runs on harmlessly over bits it does not own
        at = np.minimum(at, (len(window) - 1) * 8)
        word = (window[at >> 3] >> (top - (at & 7))) & mask
        out[i] = tokens[word]
        at = at + bits[word]
    return out.T[np.arange(STEP) < size[:, None]]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write a token file at ``path``.

    Documents lie in ascending order of id (null first, equal ids by text
    hash; repeated rows are repeated).  A null or empty text is a document
    without tokens, but for the end id.  An empty table gives an empty file.

    The texts are ordered first and their ids written once; only the counts,
    at most one row for each vocabulary entry, come to the driver.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(n, F.asc_nulls_first("doc_id"), "tie")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
        .select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    )
    ids, width = cut(token_table(ordered, tokenizer, end_id)), word_ids(tokenizer).width
    counts = sorted((r.token, r.n) for r in token_counts(ids, width).collect())
    tokens = [t for t, _ in counts]
    lengths = code_lengths([n for _, n in counts])
    spark.createDataFrame([(t, int(b)) for t, b in zip(tokens, lengths)], "token int, bits int") \
        .coalesce(1).write.parquet(f"{path}/codebook")

    def frames(batches):
        book, shard, first, doc_ids, held, n_held = Codebook(tokens, lengths), None, 0, [], [], 0

        def row():
            ids = ids_array(b"".join(held), width)
            blocks = [book.block(ids[i:i + BLOCK]) for i in range(0, len(ids), BLOCK)]
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(h) // width for h in held]], pa.list_(pa.int64())),
                pa.array([blocks], pa.list_(pa.binary())),
            ], names=["shard", "before", "n_tokens", "doc_ids", "lengths", "blocks"])

        for batch in batches:
            for own, before, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns)):
                size = len(ids) // width
                # a frame is a run of neighbours: another file of the table may follow in the same task
                if doc_ids and (n_held + size > BLOCK or own != shard or before != first + n_held):
                    yield row()
                    doc_ids, held, n_held = [], [], 0
                if not doc_ids:
                    shard, first = own, before
                doc_ids.append(doc_id)
                held.append(ids)
                n_held += size
        if doc_ids:
            yield row()

    ids.mapInArrow(frames, FRAME).write.parquet(f"{path}/frames")


def read_codebook(spark: SparkSession, path: str) -> Codebook:
    rows = spark.read.parquet(f"{path}/codebook").collect()  # at most the vocabulary
    return Codebook([r.token for r in rows], [r.bits for r in rows])


def read_tokens(spark: SparkSession, path: str, id_type: str = "array<bigint>") -> DataFrame:
    """``(doc_id, start long, n_tokens long, ids)`` decoded from a token file.

    ``start`` counts the ids of all documents before.  The totals of the
    shards, one row for each, are added up on the driver.
    """
    return _decoded(spark, path, lambda ids: pa.array(ids, pa.list_(pa.int64())), f"ids {id_type}",
                    lambda ids: ids.astype(np.int64))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_tokens``, with ``ids_crc32 long`` (ids as little-endian u32) instead of the ids."""
    import zlib

    return _decoded(spark, path, lambda crc: pa.array(crc, pa.int64()), "ids_crc32 long",
                    lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _decoded(spark: SparkSession, path: str, column, field: str, of) -> DataFrame:
    frames, book = spark.read.schema(FRAME).parquet(f"{path}/frames"), read_codebook(spark, path)
    totals = {r.shard: r.n for r in frames.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    base, all_before = {}, 0
    for shard in sorted(totals):
        base[shard], all_before = all_before, all_before + totals[shard]

    def decode(batches):
        table = book.table()
        for batch in batches:
            for row in batch.to_pylist():
                parts = [decode_blocks([b], table) for b in row["blocks"]]
                ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["before"] + base[row["shard"]], pa.int64()),
                    pa.array(row["lengths"], pa.int64()), column([of(ids[a:b]) for a, b in zip(starts, ends)]),
                ], names=["doc_id", "start", "n_tokens", field.split()[0]])

    return frames.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {field}")
