"""Spelling variants by a bit-sliced position index.

For a block of words there is one bit set for every (position, letter): the
words with that letter at that place.  A query word is read letter by letter;
the words that agree with it so far, those with one letter replaced and those
with one letter more are three bit sets that are carried on together, the last
one by the sets of the position shifted by one.

Two words one edit apart have the first or the last half of the shorter one in
common, so words are dealt by (length of the shorter, side, half) and a block
only holds words that share one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.skew import join_counted
from tallyloom.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block at most; a half that more words share is cut into such blocks, which meet each other.
BLOCK = 2048
#: Query words that are carried through a block side by side.
STEP = 512


def vocabulary(docs: DataFrame, least_length: int = 7, least_n: int = 2, drop_one_in: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: the words of all whole texts, written.

    Runs of letters are lower-cased (A-Z only); if ``drop_one_in`` divides the
    crc32 of ``<id>:<run>`` (a null id is empty), the letter that it points to
    is left out.  Null texts hold no word.
    """
    # a shorter run can only become shorter
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least_length},}})")))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.select(F.translate("run", UPPER, LOWER).alias("run"), "id").withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    dropped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % drop_one_in == 0, dropped).otherwise(F.col("run")).alias("word"))
    return cut(words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n))


def bit_rows(flags: np.ndarray) -> np.ndarray:
    """Boolean rows as rows of 64-bit words."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)]).view(np.uint64)


def one_edit_apart(words: list[str], m: int, halves: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): words one edit apart, each pair once, where word i has ``m`` letters and word j ``m`` or ``m + 1``.

    Both must have the same number in ``halves``.  Where ``tail`` is set, the
    words are together for their last half, and pairs that have the first half
    in common too are left out: they meet elsewhere.
    """
    codes = np.zeros((len(words), m + 2), np.uint32)
    lengths = np.array([len(w) for w in words])
    for long in (m, m + 1):
        at = np.flatnonzero(lengths == long)
        if len(at):
            codes[at, :long] = np.frombuffer("".join(words[k] for k in at).encode("utf-32-le"), "<u4").reshape(len(at), long)
    letters, codes = np.unique(codes, return_inverse=True)
    codes = codes.reshape(len(words), m + 2)
    having = lambda at: bit_rows(codes[:, at] == np.arange(len(letters))[:, None])  # noqa: E731  (letters, words)
    same, longer = bit_rows(lengths == m), bit_rows(lengths == m + 1)
    kinds, half = np.unique(halves, return_inverse=True)
    partners = bit_rows(half == np.arange(len(kinds))[:, None])
    out_i, out_j = [], []
    queries = np.flatnonzero(lengths == m)
    for first in range(0, len(queries), STEP):
        q = queries[first:first + STEP]
        equal = partners[half[q]]
        replaced, inserted = np.zeros_like(equal), np.zeros_like(equal)
        here, met = having(0), equal.copy()
        for i in range(m):
            after = having(i + 1)
            now, shifted = here[codes[q, i]], after[codes[q, i]]
            inserted = (inserted | equal) & shifted
            replaced = (replaced & now) | (equal & ~now)
            equal = equal & now
            if i + 1 == m // 2:
                met = equal.copy()
            here = after
        near = (replaced & same) | ((inserted | equal) & longer)
        near[tail[q]] &= ~met[tail[q]]
        row, word = np.nonzero(near)
        bits = np.unpackbits(near[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(row) else np.zeros((0, 64), np.uint8)
        hit, bit = np.nonzero(bits)
        i, j = q[row[hit]], word[hit] * 64 + bit
        once = (lengths[j] > m) | (i < j)  # a replacement is found from both words
        out_i.append(i[once])
        out_j.append(j[once])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *out_i]), np.concatenate([empty, *out_j])


def dealt(words: DataFrame) -> DataFrame:
    """``(m, tail, half, x, y, block, word, n)``: a row for every block pair that a word of ``words (word, n)`` takes part in."""
    size = F.length("word")
    side = lambda m, tail: F.struct(
        m.alias("m"), F.lit(tail).alias("tail"),
        (F.substring("word", -1 * (m - F.floor(m / 2)).cast("int"), size) if tail else F.substring("word", F.lit(1), F.floor(m / 2).cast("int"))).alias("half"))
    ends = F.explode(F.array(*(side(m, tail) for m in (size, size - 1) for tail in (False, True))))
    posted = words.select("word", "n", ends.alias("e")).select("e.*", "word", F.col("n").alias("times"))
    keys = ["m", "tail", "half"]
    counts = cut(posted.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))
    met = join_counted(posted, counts, keys)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select(*keys, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "word", F.col("times").alias("n"))


def near_stats(words: DataFrame) -> DataFrame:
    """``(word, n_near, best struct<minus_n, form>)`` of the words of ``words (word, n)`` that have a near word."""
    spark = words.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = ["m", "tail", "half", "x", "y"]
    work = dealt(words).repartition(parts, *keys).sortWithinPartitions(*keys)

    def stats(batches):
        for table in whole_groups(batches, len(keys)):
            column = {c: table.column(c).to_pylist() for c in ("m", "tail", "x", "y", "block", "word", "n")}
            half = table.column("group").to_numpy()
            block, x, y = (np.array(column[c]) for c in ("block", "x", "y"))
            i, j = one_edit_apart(column["word"], column["m"][0], half, np.array(column["tail"], bool))
            apart = (x == y)[i] | (block[i] != block[j])  # of two blocks only what lies between them
            i, j = i[apart], j[apart]
            if not len(i):
                continue
            order = sorted(range(len(half)), key=lambda k: (-column["n"][k], column["word"][k]))  # noqa: B023
            rank = np.empty(len(half), np.int64)
            rank[order] = np.arange(len(half))
            n_near, best = np.bincount(np.concatenate([i, j]), minlength=len(half)), np.full(len(half), len(half))
            np.minimum.at(best, np.concatenate([i, j]), rank[np.concatenate([j, i])])
            at = np.flatnonzero(n_near)
            forms = [order[b] for b in best[at]]
            yield pa.RecordBatch.from_arrays([
                pa.array([column["word"][k] for k in at]), pa.array(n_near[at]),
                pa.array([-column["n"][k] for k in forms], pa.int64()), pa.array([column["word"][k] for k in forms])],
                names=["word", "n_near", "minus_n", "form"])

    found = work.mapInArrow(stats, "word string, n_near long, minus_n long, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "form")).alias("best"))


def whole_groups(batches, keys: int):
    """Tables of whole groups (the first ``keys`` columns) from sorted batches, with a column ``group`` that numbers them.

    Groups of one ``m`` go together up to a block's size; a group is at most
    two blocks.
    """
    held: list[pa.Table] = []
    rows = 0

    def numbered(table: pa.Table) -> list[pa.Table]:
        change = np.zeros(len(table), bool)
        new_m = np.zeros(len(table), bool)
        for k in range(keys):
            values = table.column(k).combine_chunks()
            differs = pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
            change[1:] |= differs
            if k == 0:
                new_m[1:] = differs
        starts = np.flatnonzero(np.concatenate([[True], change[1:]]))
        table = table.append_column("group", pa.array(np.cumsum(change)))
        out, begin = [], 0
        for a, b in zip(starts, [*starts[1:], len(table)]):
            if a > begin and (new_m[a] or b - begin > BLOCK):
                out.append(table.slice(begin, a - begin))
                begin = a
        return out + [table.slice(begin)]

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if rows > 8 * BLOCK:
            parts = numbered(pa.concat_tables(held))
            yield from parts[:-1]
            held = [parts[-1].drop_columns(["group"])]
            rows = len(held[0])
    if rows:
        yield from numbered(pa.concat_tables(held))


def with_roots(words: DataFrame) -> DataFrame:
    """``words (word, form)`` with ``root``: the last word that is reached over forms, by doubling the way that is known."""
    steps = cut(words.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = cut(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return words.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, least_length: int = 7, least_n: int = 2, ratio: int = 10, drop_one_in: int = 31, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of at least ``least_length`` letters and ``least_n`` occurrences.

    Words are near if one letter is inserted, deleted or replaced between
    them.  A word's form is its most frequent near word (ties: the smallest in
    code-point order) if that occurs ``ratio`` times as often or more; its root
    is where following forms ends, the word itself without a form.  Forms
    grow in frequency, so there is no cycle.  No texts: no row.
    """
    words = vocabulary(docs, least_length, least_n, drop_one_in, id_col, text_col)
    near = words.join(near_stats(words), "word", "left")
    best_n = -F.col("best.minus_n")
    has_form = best_n >= ratio * F.col("n")
    known = cut(near.select(
        "word", F.when(has_form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has_form, best_n).alias("form_n")))
    return with_roots(known).select("word", "form", "root", "n", "n_near", "form_n")
