"""Correlations of all pairs of many features, block by block.

Features are cut into blocks and samples into chunks.  A block of a chunk is
one packed row; each pair of blocks meets chunk by chunk in a stream that keeps
six small matrices of sums, from which the correlation over the samples that
have both features follows exactly.  No pair of rows is ever joined, and
nothing grows with the number of samples in one task.

Wide tables that are mostly empty are cut into blocks by their cells instead:
each pair of blocks meets as the samples' lists of cells in both, and only
pairs of features that share a sample are ever counted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, DoubleType

from tallyloom.functions.labels import correlation_strength
from tallyloom.operators.ordering import running, top_rows
from tallyloom.operators.statistics import correlation_p
from tallyloom.session import broadcast_rows, cut

#: Features of a block and samples of a chunk: a packed row holds at most their product.
BLOCK, CHUNK = 128, 2048
#: The same where there are more than ``WIDE`` features: every block is sent to all that it shares a chunk with,
#: so few large ones; a task then keeps 200 MB of sums.
WIDE, WIDE_BLOCK, WIDE_CHUNK = 64 * BLOCK, 2048, 512
#: Cost of a sample, and of a pair of its cells, against that of a place of matrices multiplied whole (measured: 60 us, 50 ns, 0.8 ns).
SAMPLE_COST, CELL_COST = 75_000, 60
#: Cells of one block where most cells are missing (12 bytes each, two blocks in a task), of one task before that, and the
#: least number of blocks that a table of some such tasks is cut into; a cell is sent to all blocks that its sample is in.
SPARSE_CELLS, TASK_CELLS, SPARSE_BLOCKS = 8_000_000, 500_000, 4
#: More features than this go that way if less than this share of their cells is there (a pair of cells costs as much as some hundred places).
MANY, FILLED = 8 * BLOCK, 0.1
#: Pairs of cells looked at at once, and counters that they may be spread over.
MET_CELLS, COUNTERS = 1_000_000, 4_000_000
#: A feature's number is its part's, shifted by these bits, and its place there (as ``monotonically_increasing_id`` has it).
PART_BITS = 33
#: Pairs of one batch of results.
OUT_ROWS = 100_000
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def numbered(rows: DataFrame, by: Sequence[str], column: str, name: str) -> DataFrame:
    """``(*by, column, name, name_all)``: place 0.. of each distinct ``column`` in its group, and how many there are."""
    distinct = rows.select(*by, column).distinct().withColumn("_all", F.lit(0))
    placed = running(distinct, ["_all", *by], [F.col(column)], totals={f"{name}_all": None}, position=name)
    return placed.withColumn(name, F.col(name) - 1).drop("_all")


def packed_blocks(rows: DataFrame, by: Sequence[str], sample: str, feature: str, value: str, block: int | None, chunk: int | None, raw: bool) -> tuple[DataFrame, int, int]:
    """``(*by, chunk, block, blocks, chunks, names, cells)``: standardised (``raw``: plain) cells of a block of features in a chunk of samples;
    and how many features a block and samples a chunk has.

    Features that don't vary have no correlation and are left out of the standardised cells.
    """
    cells = cut(rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, sample, feature).agg(F.avg(value).alias("_x")))
    if raw:
        moments = cells.select(*by, feature).distinct().withColumns({"_m": F.lit(0.0), "_s": F.lit(1.0)})
    else:
        moments = cells.groupBy(*by, feature).agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s")).filter("_s > 0")
    features = cut(numbered(moments, by, feature, "_f").join(moments, [*by, feature]))
    samples = cut(numbered(cells, by, sample, "_i"))
    wide = (features.agg(F.max("_f_all")).first()[0] or 0) > WIDE
    block, chunk = block or (WIDE_BLOCK if wide else BLOCK), chunk or (WIDE_CHUNK if wide else CHUNK)
    placed = cells.join(features, [*by, feature]).join(samples, [*by, sample]).select(
        *by, F.floor(F.col("_i") / chunk).alias("chunk"), F.floor(F.col("_f") / block).alias("block"),
        F.ceil(F.col("_f_all") / block).alias("blocks"), F.ceil(F.col("_i_all") / chunk).alias("chunks"),
        F.struct((F.col("_i") % chunk).cast("int").alias("i"), (F.col("_f") % block).cast("int").alias("f"),
                 ((F.col("_x") - F.col("_m")) / F.col("_s")).alias("z")).alias("cell"))
    names = features.groupBy(*by, F.floor(F.col("_f") / block).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_f", feature))), lambda e: e[feature]).alias("names"))
    return placed.groupBy(*by, "chunk", "block", "blocks", "chunks").agg(F.collect_list("cell").alias("cells")).join(names, [*by, "block"]), block, chunk


def pair_sums(rows: DataFrame, by: Sequence[str], sample: str, feature: str, value: str, block: int | None = None, chunk: int | None = None,
              raw: bool = False, least_n: int = 1) -> DataFrame:
    """``(*by, a, b, n, sx, sy, sxx, syy, sxy)`` of every pair of features that share ``least_n`` samples, ``a`` before ``b``.

    The sums are of standardised values, or of the values as they are (``raw``).
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if block is None and mostly_empty(rows, by, sample, feature, value):
        return sparse_pair_sums(rows, by, sample, feature, value, raw, least_n)
    packed, block, chunk = packed_blocks(rows, by, sample, feature, value, block, chunk, raw)
    # few pairs of blocks are cut into slabs of chunks, so that there is work for every core; every slab adds a row for
    # each pair of features, so those of large blocks have some chunks
    pairs = F.col("blocks") * (F.col("blocks") + 1) / 2
    most = F.floor(F.col("chunks") / 16) if block == WIDE_BLOCK else F.col("chunks")
    slabs = F.greatest(F.lit(1), F.least(most, F.ceil(4 * parts / pairs)))
    packed = cut(packed.withColumn("slabs", slabs))
    # sums of one slab are whole and need not be added up, so pairs of too few samples never leave their task
    whole = (packed.agg(F.max("slabs")).first()[0] or 1) == 1
    least = least_n if whole else 1
    key = [*by, "x", "y", "slab"]
    # a block goes to those that have a sample of the same chunk
    there = packed.groupBy(*by, "chunk").agg(F.collect_list("block").alias("others"))
    dealt = packed.join(there, [*by, "chunk"]).withColumns({"slab": F.pmod("chunk", F.col("slabs")), "other": F.explode("others")}).select(
        *by, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "slab", "chunk", "block", "names", "cells")
    work = dealt.repartition(parts, *key).sortWithinPartitions(*key, "chunk", "block")
    schema = StructType([*(rows.schema[c] for c in by), *(StructField(c, rows.schema[feature].dataType) for c in ("a", "b")),
                         StructField("n", LongType()), *(StructField(c, DoubleType()) for c in SUMS[1:])])

    def multiply(batches):
        current, sums, names, held = None, None, {}, None
        types = None
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            for k in range(batch.num_rows):
                at = {c: batch.column(c)[k].as_py() for c in (*key, "chunk", "block")}
                group = tuple(at[c] for c in key)
                if group != current:
                    if current is not None:
                        yield from flushed(current, sums, names, types)
                    current, sums, names, held = group, None, {}, None
                names[at["block"]] = batch.column("names")[k].values
                cells = batch.column("cells")[k].values
                if at["x"] == at["y"]:
                    sums = added(sums, cells, cells, len(names[at["x"]]), len(names[at["y"]]), chunk)
                elif at["block"] == at["x"]:
                    held = (at["chunk"], cells)
                elif held is not None and held[0] == at["chunk"]:
                    sums = added(sums, held[1], cells, len(names[at["x"]]), len(names[at["y"]]), chunk)
        if current is not None:
            yield from flushed(current, sums, names, types)

    def flushed(group: tuple, sums, names: dict, types: list):
        if sums is None:
            return
        x, y = group[len(by)], group[len(by) + 1]
        both = sums[0] > least - 0.5
        if x == y:
            both = np.triu(both, 1)
        rows_of, columns_of = np.nonzero(both)
        for start in range(0, len(rows_of), OUT_ROWS):
            i, j = rows_of[start:start + OUT_ROWS], columns_of[start:start + OUT_ROWS]
            own = [pa.array([v] * len(i), t) for v, t in zip(group, types)]
            named = [names[b].take(pa.array(at)) for b, at in ((x, i), (y, j))]
            numbers = [pa.array(np.rint(m[i, j]).astype(np.int64) if c == 0 else m[i, j]) for c, m in enumerate(sums)]
            yield pa.RecordBatch.from_arrays([*own, *named, *numbers], names=[*by, "a", "b", *SUMS])

    out = work.mapInArrow(multiply, schema)
    return out if whole else out.groupBy(*by, "a", "b").agg(*(F.sum(c).alias(c) for c in SUMS)).filter(F.col("n") >= least_n)


def filled(cells: tuple, features: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where there is none) and marks of the cells of a packed row, (chunk, features)."""
    i, f, z = cells
    values, marks = np.zeros((chunk, features)), np.zeros((chunk, features))
    values[i, f], marks[i, f] = z, 1.0
    return values, marks


def added(sums, left: pa.StructArray, right: pa.StructArray, n_left: int, n_right: int, chunk: int) -> list[np.ndarray]:
    """``sums`` with the products of two packed rows of one chunk; sample by sample where few cells are there."""
    sums = [np.zeros((n_left, n_right)) for _ in SUMS] if sums is None else sums
    left, right = ([part.to_numpy() for part in cells.flatten()] for cells in (left, right))
    counts = [np.bincount(cells[0], minlength=chunk) for cells in (left, right)]
    shared = np.flatnonzero((counts[0] > 0) & (counts[1] > 0))
    if len(shared) * SAMPLE_COST + counts[0] @ counts[1] * CELL_COST > n_left * n_right * chunk:
        (x, has_x), (y, has_y) = filled(left, n_left, chunk), filled(right, n_right, chunk)
        for total, a, b in zip(sums, (has_x, x, has_x, x * x, has_x, x), (has_y, has_y, y, has_y, y * y, y)):
            total += a.T @ b
        return sums
    ends = [np.concatenate([[0], np.cumsum(n)]) for n in counts]
    (_, f, x), (_, g, y) = ([part[np.argsort(cells[0], kind="stable")] for part in cells] for cells in (left, right))
    flat = [total.reshape(-1) for total in sums]
    for s in shared:
        a, b = slice(ends[0][s], ends[0][s + 1]), slice(ends[1][s], ends[1][s + 1])
        at = (f[a].astype(np.int64)[:, None] * n_right + g[b]).ravel()  # a sample has a feature once
        xs, ys = np.repeat(x[a], len(y[b])), np.tile(y[b], len(x[a]))
        for total, new in zip(flat, (1.0, xs, ys, xs * xs, ys * ys, xs * ys)):
            total[at] += new
    return sums


def mostly_empty(rows: DataFrame, by: Sequence[str], sample: str, feature: str, value: str) -> bool:
    """Whether there are many features, so few of whose cells are there that a block by cells has more features than one of whole matrices.

    It only chooses between two ways to the same sums, so about how many there are will do.
    """
    about = F.approx_count_distinct
    sizes = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(about(feature).alias("f"), about(sample).alias("s"), F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max(F.struct("f", "s", "n"))).first()[0]
    if largest is None or largest.f <= MANY:
        return False
    return largest.n < FILLED * largest.f * largest.s and largest.s <= SPARSE_CELLS and largest.n / largest.f * WIDE_BLOCK < SPARSE_CELLS


def sparse_cells(rows: DataFrame, by: Sequence[str], sample: str, feature: str, value: str, raw: bool) -> tuple[DataFrame, DataFrame, int]:
    """``(*by, sample, _id, _z)``, ``(*by, feature, _id, _n)`` of the features in their order, and how many tasks the cells fill."""
    keys = [*by, feature]
    present = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).dropna(subset=[*keys, sample])
    tasks = 1 + present.count() // TASK_CELLS
    if raw:
        # the cells as they are, if their features can be sent
        counts = cut(present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
        if counts.count() <= broadcast_rows(rows.sparkSession):
            placed = running(counts.withColumn("_all", F.lit(0)), ["_all"], [F.col(c) for c in keys], {"_upto": "_n"}).withColumn(
                "_part", F.floor((F.col("_upto") - F.col("_n")) / TASK_CELLS))
            place = F.row_number().over(Window.partitionBy("_part").orderBy("position")) - 1
            index = cut(placed.select(*keys, (F.shiftleft(F.col("_part").cast("long"), PART_BITS) + place).alias("_id"), "_n"))
            return present.join(F.broadcast(index), keys).select(*by, sample, "_id", F.col(value).alias("_z")), index, tasks
    # a range of features has all of their cells, so means, moments and numbers need no other shuffle
    cells = present.repartitionByRange(tasks, *keys).groupBy(*by, sample, feature).agg(F.avg(value).alias("_x"))
    lists = cells.groupBy(*keys).agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"), F.collect_list(F.struct(F.col(sample).alias("s"), "_x")).alias("cells"))
    # a range is sorted before it is numbered
    lists = cut((lists if raw else lists.filter("_s > 0")).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    z = F.col("cell._x") if raw else (F.col("cell._x") - F.col("_m")) / F.col("_s")
    each = lists.select(*by, "_id", "_m", "_s", F.explode("cells").alias("cell")).select(*by, F.col("cell.s").alias(sample), "_id", z.alias("_z"))
    return each, lists.select(*keys, "_id", F.size("cells").alias("_n")), tasks


def sparse_pair_sums(rows: DataFrame, by: Sequence[str], sample: str, feature: str, value: str, raw: bool, least_n: int) -> DataFrame:
    """``pair_sums`` of a table most of whose cells are missing.

    Blocks are runs of features with a bounded number of cells.  A sample's
    cells are sent to each pair of blocks that it has cells of, as plain
    numbers; there every cell looks up the others of its sample, some features
    at a time.  Sums of a pair are whole, so those of few samples stay.
    """
    cells, index, tasks = sparse_cells(rows, by, sample, feature, value, raw)
    part = F.shiftright("_id", PART_BITS)
    sizes = index.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("features"), F.sum("_n").alias("cells")).orderBy("part").collect()
    most = sizes[-1].part + 1 if sizes else 1
    counts, filled_cells = np.zeros(most, np.int64), np.zeros(most, np.int64)
    for row in sizes:
        counts[row.part], filled_cells[row.part] = row.features, row.cells
    before = np.cumsum(filled_cells) - filled_cells
    total = int(filled_cells.sum())
    target = min(SPARSE_CELLS, max(TASK_CELLS, -(-total // SPARSE_BLOCKS)))
    block_of = before // max(target, 1)
    block_of = np.unique(block_of, return_inverse=True)[1]
    blocks = int(block_of[-1]) + 1
    first = np.cumsum(counts) - counts
    first -= first[np.searchsorted(block_of, block_of)]  # a feature's place in its block
    pairs = blocks * (blocks + 1) // 2
    pair_of = lambda x, y: x * blocks - x * (x - 1) // 2 + y - x
    sent = pa.schema([("pair", pa.int32()), *((f"{name}_{side}", pa.binary()) for side in "xy" for name in ("lengths", "at", "z")), ("part", pa.int32())])

    def deal(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        data = pa.Table.from_batches(batches)
        ids, z = data.column("_id").to_numpy(), data.column("_z").to_numpy()
        new = np.zeros(len(ids), bool)
        new[0] = True
        for c in (*by, sample):
            new[1:] |= pc.not_equal(data.column(c).slice(1), data.column(c).slice(0, len(ids) - 1)).to_numpy()
        fresh = new.copy()
        fresh[1:] |= ids[1:] != ids[:-1]
        if not fresh.all():  # a cell given twice counts as its mean
            once = np.flatnonzero(fresh)
            z, ids, new = np.add.reduceat(z, once) / np.diff(once, append=len(ids)), ids[once], new[once]
        of_part = ids >> PART_BITS
        block, at = block_of[of_part], (first[of_part] + (ids & ((1 << PART_BITS) - 1))).astype(np.int32)
        owner = np.cumsum(new)
        new[1:] |= block[1:] != block[:-1]
        starts = np.flatnonzero(new)
        lengths = np.diff(starts, append=len(ids))
        runs = {x: np.flatnonzero(block[starts] == x) for x in np.unique(block[starts])}
        owner = owner[starts]

        def packed(of: np.ndarray) -> list:
            n = lengths[of]
            where = np.repeat(starts[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            return [pa.array([v.tobytes()], pa.binary()) for v in (n.astype(np.int32), at[where], z[where])]

        for x, left in runs.items():
            for y, right in runs.items():
                if x == y:
                    own = left[lengths[left] > 1]
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array([pair_of(x, x)], pa.int32()), *packed(own), *[pa.nulls(1, pa.binary())] * 3, pa.nulls(1, pa.int32())], schema=sent)
                elif x < y:
                    _, i, j = np.intersect1d(owner[left], owner[right], assume_unique=True, return_indices=True)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array([pair_of(x, y)], pa.int32()), *packed(left[i]), *packed(right[j]), pa.nulls(1, pa.int32())], schema=sent)

    cell_type = "pair int, lengths_x binary, at_x binary, z_x binary, lengths_y binary, at_y binary, z_y binary, part int"
    dealt = cells.repartition(tasks, *by, sample).sortWithinPartitions(*by, sample, "_id").mapInArrow(deal, cell_type)
    # names of a part go to the pairs that its block is in
    name = F.struct(*by, F.col(feature).alias("_name"))
    whose = rows.sparkSession.createDataFrame([(p, int(x), pair_of(min(x, y), max(x, y))) for p, x in enumerate(block_of.tolist()) for y in range(blocks)],
                                              "part int, block int, pair int")
    names = index.groupBy(part.cast("int").alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_id", name.alias("name")))), lambda e: e["name"]).alias("names")).join(
        F.broadcast(whose), "part").select("pair", "part", "names")
    both = dealt.unionByName(names, allowMissingColumns=True)
    work = both.repartitionById(pairs, "pair")
    ends = [(x, y) for x in range(blocks) for y in range(x, blocks)]
    schema = StructType([*(rows.schema[c] for c in by), *(StructField(c, rows.schema[feature].dataType) for c in ("a", "b")),
                         StructField("n", LongType()), *(StructField(c, DoubleType()) for c in SUMS[1:])])

    def multiply(batches):
        held, named = [], {}
        for batch in batches:  # all of one pair
            for k in range(batch.num_rows):
                if batch.column("part")[k].is_valid:
                    named[batch.column("part")[k].as_py()] = batch.column("names")[k].values
                    continue
                pair = batch.column("pair")[k].as_py()
                held.append([np.frombuffer(batch.column(f"{name}_{side}")[k].as_buffer(), t) for side in ("x" if ends[pair][0] == ends[pair][1] else "xy")
                             for name, t in (("lengths", np.int32), ("at", np.int32), ("z", np.float64))])
        if not held:
            return
        x, y = ends[pair]
        lists = [np.concatenate(parts) for parts in zip(*held)]
        held.clear()
        named = {b: pa.concat_arrays([named[p] for p in sorted(named) if block_of[p] == b]) for b in {x, y}}
        for i, j, sums in met(lists[:3], lists[3:] or None, len(named[x]), len(named[y]), least_n):
            for start in range(0, len(i), OUT_ROWS):
                some = slice(start, start + OUT_ROWS)
                left, right = named[x].take(pa.array(i[some])), named[y].take(pa.array(j[some]))
                yield pa.RecordBatch.from_arrays(
                    [*(left.field(c) for c in by), left.field("_name"), right.field("_name"), *(pa.array(v[some]) for v in sums)], names=[*by, "a", "b", *SUMS])

    return work.mapInArrow(multiply, schema)


def met(left: list[np.ndarray], right: list[np.ndarray] | None, n_left: int, n_right: int, least_n: int):
    """``(i, j, sums)``, some features ``i`` at a time, of all pairs of features of two blocks (or of one, ``i < j``) that share ``least_n`` samples.

    A block comes as its samples' numbers of cells, and these cells' features in order and values.
    """
    lengths, at, z = left
    row = np.repeat(np.arange(len(lengths)), lengths)
    if right is None:
        _, at_y, z_y = left
        last = np.cumsum(lengths)[row]
        begin = np.arange(len(at)) + 1  # a cell meets those after it
    else:
        n_y, at_y, z_y = right
        last = np.cumsum(n_y)[row]
        begin = last - n_y[row]
    order = np.argsort(at, kind="stable")
    at, z, begin, n = at[order], z[order], begin[order], (last - begin)[order]
    ends = np.searchsorted(at, np.arange(n_left), side="right")
    upto = np.concatenate([[0], np.cumsum(n)])[ends]  # cells met by the features so far
    feature, cell = 0, 0
    while feature < n_left:
        most = np.searchsorted(upto, (upto[feature - 1] if feature else 0) + MET_CELLS, side="right")
        until = max(feature + 1, int(most))
        some = slice(cell, ends[until - 1])
        count = n[some]
        total = int(count.sum())
        if total:
            where = np.repeat(begin[some] - (np.cumsum(count) - count), count) + np.arange(total)
            j = at_y[where]
            low = int(j.min())
            width = int(j.max()) - low + 1
            key = np.repeat((at[some] - feature).astype(np.int64) * width, count) + (j - low)
            counters = (until - feature) * width
            if counters <= max(COUNTERS, 8 * total):
                counted = np.bincount(key, minlength=counters)
                enough = counted >= least_n
                kept = np.flatnonzero(enough)
                mine = np.flatnonzero(enough[key]) if len(kept) and least_n > 1 else slice(None)
                slot = (np.cumsum(enough) - 1)[key[mine]] if len(kept) else None
                counted = counted[kept]
            else:
                ordered = np.sort(key)
                runs = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                counted = np.diff(runs, append=total)
                kept, counted = ordered[runs[counted >= least_n]], counted[counted >= least_n]
                mine, slot = slice(None), np.searchsorted(kept, key) if len(kept) else None
                if len(kept) and least_n > 1:
                    mine = np.flatnonzero(kept[np.minimum(slot, len(kept) - 1)] == key)
                    slot = slot[mine]
            if len(kept):
                a, b = np.repeat(z[some], count)[mine], z_y[where[mine]]
                sums = [counted.astype(np.int64), *(np.bincount(slot, v, len(kept)) for v in (a, b, a * a, b * b, a * b))]
                yield kept // width + feature, kept % width + low, sums
        feature, cell = until, ends[until - 1]


def all_pair_correlations(rows: DataFrame, by: Sequence[str], sample: str, feature: str, value: str, least_n: int = 2, least_r: float | None = None,
                          block: int | None = None, chunk: int | None = None) -> DataFrame:
    """``(*by, a, b, r, n)`` of all pairs of features over the samples that have both; ``least_r`` keeps pairs with at least that |r|.

    A pair of which a side does not vary over the shared samples has no
    correlation and no row.
    """
    n = F.col("n")

    def spread(s: str, ss: str) -> Column:
        own = F.col(ss) - F.col(s) * F.col(s) / n
        return F.when(own > 1e-10 * F.col(ss), own)

    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))
    sums = pair_sums(rows, by, sample, feature, value, block, chunk, least_n=least_n)
    out = sums.select(*by, "a", "b", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r"), "n").filter(F.col("r").isNotNull())
    return out if least_r is None else out.filter(F.abs("r") >= least_r)


def tested_pairs(pairs: DataFrame) -> DataFrame:
    """Correlations with their two-sided p (t distribution) and strength word."""
    return pairs.withColumn("p_value", correlation_p(F.col("r"), F.col("n"))).withColumn("strength", correlation_strength(F.col("r")))


def extreme_pairs(pairs: DataFrame, by: Sequence[str], n: int = 3) -> DataFrame:
    """The ``n`` pairs of highest and of lowest correlation in each group: ``(*by, side, place, a, b, r, ...)``; equal ones by name."""
    keyed = pairs if by else pairs.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]
    # rounding keeps equal correlations equal whatever the order of the sums
    exact = F.round("r", 12)
    high = top_rows(keyed, keys, [exact.desc(), F.col("a"), F.col("b")], n).withColumn("side", F.lit("top"))
    low = top_rows(keyed, keys, [exact, F.col("a"), F.col("b")], n).withColumn("side", F.lit("bottom"))
    return high.unionByName(low).drop("_all")
