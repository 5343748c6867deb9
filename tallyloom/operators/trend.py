"""Sums of signs over all pairs of a series, without pairs.

The sum of ``sign(v_j - v_i)`` over all times ``t_i < t_j`` is counted like
inversions.  A long series is cut into slices of time and bands of value, both
of bounded size.  Pairs inside a slice, and pairs of a band from different
slices, are counted by merging sorted halves in one task each; what is left,
pairs of different slices and bands, is the same question about the counts by
(slice, band), which are far fewer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyloom.operators.ordering import largest_group, tied_positions
from tallyloom.session import cut

#: Rows of a slice or band, and rows that a whole series may have to be merged at once; at least twice the root of the longest series.
SLICE_ROWS = 1 << 16


def ordered_signs(values: np.ndarray, weights: np.ndarray) -> int:
    """Sum over i < j of sign(values[j] - values[i]) * weights[i] * weights[j], by merging sorted halves from the bottom up."""
    n = len(values)
    if n < 2:
        return 0
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    weights = weights.astype(np.int64)
    total, width, top = 0, 1, int(ranks.max()) + 1
    place = np.arange(n)
    while width < n:
        half = place // width
        keys = (half // 2) * top + ranks  # pairs of halves side by side
        order = np.argsort(keys, kind="stable")
        left = order[half[order] % 2 == 0]
        right = order[half[order] % 2 == 1]
        upto = np.concatenate([[0], np.cumsum(weights[left])])
        begin, end = (np.searchsorted(keys[left], (half[right] // 2 + k) * top, "left") for k in (0, 1))
        less, equal = (np.searchsorted(keys[left], keys[right], side) for side in ("left", "right"))
        total += int((weights[right] * ((upto[less] - upto[begin]) - (upto[end] - upto[equal]))).sum())
        width *= 2
    return total


def timed_signs(times: np.ndarray, values: np.ndarray, weights: np.ndarray) -> int:
    """The same over pairs of different times, rows in any order."""
    order = np.lexsort((-values, times))
    times, values, weights = times[order], values[order], weights[order].astype(np.int64)
    total = ordered_signs(values, weights)
    # rows of one time came by falling value: each unequal pair of them has counted as minus one
    starts = np.flatnonzero(np.concatenate([[True], times[1:] != times[:-1]]))
    runs = np.flatnonzero(np.concatenate([[True], (times[1:] != times[:-1]) | (values[1:] != values[:-1])]))
    squares = lambda at: int((np.add.reduceat(weights, at) ** 2).sum())
    return total + (squares(starts) - squares(runs)) // 2


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """One table for each run of equal values in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            column = batch.column(k)
            change[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(change).tolist()]
        first = [batch.column(k)[0].as_py() for k in range(keys)]
        if held and first != [held[-1].column(k)[-1].as_py() for k in range(keys)]:
            yield pa.Table.from_batches(held)
            held = []
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            held.append(batch.slice(start, end - start))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def merged(points: DataFrame, keys: Sequence[str], inside: Sequence[str]) -> DataFrame:
    """``(*keys, s)``: sums of signs of ``points (*keys, *inside, t, v, w)`` by (keys, inside), each group in one task."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = [*keys, *inside]
    work = points.select(*group, "t", "v", "w").repartition(parts, *group).sortWithinPartitions(*group)
    schema = StructType([*(points.schema[k] for k in keys), StructField("s", LongType())])
    n = len(keys)

    def count(batches):
        for table in groups(batches, len(group)):
            s = timed_signs(*(table.column(c).to_numpy() for c in ("t", "v", "w")))
            yield pa.RecordBatch.from_arrays([*(table.column(k).slice(0, 1).combine_chunks() for k in range(n)), pa.array([s], pa.int64())],
                                             names=[*schema.names])

    return work.mapInArrow(count, schema)


def sign_sums(points: DataFrame, keys: Sequence[str], slice_rows: int | None = None) -> DataFrame:
    """``(*keys, s long)`` of ``points (*keys, t, v, w long)``: the sum over t_i < t_j of w_i * w_j * sign(v_j - v_i).

    Rows of one time are not compared.  Keys must not be null.
    """
    slice_rows = slice_rows or SLICE_ROWS
    parts = []
    while (largest := largest_group(points, keys)) > slice_rows:
        slice_rows = max(slice_rows, 2 * math.isqrt(largest))  # so that slices times bands are fewer than rows
        by_time = tied_positions(points, keys, "t").withColumn("slice", F.floor((F.col("tie_first") - 1) / slice_rows)).drop(
            "tie_first", "tie_last", "group_rows")
        placed = cut(tied_positions(by_time, keys, "v").withColumn("band", F.floor((F.col("tie_first") - 1) / slice_rows)).select(
            *keys, "slice", "band", "t", "v", "w"))
        parts.append(merged(placed, keys, ["slice"]))
        # a value that fills its band is one row for each slice
        bands = placed.groupBy(*keys, "band", F.col("slice").alias("t"), "v").agg(F.sum("w").alias("w"))
        parts.append(merged(bands, keys, ["band"]))
        points = cut(placed.groupBy(*keys, F.col("slice").alias("t"), F.col("band").alias("v")).agg(F.sum("w").alias("w")))
    parts.append(merged(points, keys, []))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*keys).agg(F.sum("s").alias("s"))
