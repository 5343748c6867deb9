"""Positions, running sums, tie ranks and exact quantiles inside groups.

A window puts one whole group into one task.  Every function here first asks
how large the largest group is (one aggregation, one number back).  Below the
session's limit a plain window runs; above it the rows are range-partitioned on
(group, order), positions are taken inside each range slice, and the slice
totals, of which a group has at most one per partition, are added up.  Both
ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut, window_rows

SLICE = "_slice"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group; partial counts are combined map-side."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def fits_window(df: DataFrame, keys: Sequence[str]) -> bool:
    return largest_group(df, keys) <= window_rows(df.sparkSession)


def _match(left: str, right: str, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, str] | None = None,
    totals: Mapping[str, str | None] | None = None,
    mins: Mapping[str, str] | None = None,
    position: str = "position",
    small: bool | None = None,
) -> DataFrame:
    """Add the 1-based position in the group's order, running sums and minima,
    and totals.

    ``sums`` (``mins``) maps a new column to the column it accumulates,
    ``totals`` a new column to the column summed over the whole group (``None``
    counts rows).
    ``order`` must be total inside a group (end it with a unique key).
    ``small`` skips the size question when the caller has answered it.
    """
    sums, totals, mins = dict(sums or {}), dict(totals or {}), dict(mins or {})
    if small is None:
        small = fits_window(df, keys)

    def whole(source: str | None) -> Column:
        return F.count(F.lit(1)) if source is None else F.sum(source)

    if small:
        group = Window.partitionBy(*keys)
        upto = group.orderBy(*order)
        rows = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns(
            {
                position: F.row_number().over(upto).cast("long"),
                **{name: F.sum(source).over(rows) for name, source in sums.items()},
                **{name: F.min(source).over(rows) for name, source in mins.items()},
                **{name: whole(source).over(group) for name, source in totals.items()},
            }
        )

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn(
            SLICE, F.spark_partition_id()
        )
    )
    local = Window.partitionBy(*keys, SLICE).orderBy(*order)
    rows = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.withColumns(
        {
            "_at": F.row_number().over(local).cast("long"),
            **{f"_{name}": F.sum(source).over(rows) for name, source in sums.items()},
            **{f"_{name}": F.min(source).over(rows) for name, source in mins.items()},
        }
    )
    slices = placed.groupBy(*keys, SLICE).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(source).alias(f"_{name}_part") for name, source in sums.items()],
        *[F.min(source).alias(f"_{name}_part") for name, source in mins.items()],
        *[whole(source).alias(f"_{name}_part") for name, source in totals.items()],
    )
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        *keys,
        SLICE,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        *[
            F.coalesce(F.sum(f"_{name}_part").over(earlier), F.lit(0)).alias(f"_{name}_before")
            for name in sums
        ],
        *[F.min(f"_{name}_part").over(earlier).alias(f"_{name}_before") for name in mins],
        *[F.sum(f"_{name}_part").over(group).alias(name) for name in totals],
    )
    joined = inside.alias("l").join(offsets.alias("r"), _match("l", "r", [*keys, SLICE]))
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("_at") + F.col("_rows_before")).alias(position),
        *[(F.col(f"_{name}") + F.col(f"_{name}_before")).alias(name) for name in sums],
        *[F.least(f"_{name}", f"_{name}_before").alias(name) for name in mins],
        *[F.col(f"r.{name}") for name in totals],
    )


def with_group_size(df: DataFrame, keys: Sequence[str], name: str = "group_rows") -> DataFrame:
    """Attach each group's row count by a join, so no group meets in one task."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return df.join(sizes, list(keys))


def tied_positions(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tiebreak: Sequence[str] = (),
    descending: bool = False,
    small: bool | None = None,
) -> DataFrame:
    """Add ``position`` (if there is a ``tiebreak``), ``tie_first``, ``tie_last``
    and ``group_rows``: where a row stands in its group's order of ``value``,
    and where the rows of the same value begin and end.

    Rows without a value are left out.  One ordering gives all of them: inside
    a group a rank and a running count share its sort, and where a group is
    cut into slices, ties are carried over their edges, of which a slice has two.
    """
    present = df.filter(F.col(value).isNotNull())
    if small is None:
        small = fits_window(present, keys)
    by = F.col(value).desc() if descending else F.col(value).asc()

    def marks(*group: str) -> dict[str, Column]:
        within = Window.partitionBy(*group)
        peers = within.orderBy(by)
        upto = peers.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        own = {"position": F.row_number().over(within.orderBy(by, *tiebreak)).cast("long")} if tiebreak else {}
        return own | {
            "tie_first": F.rank().over(peers).cast("long"),
            "tie_last": F.count(F.lit(1)).over(upto),
            "group_rows": F.count(F.lit(1)).over(within),
        }

    if small:
        return present.withColumns(marks(*keys))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # without a tiebreak equal values are spread by the rest of their row
    spread = list(tiebreak) or [F.xxhash64(*df.columns)]
    placed = cut(
        present.repartitionByRange(parts, *[F.col(k) for k in keys], by, *spread).withColumn(SLICE, F.spark_partition_id())
    )
    inside = cut(placed.withColumns(marks(*keys, SLICE)))
    slices = inside.groupBy(*keys, SLICE).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by(value, "tie_first").alias("_head"), F.max(F.when(F.col("tie_first") == 1, F.col("tie_last"))).alias("_head_rows"),
        F.max_by(value, "tie_first").alias("_tail"), F.max("tie_first").alias("_tail_at"),
    )
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    ends = slices.select(
        *keys, "_before", F.inline(F.array(
            F.struct(F.col("_head").alias("_value"), F.lit(1).cast("long").alias("_at"), F.col("_head_rows").alias("_n")),
            # a slice of one value has no tail of its own
            F.struct(F.when(F.col("_tail_at") > 1, F.col("_tail")).alias("_value"), F.col("_tail_at").alias("_at"),
                     (F.col("_rows") - F.col("_tail_at") + 1).alias("_n")))))
    ties = ends.filter("_value IS NOT NULL").groupBy(*keys, "_value").agg(
        F.min(F.col("_before") + F.col("_at")).alias("_first"), F.sum("_n").alias("_ties"))
    totals = slices.groupBy(*keys).agg(F.sum("_rows").alias("_all"))

    def tie_of(end: str) -> DataFrame:
        return ties.select(*keys, F.col("_value").alias(end), F.col("_first").alias(f"{end}_first"), (F.col("_first") + F.col("_ties") - 1).alias(f"{end}_last"))

    edges = slices.select(*keys, SLICE, "_before", "_head", "_tail")
    for side, on in ((tie_of("_head"), "_head"), (tie_of("_tail"), "_tail"), (totals, None)):
        condition = _match("l", "r", [*keys, *([on] if on else [])])
        edges = edges.alias("l").join(side.alias("r"), condition).select(
            "l.*", *[F.col(f"r.{c}") for c in side.columns if c not in (*keys, on)])
    joined = inside.alias("l").join(edges.alias("r"), _match("l", "r", [*keys, SLICE]))

    def carried(name: str) -> Column:
        at = F.col(f"l.{value}")
        end = "first" if name == "tie_first" else "last"
        return F.when(at == F.col("r._head"), F.col(f"r._head_{end}")).when(
            at == F.col("r._tail"), F.col(f"r._tail_{end}")).otherwise(F.col(f"l.{name}") + F.col("r._before"))

    own = [(F.col("l.position") + F.col("r._before")).alias("position")] if tiebreak else []
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns], *own, carried("tie_first").alias("tie_first"),
        carried("tie_last").alias("tie_last"), F.col("r._all").alias("group_rows"))


def tie_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str = "rank",
    descending: bool = False,
    method: str = "average",
    small: bool | None = None,
) -> DataFrame:
    """Rank of ``value`` in its group (null values are left out); equal values
    share their average rank, or with ``method="min"`` their first."""
    placed = tied_positions(df, keys, value, descending=descending, small=small)
    rank = (F.col("tie_first") + F.col("tie_last")) / F.lit(2.0) if method == "average" else F.col("tie_first")
    return placed.withColumn(name, rank).drop("tie_first", "tie_last", "group_rows")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group."""
    present = df.filter(F.col(value).isNotNull()).select(*keys, value)
    if fits_window(present, keys):
        asked = F.array(*[F.lit(float(p)) for p in probs.values()])
        both = present.groupBy(*keys).agg(F.percentile(value, asked).alias("_q"))
        return both.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
    counts = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    placed = running(counts, keys, [F.col(value)], {"_upto": "_ties"}, small=False)
    totals = counts.groupBy(*keys).agg(F.sum("_ties").alias("_n"))
    rows = placed.join(totals, list(keys))
    parts = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value)))
        share = F.max(at - F.floor(at))
        parts.append((low + (high - low) * share).alias(name))
    return rows.groupBy(*keys).agg(*parts)


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "place"
) -> DataFrame:
    """First ``n`` rows of each group.

    Spark keeps only ``n`` candidates per group in every map task before the
    shuffle, so a hot group costs ``n`` rows per task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place).filter(F.col(name) <= n)
