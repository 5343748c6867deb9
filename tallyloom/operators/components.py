"""Principal components of a long table, over the shorter of its two sides.

Values are standardised per feature (population sd; a missing value counts as
the mean).  The products of the shorter side, samples with samples or features
with features, are summed block by block on the executors.  Only that matrix,
at most ``GRAM_SIDE`` numbers wide, comes to the driver for its eigenvectors;
the other side follows from them by one aggregation.  Where both sides are
longer, the leading components are found by orthogonal iteration instead: cells
stay where they were written, packed by the longer side, and a round only moves
some vectors over the shorter side, which the driver holds up to ``HELD`` numbers.
Beyond that both sides are tables, and only k x k numbers come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.correlation import pair_sums
from tallyloom.operators.joins import small_side
from tallyloom.operators.ordering import running, top_rows
from tallyloom.session import cut

#: Rows and columns of the matrix that the driver may hold (2048 x 2048 numbers are 32 MB).
GRAM_SIDE = 2048
#: Numbers in the vectors over the shorter side that the driver may hold in an iteration; as many as in that matrix.
HELD = GRAM_SIDE ** 2
#: Rows of sums that a task hands over at once.
OUT_ROWS = 65_536
#: Rounds of the orthogonal iteration, and components carried beyond those asked for.
ROUNDS, SPARE = 30, 6


@dataclass
class Components:
    """A fitted PCA: tables only, so it serves any later plan."""

    #: ``(feature, mean, sd)`` of the features that vary.
    scaling: DataFrame
    #: ``(feature, component, loading)``.
    loadings: DataFrame
    #: ``(component, variance, share, cumulative)``; ``variance`` is of standardised values, all of them sum to the number of varying features.
    variance: DataFrame
    sample: str
    feature: str
    value: str

    def transform(self, values: DataFrame) -> DataFrame:
        """``(sample, component, score)`` of old or new samples."""
        scaled = scaled_cells(values, self.scaling, self.feature, self.value)
        return scaled.join(self.loadings, self.feature).groupBy(self.sample, "component").agg(F.sum(F.col("_z") * F.col("loading")).alias("score"))


def scaled_cells(values: DataFrame, scaling: DataFrame, feature: str, value: str) -> DataFrame:
    present = values.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return present.join(scaling, feature).withColumn("_z", (F.col(value) - F.col("mean")) / F.col("sd"))


def standard(values: DataFrame, sample: str, feature: str, value: str) -> tuple[int, int, DataFrame, DataFrame]:
    """How many samples there are, how many features vary, ``(feature, mean, sd)`` of these and their cells ``(sample, feature, _z)``."""
    present = cut(values.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(sample, feature, value))
    n = present.select(sample).distinct().count()
    # a missing cell counts as its feature's mean, which is that of the cells there are; the sd is over all samples
    moments = present.groupBy(feature).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    scaling = cut(moments.withColumn("sd", F.sqrt(F.col("_v") * F.col("_n") / max(n, 1))).filter("sd > 0").select(feature, "mean", "sd"))
    p = scaling.count()
    if not p:
        raise ValueError("no feature varies")
    cells = cut(scaled_cells(present, scaling, feature, value).select(sample, feature, "_z"))
    return n, p, scaling, cells


def fit(values: DataFrame, sample: str, feature: str, value: str, k: int | None = None, gram_side: int = GRAM_SIDE) -> Components:
    """Principal components of ``values (sample, feature, value)``; the first ``k``, or all that vary.

    A component's sign is free; here its largest entry on the shorter side is
    positive.  ``k`` is needed where both sides are longer than ``gram_side``.
    """
    n, p, scaling, cells = standard(values, sample, feature, value)
    if min(n, p) <= gram_side:
        own, other = (sample, feature) if n <= p else (feature, sample)
        values_of, vectors = gram_eigenvectors(cells, own, other, n)
    elif k is None:
        raise ValueError(f"{n} samples and {p} features: say how many components")
    else:
        own, other = feature, sample
        step = held_iteration if min(n, p) * (k + SPARE) <= HELD else iterated
        values_of, vectors = step(cells, sample, feature, n, k)
    take = len(values_of) if k is None else min(k, len(values_of))
    parts = [float(v) for v in values_of[:take]]
    spark = values.sparkSession
    total = np.cumsum(parts)
    variance = spark.createDataFrame([(c + 1, v, v / p, float(t) / p) for c, (v, t) in enumerate(zip(parts, total))],
                                     "component int, variance double, share double, cumulative double")
    chosen = vectors.filter(F.col("component") <= take)
    if own == feature:
        loadings = chosen.withColumnRenamed("entry", "loading")
    else:  # of unit length: the samples' vector times the values, over the root of its eigenvalue
        scaled = variance.select("component", (1 / F.sqrt(F.col("variance") * n)).alias("_by"))
        loadings = cells.join(small_side(chosen), sample).groupBy(feature, "component").agg(F.sum(F.col("_z") * F.col("entry")).alias("loading")) \
            .join(F.broadcast(scaled), "component").select(feature, "component", (F.col("loading") * F.col("_by")).alias("loading"))
    return Components(scaling, cut(loadings.select(feature, "component", "loading")), variance, sample, feature, value)


def spectrum_sums(values: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    """One row ``(columns, total, squares)``: features that vary, and the sums of all variances and of their squares.

    They are sums over the products of the shorter side, which stay distributed: no eigenvectors, so no limit of size.
    """
    # a feature's cells are brought to length 1 where they meet; the number of samples, which their sd depends on, cancels out
    own_cells = Window.partitionBy(feature)
    length = F.sqrt(F.var_pop(value).over(own_cells) * F.count(F.lit(1)).over(own_cells))
    cells = cut(values.filter(F.col(value).isNotNull() & ~F.isnan(value)).withColumns({"_m": F.avg(value).over(own_cells), "_l": length}).filter("_l > 0").select(
        sample, feature, ((F.col(value) - F.col("_m")) / F.col("_l")).alias("_z")))
    n, p = (cells.select(c).distinct().count() for c in (sample, feature))
    if not p:
        raise ValueError("no feature varies")
    own, other = (sample, feature) if n <= p else (feature, sample)
    lengths = cells.groupBy(own).agg(F.sum(F.col("_z") * F.col("_z")).alias("s"))
    alone = lengths.agg(F.sum("s").alias("_total"), F.sum(F.col("s") * F.col("s")).alias("_own"))
    both = pair_sums(cells, [], other, own, "_z", raw=True).agg(F.coalesce(F.sum(F.col("sxy") * F.col("sxy")), F.lit(0.0)).alias("_both"))
    return alone.join(F.broadcast(both)).select(  # one row each
        F.lit(p).cast("long").alias("columns"), F.col("_total").alias("total"), (F.col("_own") + 2 * F.col("_both")).alias("squares"))


def gram_eigenvectors(cells: DataFrame, own: str, other: str, n: int) -> tuple[np.ndarray, DataFrame]:
    """Eigenvalues (of the covariance of standardised values) and ``(own, component, entry)`` of the products of ``own`` with ``own``."""
    sums = pair_sums(cells, [], other, own, "_z", raw=True).select("a", "b", "sxy").toArrow()
    squares = cells.groupBy(own).agg(F.sum(F.col("_z") * F.col("_z")).alias("s")).toArrow()
    names = squares.column(own).to_pylist()
    at = {name: i for i, name in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    gram[np.diag_indices(len(names))] = squares.column("s").to_numpy()
    i, j = (np.array([at[v] for v in sums.column(c).to_pylist()], int) for c in ("a", "b"))
    gram[i, j] = gram[j, i] = sums.column("sxy").to_numpy()
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0) / n, vectors[:, order]
    vary = values > 1e-10 * values[0]
    values, vectors = values[vary], vectors[:, vary]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    table = cells.sparkSession.createDataFrame(
        [(name, c + 1, float(v)) for name, row in zip(names, vectors) for c, v in enumerate(row)],
        f"`{own}` {cells.schema[own].dataType.simpleString()}, component int, entry double")
    return values, cut(table)


def start_of(feature, c: int):
    """A number from -1 to 1 that depends on the feature alone."""
    return F.pmod(F.xxhash64(feature, F.lit(c)), F.lit(2_000_003)) / 1_000_001.5 - 1


def starting(feature: str, m: int) -> list:
    return [start_of(feature, c).alias(f"_c{c}") for c in range(m)]


def blocked(batches):
    """Rows ``(key, cells)`` as blocks of binaries, which cost nothing to hand to Python again."""
    for batch in batches:
        if batch.num_rows:
            cells = batch.column(1)
            lengths = cells.value_lengths().to_numpy().astype(np.int32)
            at, z = (part.to_numpy() for part in cells.flatten().flatten())
            keys = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([v.tobytes()], pa.binary()) for v in (lengths, at.astype(np.int32), z.astype(np.float64)))],
                                             names=["keys", "lengths", "at", "z"])


def blocks_of(batch: pa.RecordBatch):
    """Row number of each block; where its keys' cells begin, how many they are, and of all cells their place on the shorter side and their value."""
    for i in range(batch.num_rows):
        lengths, at, z = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("lengths", np.int32), ("at", np.int32), ("z", np.float64)))
        yield i, np.cumsum(lengths) - lengths, lengths, at, z


def held_iteration(cells: DataFrame, sample: str, feature: str, n: int, k: int) -> tuple[np.ndarray, DataFrame]:
    """The ``k`` leading components of the features, by orthogonal iteration over cells that are not moved.

    A block has all cells of some keys of the longer side, so a task multiplies it both ways at once; it is sent
    the vectors over the shorter side and hands over one sum for each of their entries that it has cells of.
    """
    spark, m = cells.sparkSession, k + SPARE
    columns = [f"_c{c}" for c in range(m)]
    sizes = {side: cells.select(side).distinct().count() for side in (sample, feature)}
    short, long = (sample, feature) if sizes[sample] <= sizes[feature] else (feature, sample)
    size = sizes[short]
    keys = cells.select(short).distinct().withColumn("_all", F.lit(0))
    index = cut(running(keys, ["_all"], [F.col(short)], position="_at").select(short, (F.col("_at") - 1).cast("int").alias("at")))
    by_key = cells.join(small_side(index), short).groupBy(long).agg(F.collect_list(F.struct("at", F.col("_z").alias("z"))).alias("cells"))
    key_type = cells.schema[long].dataType.simpleString()
    packed = cut(by_key.mapInArrow(blocked, f"keys array<{key_type}>, lengths binary, at binary, z binary"))
    # every task hands over up to ``size`` rows a round, so there are as many tasks as cores, however large the table
    packed = packed.coalesce(max(spark.sparkContext.defaultParallelism, 1))
    summed = "at int, " + ", ".join(f"{c} double" for c in columns)

    def collected(parts: DataFrame) -> np.ndarray:
        rows = parts.toArrow()
        out = np.zeros((size, m))
        out[rows.column("at").to_numpy()] = np.column_stack([rows.column(c).to_numpy() for c in columns])
        return out

    def multiplied(vectors: np.ndarray | None) -> np.ndarray:
        """The products of the shorter side with itself times ``vectors``; without them, its products with the longer side's start."""
        sent = None if vectors is None else spark.sparkContext.broadcast(np.ascontiguousarray(vectors.T))

        def multiply(batches):
            own_of = None if sent is None else sent.value  # once a task: every look at it costs
            total, seen = np.zeros((m, size)), np.zeros(size, bool)
            for batch in batches:
                for i, starts, lengths, at, z in blocks_of(batch):
                    seen[at] = True
                    row = np.repeat(np.arange(len(lengths)), lengths)
                    for c in range(m):
                        own = batch.column(columns[c])[i].values.to_numpy() if own_of is None else np.add.reduceat(z * own_of[c][at], starts)
                        total[c] += np.bincount(at, z * own[row], size)
            there = np.flatnonzero(seen)
            for start in range(0, len(there), OUT_ROWS):
                rows = there[start:start + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(t[rows]) for t in total)], names=["at", *columns])

        first = [F.transform("keys", lambda key: start_of(key, c)).alias(columns[c]) for c in range(m)] if sent is None else []
        rows = packed.select("lengths", "at", "z", *first)
        out = collected(rows.mapInArrow(multiply, summed).groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]))
        if sent is not None:
            sent.destroy()
        return out

    basis = multiplied(None) if short == sample else collected(index.select("at", *starting(feature, m)))
    before = None
    for turn in range(ROUNDS):
        basis = np.linalg.qr(basis)[0]
        image = multiplied(basis)
        products = basis.T @ image
        by = np.eye(products.shape[0])
        if short == sample:  # the features' vectors are those of the samples times the cells, and have these products
            lengths, turned = np.linalg.eigh((products + products.T) / 2)
            wide = lengths > 1e-12 * lengths[-1]
            by = turned[:, wide] / np.sqrt(lengths[wide])
            products = by.T @ (image.T @ image) @ by
        values, vectors = np.linalg.eigh((products + products.T) / 2 / n)
        order = np.argsort(-values)[:k]
        values, by = values[order], by @ vectors[:, order]
        if turn == ROUNDS - 1 or before is not None and np.allclose(values, before, rtol=1e-10):
            break
        before, basis = values, image
    final = basis @ by
    if short == feature:
        names = index.orderBy("at").toArrow().column(feature)
        entries = spark.createDataFrame(pa.table([names, *(pa.array(v) for v in final.T)], names=[feature, *columns[:len(values)]]))
        parts = F.inline(F.array(*[F.struct(F.lit(c + 1).alias("component"), F.col(f"_c{c}").alias("entry")) for c in range(len(values))]))
        return values, cut(entries.select(feature, parts))
    sent, take = spark.sparkContext.broadcast(np.ascontiguousarray(final.T)), len(values)

    def project(batches):
        own_of = sent.value
        for batch in batches:
            for i, starts, _, at, z in blocks_of(batch):
                for c in range(take):
                    yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values, pa.array(np.full(len(starts), c + 1, np.int32)),
                                                      pa.array(np.add.reduceat(z * own_of[c][at], starts))], names=[feature, "component", "entry"])

    return values, cut(packed.mapInArrow(project, f"`{feature}` {key_type}, component int, entry double"))


def iterated(cells: DataFrame, sample: str, feature: str, n: int, k: int) -> tuple[np.ndarray, DataFrame]:
    """The same for the ``k`` leading components of the features, by orthogonal iteration with both sides distributed."""
    m = k + SPARE
    columns = [f"_c{c}" for c in range(m)]
    basis = cut(cells.select(feature).distinct().select(feature, *starting(feature, m)))

    def products(table: DataFrame) -> np.ndarray:
        pairs = [(a, b) for a in range(m) for b in range(a, m)]
        row = table.agg(*[F.sum(F.col(columns[a]) * F.col(columns[b])) for a, b in pairs]).first()
        out = np.zeros((m, m))
        for (a, b), v in zip(pairs, row):
            out[a, b] = out[b, a] = v
        return out

    def turned(table: DataFrame, by: np.ndarray) -> DataFrame:
        return table.select(feature, *[sum((F.col(columns[a]) * float(by[a, b]) for a in range(m)), F.lit(0.0)).alias(columns[b]) for b in range(m)])

    def orthonormal(table: DataFrame) -> DataFrame:
        for _ in range(2):  # the second round removes what rounding left
            values, vectors = np.linalg.eigh(products(table))
            table = turned(table, vectors / np.sqrt(np.maximum(values, 1e-300)))
        return table

    summed = lambda by: [F.sum(F.col("_z") * F.col(c)).alias(c) for c in by]
    values, before = None, None
    basis = cut(orthonormal(basis))
    for turn in range(ROUNDS):
        scores = cut(cells.join(basis, feature).groupBy(sample).agg(*summed(columns)))
        small = products(scores) / n  # the covariance within the basis
        values, vectors = np.linalg.eigh(small)
        order = np.argsort(-values)
        values, vectors = values[order], vectors[:, order]
        if turn == ROUNDS - 1 or before is not None and np.allclose(values[:k], before[:k], rtol=1e-10):
            break
        before = values
        image = cut(cells.join(scores, sample).groupBy(feature).agg(*summed(columns)))
        basis = cut(orthonormal(image))
    final = turned(basis, vectors)
    entries = F.inline(F.array(*[F.struct(F.lit(c + 1).alias("component"), F.col(columns[c]).alias("entry")) for c in range(k)]))
    return values[:k], cut(final.select(feature, entries))


def top_loadings(model: Components, n: int, component: int = 1) -> DataFrame:
    """``(feature, loading, strength, place)``: the features with the largest absolute loadings on a component."""
    own = model.loadings.filter(F.col("component") == component).withColumn("strength", F.abs("loading"))
    # rounding keeps equal strengths equal whatever the order of the sums
    return top_rows(own, ["component"], [F.round("strength", 9).desc(), F.col(model.feature)], n).select(model.feature, "loading", "strength", "place")


def membership_profile(features: DataFrame, sets: DataFrame, feature: str, set_id: str = "set_id") -> DataFrame:
    """``(set_id, members, chosen, share, expected, enrichment)``: how many of the chosen ``features`` each set holds,
    and how that compares with the share of the set among all features that are in a set."""
    member = sets.select(set_id, F.col("feature").alias(feature)).distinct()
    picked = features.select(feature).distinct()
    known = member.select(feature).distinct().count()
    n = picked.join(member.select(feature).distinct(), feature, "left_semi").count()
    sizes = member.groupBy(set_id).agg(F.count(F.lit(1)).alias("members"))
    held = member.join(small_side(picked), feature).groupBy(set_id).agg(F.count(F.lit(1)).alias("chosen"))
    expected = F.col("members") * F.lit(n / max(known, 1))
    return sizes.join(held, set_id, "left").fillna(0, ["chosen"]).withColumns({
        "share": F.col("chosen") / F.lit(max(n, 1)), "expected": expected,
        "enrichment": F.when(expected > 0, F.col("chosen") / expected)})


def components_needed(variance: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """``(threshold, needed)``: the fewest components whose shares add up to each threshold."""
    needed = [F.struct(F.lit(t).alias("threshold"), F.min(F.when(F.round("cumulative", 12) >= t, F.col("component"))).alias("needed"))
              for t in thresholds]
    return variance.agg(F.array(*needed).alias("_n")).select(F.inline("_n"))
