"""Sums of signs against all pairs, in slices of every size, and on a long series."""

import random

import numpy as np
import pytest

from tallyloom.operators import statistics as st
from tallyloom.operators import trend as tr


def brute(times, values, weights):
    return sum(w * x * int(np.sign(v - u)) for t, u, w in zip(times, values, weights) for s, v, x in zip(times, values, weights) if t < s)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 129])
def test_merging(n):
    rng = np.random.default_rng(n)
    values, weights = rng.integers(0, 12, n).astype(float), rng.integers(1, 4, n)
    assert tr.ordered_signs(values, weights) == brute(range(n), values, weights)
    if n:
        times = rng.integers(0, 9, n)
        assert tr.timed_signs(times, values, weights) == brute(times, values, weights)


@pytest.mark.parametrize("slice_rows", [4, 16, 1000])
def test_slices(spark, slice_rows):
    rng = random.Random(3)
    rows = [(k, t, float(rng.choice([1, 1, 1, 2, 5]) if k == "tied" else rng.random() + t * (k == "up") / 50), 1)
            for k, n in (("tied", 120), ("up", 90), ("free", 101), ("one", 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t long, v double, w long")
    got = {r.k: r.s for r in tr.sign_sums(df, ["k"], slice_rows).collect()}
    assert got == {k: brute(*zip(*[(t, v, w) for h, t, v, w in rows if h == k])) for k in got} and set(got) == {"tied", "up", "free", "one"}


def test_a_long_series(spark):
    n = 120_000
    df = spark.range(n).selectExpr("'x' AS k", "id AS i", "CAST((id * 7919) % 1009 + id / 200 AS DOUBLE) AS mean")
    values = np.array([r.mean for r in df.orderBy("i").collect()])
    whole = tr.ordered_signs(values, np.ones(n))
    row = st.mann_kendall(df, ["k"], slice_rows=10_000).first()
    assert row.n == n and row.s == whole
    assert row.z == pytest.approx((whole - 1) / np.sqrt(n * (n - 1) * (2 * n + 5) / 18))


def test_ties_and_short_series(spark):
    rows = [("a", i, v) for i, v in enumerate([1.0, 1.0, 2.0, 2.0, 2.0, 3.0])] + [("b", 0, 1.0), ("b", 1, 2.0)] + [("c", i, 4.0) for i in range(5)] + [("d", 0, None)]
    df = spark.createDataFrame(rows, "k string, i long, mean double")
    got = {r.k: r for r in st.mann_kendall(df, ["k"], ties=True).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].s == 11 and got["c"].z == 0.0 and got["b"].z == 0.0
    spread = (6 * 5 * 17 - (2 * 1 * 9 + 3 * 2 * 11)) / 18
    assert got["a"].z == pytest.approx(10 / spread ** 0.5)
    plain = {r.k: r.z for r in st.mann_kendall(df, ["k"]).collect()}
    assert plain["a"] == pytest.approx(10 / (6 * 5 * 17 / 18) ** 0.5)
