"""Blocked correlations against numpy, with missing cells."""

import random

import numpy as np
import pytest

from tallyloom.operators import correlation as co
from tallyloom.operators import statistics as st


def cells(samples, features, missing, seed):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(samples)] for _ in range(4)]
    rows = []
    for f in range(features):
        for s in range(samples):
            value = 7.0 if f == 3 else 1000 + base[f % 4][s] + rng.gauss(0, 1 + f % 3)
            rows.append(("d", f"s{s:03d}", f"f{f:03d}", None if rng.random() < missing else value))
    return rows


def expected(rows):
    table = {}
    for _, s, f, v in rows:
        if v is not None:
            table.setdefault(f, {})[s] = v
    out = {}
    names = sorted(table)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            both = sorted(set(table[a]) & set(table[b]))
            x, y = (np.array([table[k][s] for s in both]) for k in (a, b))
            if len(both) > 1 and x.std() > 0 and y.std() > 0:
                out[a, b] = (np.corrcoef(x, y)[0, 1], len(both))
    return out


@pytest.mark.parametrize("block,chunk,missing", [(128, 2048, 0.0), (7, 11, 0.2), (5, 64, 0.9)])
def test_every_pair(spark, block, chunk, missing):
    rows = cells(40, 23, missing, 1)
    df = spark.createDataFrame(rows, "dataset string, sample string, feature string, value double")
    got = {(r.a, r.b): (r.r, r.n) for r in co.all_pair_correlations(df, ["dataset"], "sample", "feature", "value", block=block, chunk=chunk).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for key, (r, n) in want.items():
        assert got[key][1] == n and got[key][0] == pytest.approx(r, abs=1e-9)


def test_many_features_go_block_by_block(spark):
    rows = cells(6, 520, 0.05, 2)
    df = spark.createDataFrame(rows, "dataset string, sample string, feature string, value double")
    names = sorted({r[2] for r in rows})
    got = {(r.a, r.b): r.r for r in st.pair_correlations(df, [], "sample", "feature", "value", names).collect()}
    want = expected(rows)
    assert set(got) == set(want) and max(abs(got[k] - want[k][0]) for k in want) < 1e-8


def test_both_ways_agree(spark):
    df = spark.createDataFrame(cells(30, 8, 0.1, 3), "dataset string, sample string, feature string, value double")
    named = {(r.a, r.b): (round(r.r, 9), r.n) for r in st.pair_correlations(df, [], "sample", "feature", "value", [f"f{k:03d}" for k in range(8)]).collect()}
    every = {(r.a, r.b): (round(r.r, 9), r.n) for r in st.pair_correlations(df, [], "sample", "feature", "value").collect()}
    assert named == every and len(named) == 21


def test_extremes_and_tests(spark):
    pairs = spark.createDataFrame([("x", f"a{i}", "b", i / 10 - 0.5, 12) for i in range(11)], "g string, a string, b string, r double, n long")
    got = [(r.side, r.place, r.a) for r in co.extreme_pairs(pairs, ["g"]).orderBy("side", "place").collect()]
    assert got == [("bottom", 1, "a0"), ("bottom", 2, "a1"), ("bottom", 3, "a2"), ("top", 1, "a10"), ("top", 2, "a9"), ("top", 3, "a8")]
    tested = {r.a: r for r in co.tested_pairs(pairs).collect()}
    assert tested["a5"].p_value == pytest.approx(1.0) and tested["a0"].strength == "Moderate"
    assert tested["a10"].p_value == pytest.approx(0.0979, abs=1e-3)  # r = 0.5, n = 12


def test_empty(spark):
    empty = spark.createDataFrame([], "sample string, feature string, value double")
    assert co.all_pair_correlations(empty, [], "sample", "feature", "value").count() == 0


@pytest.mark.parametrize("cost", [0, 10**9])
def test_wide_tables_keep_pairs_of_few_samples_in_their_task(spark, monkeypatch, cost):
    for name, value in (("WIDE", 64), ("WIDE_BLOCK", 128), ("WIDE_CHUNK", 16), ("SAMPLE_COST", cost)):
        monkeypatch.setattr(co, name, value, raising=False)
    rows = cells(40, 260, 0.8, 4)
    df = spark.createDataFrame(rows, "dataset string, sample string, feature string, value double")
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    shuffled = lambda: sum(stages().apply(i).shuffleWriteRecords() for i in range(stages().size()))
    before = shuffled()
    got = {(r.a, r.b): (r.r, r.n) for r in co.all_pair_correlations(df, [], "sample", "feature", "value", least_n=5).collect()}
    assert shuffled() - before < 20_000  # 30,000 pairs share a sample
    want = {k: v for k, v in expected(rows).items() if v[1] >= 5}
    assert set(got) == set(want)
    for key, (r, n) in want.items():
        assert got[key][1] == n and got[key][0] == pytest.approx(r, abs=1e-9)


@pytest.mark.parametrize("task,counters,met", [(500_000, 4_000_000, 1_000_000), (60, 0, 50), (300, 10**6, 200)])
@pytest.mark.parametrize("raw", [False, True])
def test_mostly_empty_tables_go_by_their_cells(spark, monkeypatch, task, counters, met, raw):
    for name, value in (("MANY", 64), ("FILLED", 0.4), ("TASK_CELLS", task), ("SPARSE_CELLS", max(2 * task, 10**5)), ("COUNTERS", counters), ("MET_CELLS", met), ("SPARSE_BLOCKS", 9)):
        monkeypatch.setattr(co, name, value)
    # two groups, a cell given twice, keys of null
    rows = cells(30, 150, 0.8, 5) + [("e", *r[1:]) for r in cells(20, 90, 0.7, 6)]
    twice = next(r for r in rows if r[3] is not None)
    df = spark.createDataFrame([*rows, (*twice[:3], twice[3] + 2), ("d", None, "f001", 3.0), ("d", "s001", None, 3.0)], "dataset string, sample string, feature string, value double")
    assert co.mostly_empty(df, ["dataset"], "sample", "feature", "value")
    rows = [(*r[:3], r[3] + 1) if r is twice else r for r in rows]
    if not raw:
        got = {(r.dataset, r.a, r.b): (r.r, r.n) for r in co.all_pair_correlations(df, ["dataset"], "sample", "feature", "value", least_n=3).collect()}
        want = {(d, *k): v for d in "de" for k, v in expected([r for r in rows if r[0] == d]).items() if v[1] >= 3}
        assert set(got) == set(want)
        for key, (r, n) in want.items():
            assert got[key][1] == n and got[key][0] == pytest.approx(r, abs=1e-8)
        return
    sums = {(r.dataset, r.a, r.b): (r.n, r.sx, r.sxy) for r in co.pair_sums(df, ["dataset"], "sample", "feature", "value", raw=True).collect()}
    held = {}
    for d, s, f, v in rows:
        if v is not None:
            held.setdefault((d, f), {})[s] = v
    want = {(d, a, b): [(x[s], y[s]) for s in x.keys() & y.keys()] for (d, a), x in held.items() for (e, b), y in held.items() if d == e and a < b and x.keys() & y.keys()}
    assert set(sums) == set(want)
    for key, both in want.items():
        assert sums[key] == pytest.approx((len(both), sum(x for x, _ in both), sum(x * y for x, y in both)))


def test_wide_tables_that_are_full_go_by_whole_matrices(spark, monkeypatch):
    for name, value in (("WIDE", 64), ("WIDE_BLOCK", 128), ("WIDE_CHUNK", 16), ("MANY", 64)):
        monkeypatch.setattr(co, name, value)
    rows = cells(20, 130, 0.1, 7)
    df = spark.createDataFrame(rows, "dataset string, sample string, feature string, value double")
    assert not co.mostly_empty(df, [], "sample", "feature", "value")
    got = {(r.a, r.b): (r.r, r.n) for r in co.all_pair_correlations(df, [], "sample", "feature", "value").collect()}
    want = expected(rows)
    assert set(got) == set(want) and max(abs(got[k][0] - want[k][0]) for k in want) < 1e-8


def test_prices_are_dealt_to_pairs_without_whole_rows(spark, monkeypatch, tmp_path):
    """Cells travel to pairs of blocks once for each that their sample is in, packed."""
    monkeypatch.setattr(co, "MANY", 64)
    rows = [("d", f"s{(f * 7 + k * 13) % 50 + 50 * (f // 300):03d}", f"f{f:04d}", float((f * k) % 17 + k)) for f in range(900) for k in range(6)]
    df = spark.createDataFrame(rows, "dataset string, sample string, feature string, value double").cache()
    df.count()
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    shuffled = lambda: sum(stages().apply(i).shuffleWriteRecords() for i in range(stages().size()))
    before = shuffled()
    assert co.pair_sums(df, [], "sample", "feature", "value").count() > 10_000
    assert shuffled() - before < 3 * len(rows)  # once by feature, once by sample
