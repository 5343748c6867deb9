"""Scores against a plain loop, and their edge cases."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import enrichment as en


def loop_score(sample, members, alpha=0.25):
    """Walk down the sorted sample, up on hits and down on misses."""
    ordered = sorted(((f, v) for f, v in sample.items() if v is not None), key=lambda p: (-p[1], p[0]))
    hits = [f for f, _ in ordered if f in members]
    weight = sum(abs(v) ** alpha for f, v in ordered if f in members)
    if not hits or weight == 0:
        return 0.0
    miss = 1 / (len(ordered) - len(hits)) if len(ordered) > len(hits) else 0.0
    at = high = low = 0.0
    for f, v in ordered:
        at += abs(v) ** alpha / weight if f in members else -miss
        high, low = max(high, at), min(low, at)
    return high if round(abs(high), 12) >= round(abs(low), 12) else low


def tables(spark, samples, sets):
    values = spark.createDataFrame(
        [(s, f, v) for s, cells in samples.items() for f, v in cells.items()], "sample string, feature string, value double")
    members = spark.createDataFrame([(k, f) for k, fs in sets.items() for f in fs], "set_id string, feature string")
    return values, members


def test_against_loop(spark):
    rnd = random.Random(1)
    features = [f"f{i:02d}" for i in range(40)]
    samples = {f"s{j}": {f: (None if rnd.random() < 0.1 else round(rnd.gauss(0, 2), 1)) for f in features} for j in range(5)}
    sets = {"few": features[:6], "all": features, "none": ["x", "y"], "half": features[::2]}
    values, members = tables(spark, samples, sets)
    got = {(r.sample, r.set_id): r.es for r in en.running_extreme_scores(values, members).collect()}
    assert len(got) == 20
    for (s, k), es in got.items():
        assert es == pytest.approx(loop_score(samples[s], set(sets[k])), abs=1e-12)
        assert -1 - 1e-12 <= es <= 1 + 1e-12


def test_hand_computed(spark):
    values, members = tables(spark, {"s": {"a": 4.0, "b": 1.0, "c": 0.0, "d": -16.0}}, {"k": ["a", "d"]})
    es = en.running_extreme_scores(values, members).first().es
    # weights 4^.25 and 16^.25; after a the curve is at its top, before d at its bottom
    up = 4 ** 0.25 / (4 ** 0.25 + 16 ** 0.25)
    assert es == pytest.approx(up if up >= abs(up - 1) else up - 1)


def test_zero_weights_score_zero(spark):
    values, members = tables(spark, {"s": {"a": 0.0, "b": 1.0}}, {"k": ["a"]})
    assert en.running_extreme_scores(values, members).first().es == 0.0


def test_guards(spark):
    values, members = tables(spark, {"s": {"a": 1.0}}, {"k": ["z"]})
    from tallyloom.operators.joins import set_coverage
    with pytest.raises(ValueError):
        en.require_matches(set_coverage(members, values))
    with pytest.raises(ValueError):
        en.require_features(values, probe_share=0.5)
    assert en.require_features(values, probe_share=0.0) == 1


def test_rank_area_by_loop(spark):
    rnd = random.Random(3)
    features = [f"f{i}" for i in range(30)]
    samples = {f"s{j}": {f: rnd.random() for f in features} for j in range(3)}
    sets = {"k": features[3:12], "m": features[:5]}
    values, members = tables(spark, samples, sets)
    got = {(r.sample, r.set_id): r for r in en.rank_area_scores(values, members).collect()}
    want = {}
    for s, cells in samples.items():
        ordered = sorted(cells, key=lambda f: -cells[f])
        level = {f: 10000 * (len(ordered) - i) / len(ordered) for i, f in enumerate(ordered)}
        for k, fs in sets.items():
            total = sum(level[f] ** 0.25 for f in fs)
            inside = outside = area = 0.0
            for f in ordered:
                if f in fs:
                    inside += level[f] ** 0.25 / total
                else:
                    outside += 1 / (len(ordered) - len(fs))
                area += inside - outside
            want[(s, k)] = area
    span = max(want.values()) - min(want.values())
    for key, area in want.items():
        assert got[key].es == pytest.approx(area, abs=1e-9)
        assert got[key].nes == pytest.approx(area / span, abs=1e-9)
        assert math.isfinite(got[key].nes)


def test_a_task_orders_a_bounded_number_of_hits(spark, monkeypatch):
    monkeypatch.setattr(en, "TASK_ROWS", 50)
    values = spark.range(20 * 30).select((F.col("id") % 20).alias("sample"), F.expr("id div 20").alias("feature"), F.expr("double(id * 7 % 101)").alias("value"))
    sets = spark.range(30).select(F.expr("explode(array('x' || id % 2, 'y' || id % 3))").alias("set_id"), F.col("id").alias("feature"))
    scores = en.running_extreme_scores(values, sets)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(sample#\d+L?(?:, set_id#\d+)?, (\d+)\)", plan)]
    assert 600 // 50 + 1 in tasks and 1200 // 50 + 1 in tasks
    got = {(r.sample, r.set_id): r.es for r in scores.collect()}
    monkeypatch.setattr(en, "TASK_ROWS", 1_000_000)
    assert got == {(r.sample, r.set_id): r.es for r in en.running_extreme_scores(values, sets).collect()} and len(got) == 100


def test_a_task_averages_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(en, "TASK_ROWS", 50)
    rows = spark.range(1000).select((F.col("id") % 40).alias("sample"), (F.col("id") % 250).alias("feature"), F.col("id").cast("double").alias("value"))
    got = en.dealt_means(rows, ["sample", "feature"])
    assert got.rdd.getNumPartitions() == 1 + 1000 // 50
    assert {(r.sample, r.feature): r.value for r in got.collect()} == {
        (r.sample, r.feature): r.value for r in rows.groupBy("sample", "feature").agg(F.avg("value").alias("value")).collect()}


@pytest.mark.parametrize("name", ["e9_scores_by_timepoint", "g27_timepoint_rankings"])
def test_scores_by_year_read_dealt_means(spark, monkeypatch, name):
    from tallyloom.plans import common, registry
    keys = []

    def dealt(rows, by, value="value"):
        keys.append(list(by))
        return en.dealt_means(rows, by, value)

    monkeypatch.setattr(common, "dealt_means", dealt)
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert keys == [["day", "sample", "feature"]]
