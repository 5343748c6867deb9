"""Principal components against numpy, from either side and by iteration; out-of-fold scores by hand."""

import numpy as np
import pytest

from tallyloom.operators import components as pca
from tallyloom.operators import learning as ml


def matrix(n, p, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) @ rng.normal(size=(3, p)) * 2 + rng.normal(size=(n, p)) * np.linspace(0.5, 2, p)
    x[:, 1] = 4.0  # does not vary
    return x


def long(spark, x):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "sample long, feature long, value double")


def reference(x):
    x = x[:, x.std(0) > 0]
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    return z, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("n,p", [(12, 30), (40, 9)])
def test_either_side(spark, n, p):
    x = matrix(n, p, n)
    z, values, vectors = reference(x)
    rank = min(n - 1, p - 1)
    model = pca.fit(long(spark, x), "sample", "feature", "value")
    got = model.variance.orderBy("component").toPandas()
    assert len(got) == rank and np.allclose(got.variance, values[:rank]) and got.variance.sum() == pytest.approx(p - 1)
    assert got.cumulative.iloc[-1] == pytest.approx(1.0)
    loadings = model.loadings.toPandas().pivot(index="feature", columns="component", values="loading").to_numpy()
    assert np.allclose(loadings.T @ loadings, np.eye(rank), atol=1e-8)
    assert np.allclose(np.abs(np.sum(loadings[:, :3] * vectors[:, :3], 0)), 1, atol=1e-6)
    scores = model.transform(long(spark, x)).toPandas().pivot(index="sample", columns="component", values="score").to_numpy()
    assert np.allclose(scores, z @ loadings, atol=1e-8) and np.allclose(scores.var(0), got.variance)


def test_iteration_finds_the_same(spark, monkeypatch):
    x = matrix(25, 18, 5)
    _, values, vectors = reference(x)
    with pytest.raises(ValueError):
        pca.fit(long(spark, x), "sample", "feature", "value", gram_side=10)
    monkeypatch.setattr(pca, "SPARE", 4)
    model = pca.fit(long(spark, x), "sample", "feature", "value", 2, gram_side=10)
    got = model.variance.orderBy("component").toPandas()
    assert np.allclose(got.variance, values[:2], rtol=1e-5)
    first = model.loadings.filter("component = 1").orderBy("feature").toPandas().loading.to_numpy()
    assert abs(first @ vectors[:, 0]) == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("n,p", [(25, 18), (18, 25)])
def test_cells_are_packed_once_and_rounds_write_nothing(spark, monkeypatch, n, p):
    x = matrix(n, p, 5)
    x[2, 3:6] = np.nan  # missing cells count as the feature's mean
    filled = np.where(np.isnan(x), np.nanmean(x, 0), x)
    z, values, vectors = reference(filled)
    monkeypatch.setattr(pca, "SPARE", 4)
    written, cut = [], pca.cut
    monkeypatch.setattr(pca, "cut", lambda df: written.append(1) or cut(df))
    held = pca.fit(long(spark, x), "sample", "feature", "value", 2, gram_side=10)
    assert len(written) <= 7  # before: two tables a round
    monkeypatch.setattr(pca, "HELD", 0)
    spread = pca.fit(long(spark, x), "sample", "feature", "value", 2, gram_side=10)
    parts = [[v.variance for v in model.variance.orderBy("component").collect()] for model in (held, spread)]
    assert np.allclose(parts[0], values[:2], rtol=1e-5) and np.allclose(parts[0], parts[1], rtol=1e-7)
    loadings = held.loadings.toPandas().pivot(index="feature", columns="component", values="loading").to_numpy()
    assert np.allclose(loadings.T @ loadings, np.eye(2), atol=1e-8) and np.allclose(np.abs(np.sum(loadings * vectors[:, :2], 0)), 1, atol=1e-3)


def test_top_loadings_and_membership(spark):
    x = matrix(30, 8, 2)
    model = pca.fit(long(spark, x), "sample", "feature", "value", 2)
    top = pca.top_loadings(model, 3)
    rows = top.orderBy("place").collect()
    assert [r.place for r in rows] == [1, 2, 3] and rows[0].strength >= rows[1].strength >= rows[2].strength
    sets = spark.createDataFrame([("all", f) for f in range(8)] + [("own", rows[0].feature), ("none", 99)], "set_id string, feature long")
    got = {r.set_id: r for r in pca.membership_profile(top, sets, "feature").collect()}
    assert got["all"].chosen == 3 and got["own"].chosen == 1 and got["none"].chosen == 0
    assert got["own"].enrichment == pytest.approx(1 / (1 * 3 / 9))
    needed = {r.threshold: r.needed for r in pca.components_needed(
        spark.createDataFrame([(1, 0.5), (2, 0.8), (3, 1.0)], "component int, cumulative double"), [0.5, 0.6, 0.95]).collect()}
    assert needed == {0.5: 1, 0.6: 2, 0.95: 3}


def test_scores_of_a_written_prediction_table(spark):
    rows = [(0, 1.0, 1.0, 0.9), (0, 0.0, 0.0, 0.2), (0, 1.0, 0.0, 0.4), (0, 0.0, 0.0, 0.4), (1, 1.0, 1.0, 0.7), (1, 0.0, 1.0, 0.8)]
    got = {r.fold: r for r in ml.fold_scores(spark.createDataFrame(rows, "fold int, label double, prediction double, score double"), True).collect()}
    assert got[0].accuracy == 0.75 and got[0].auc == pytest.approx((1 + 1 + 1 + 0.5) / 4)
    assert got[0].macro_f1 == pytest.approx((2 / 3 + 4 / 5) / 2)
    assert got[1].auc == 0.0 and got[1].accuracy == 0.5


@pytest.mark.parametrize("classifier", ["logistic", "forest"])
def test_every_row_is_predicted_out_of_its_fold(spark, classifier, capsys):
    rng = np.random.default_rng(1)
    base = spark.createDataFrame([(i, float(i % 2), [float(v + (i % 2) * 2) for v in rng.normal(size=3)]) for i in range(60)], "id long, two double, x array<double>")
    rows = ml.stratified_folds(ml.vectors(base, "x", ["id", "two"]), "id", "two", 3)
    out = ml.cross_validated(rows, "two", 3, classifier=classifier, keep=["id"])
    assert sorted(r.id for r in out.collect()) == list(range(60))
    assert {r.fold: r.n for r in out.groupBy("fold").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {0: 20, 1: 20, 2: 20}
    scores = ml.score_summary(ml.fold_scores(out, True)).first()
    assert scores.auc_mean > 0.8
    out.explain()
    assert "UDF" not in capsys.readouterr().out  # a plain scan: no model is left in the plan


@pytest.mark.parametrize("classifier", ["logistic", "forest"])
def test_models_do_not_take_the_session_along(spark, classifier):
    base = spark.createDataFrame([(i, float(i % 2), [float(i % 2), float(i % 7)]) for i in range(40)], "id long, two double, x array<double>")
    rows = ml.stratified_folds(ml.vectors(base, "x", ["id", "two"]), "id", "two", 2)
    spark.addTag("tagged")  # from here on the session itself can't be serialized
    try:
        assert ml.cross_validated(rows, "two", 2, classifier=classifier).count() == 40
    finally:
        spark.clearTags()


def test_clusters(spark):
    rows = ml.vectors(spark.createDataFrame([(i, [float(i % 3) * 10 + 1, float(i % 3 == 1) + 1]) for i in range(30)], "id long, x array<double>"), "x", ["id"])
    member = ml.assigned(rows, 3, ["id"])
    sizes = {r.cluster: r.n for r in member.groupBy("cluster").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert sorted(sizes.values()) == [10, 10, 10]
    held = ml.cluster_membership(member, spark.createDataFrame([(i, f"g{i % 3}") for i in range(30)], "id long, set_id string"), "id").collect()
    assert {(r.members, r.share, round(r.fold, 6)) for r in held} == {(10, 1.0, 3.0)} and len(held) == 3
    values = spark.createDataFrame([(i, j, float(i % 3 == j)) for i in range(30) for j in range(3)], "id long, dim long, x double")
    profile = ml.cluster_summary(values.join(member, "id"), "cluster", "dim", "x", "id", 2).collect()
    assert {r.size for r in profile} == {10} and all(len(r.leading) == 2 and r.leading[0] == r.dominant for r in profile)


@pytest.mark.parametrize("n,p", [(25, 18), (12, 30)])
def test_sums_of_a_spectrum_of_any_size(spark, monkeypatch, n, p):
    monkeypatch.setattr(pca, "GRAM_SIDE", 2)  # both sides are too long for the driver
    x = matrix(n, p, 7)
    _, values, _ = reference(x)
    got = pca.spectrum_sums(long(spark, x), "sample", "feature", "value").first()
    assert got.columns == p - 1 and got.total == pytest.approx(p - 1) and got.squares == pytest.approx((values ** 2).sum())
