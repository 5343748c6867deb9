"""A side that does not vary has no correlation; it must not end the job."""

from pyspark.sql import functions as F

from tallyloom.functions.moments import correlation
from tallyloom.operators import aggregates as ag
from tallyloom.operators import statistics as st


def test_helper(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 7.0), ("a", None, 9.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: r.r for r in rows.groupBy("k").agg(F.round(correlation("x", "y"), 6).alias("r")).collect()}
    assert got == {"a": 0.993399, "b": None, "c": None}


def test_callers(spark):
    rows = spark.createDataFrame([("d", s, f, 1.0 if f == "flat" else float(s * s), float(s)) for s in range(8) for f in ("flat", "up")],
                                 "dataset string, sample int, feature string, value double, trait double")
    keys = ["dataset", "feature"]
    assert {r.feature: round(r.r, 2) for r in st.trait_association(rows, keys, "trait").collect()} == {"flat": 0.0, "up": 0.96}
    assert st.pair_correlations(rows, ["dataset"], "sample", "feature", "value", ["flat", "up"]).count() == 0
    points = rows.groupBy(*keys, "sample").agg(F.avg("value").alias("mean")).withColumns({"i": F.col("sample"), "step": F.lit(1.0)})
    assert {r.feature: r.trend for r in st.trend(points, keys, "sample").collect()}["flat"] == "stable"
    means = rows.select(F.when(F.col("feature") == "flat", "A").otherwise("B").alias("p"), F.col("sample").alias("f"), "value")
    assert st.platform_agreement(means, "p", "f", "value", "A", "B").first().r is None
    scores = rows.filter("feature = 'flat'").select(F.col("sample").cast("string").alias("sample"), F.lit("s").alias("set_id"), F.col("value").alias("es"))
    members = spark.createDataFrame([("s", "x")], "set_id string, feature string")
    assert ag.score_agreement(scores, scores, members, members).first().correlation is None
