"""Ranks that don't depend on the order in which numbers were added up."""

from pyspark.sql import functions as F

from tallyloom.operators import statistics as st
from tallyloom.plans.learning import t47_importance_levels


def test_means_are_worked_out_once(spark):
    """Worked out again, a mean may differ in its last digit and come before itself."""
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return float(x)

    score = F.udf(counted, "double").asNondeterministic()
    means = spark.range(100).select(F.col("id").alias("dataset"), F.lit("a").alias("system"), score("id").alias("score"))
    expected = spark.range(100).select(F.col("id").alias("dataset"), F.array(F.lit("a")).alias("expected"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert {r["rank"] for r in st.expected_rank(means, expected).collect()} == {1}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert seen.value == 100


def test_equal_sums_are_placed_by_feature(spark, tmp_path):
    prices = [0.1, 0.2, 0.3]  # added up from either end they differ in the last digit
    rows = [(k, p) for k in range(60) for p in (prices if k % 2 else prices[::-1])]
    spark.createDataFrame(rows, "l_partkey long, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [r.feature for r in t47_importance_levels(spark, str(tmp_path)).orderBy("place").collect()]
    assert got == list(range(60))
