"""The spread form of every ordered operator gives the rows of the window form."""

import random

from pyspark.sql import functions as F

from tallyloom.operators.enrichment import rank_area_scores, running_extreme_scores
from tallyloom.operators.ordering import quantiles, running, tie_ranks, tied_positions
from tallyloom.operators.statistics import adjust, rank_sum


def rows(df):
    def plain(v):
        return round(v, 9) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def table(spark):
    rnd = random.Random(7)
    # one group holds most rows, and one value most of that group
    data = [("hot" if i % 4 else f"g{i % 3}", i, float(rnd.choice([1, 1, 1, 2, 5, 9])), rnd.random()) for i in range(400)]
    return spark.createDataFrame(data, "g string, id int, v double, w double")


def both(spark, make):
    spark.conf.unset("spark.tallyloom.windowRows")
    small = rows(make(table(spark)))
    spark.conf.set("spark.tallyloom.windowRows", "2")
    try:
        return small, rows(make(table(spark)))
    finally:
        spark.conf.unset("spark.tallyloom.windowRows")


def test_running_forms_agree(spark):
    small, spread = both(spark, lambda t: running(
        t, ["g"], [F.col("v").desc(), F.col("id")], {"s": "w"}, {"n": None, "total": "w"}, {"least": "w"}))
    assert small == spread and len(small) == 400


def test_tie_rank_forms_agree(spark):
    for method in ("average", "min"):
        small, spread = both(spark, lambda t: tie_ranks(t, ["g"], "v", descending=True, method=method))
        assert small == spread


def test_tied_positions_by_loop(spark):
    """Ties over the edges of slices, a value that fills several slices, and a group of one value."""
    data = [(g, i, None if i % 17 == 0 else float(v)) for g, values in (("a", [1] * 90 + [2] * 7 + list(range(3, 40))), ("b", [5] * 40), ("c", [7, 6]))
            for i, v in enumerate(values)]
    want = []
    for descending in (False, True):
        for g, i, v in data:
            own = [(x, j) for h, j, x in data if h == g and x is not None]
            if v is not None:
                before = [x for x, _ in own if (x > v if descending else x < v)]
                same = [j for x, j in own if x == v]
                want.append((descending, g, i, len(before) + 1, len(before) + len(same), len(before) + 1 + sum(j < i for j in same), len(own)))

    def got(small):
        t = spark.createDataFrame(data, "g string, id int, v double")
        return sorted((d, r.g, r.id, r.tie_first, r.tie_last, r.position, r.group_rows)
                      for d in (False, True) for r in tied_positions(t, ["g"], "v", ["id"], d, small).collect())

    assert got(True) == sorted(want) and got(False) == sorted(want)


def test_ranks_need_one_shuffle(spark, capsys):
    tie_ranks(table(spark).repartition(3, "id"), ["g"], "v").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(g#") == 1 and "hashpartitioning(g#" in plan and "Join" not in plan


def test_quantile_forms_agree(spark):
    small, spread = both(spark, lambda t: quantiles(t, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 1 / 3, "d": 1.0}))
    assert small == spread
    small, spread = both(spark, lambda t: quantiles(t, ["g"], "w", {"a": 0.1, "b": 0.9}))
    assert small == spread


def test_rank_sum_and_adjustment_forms_agree(spark):
    small, spread = both(spark, lambda t: rank_sum(
        t.withColumn("k", F.when(F.col("id") % 2 == 0, "x").otherwise("y")).withColumnRenamed("v", "value"), ["g"], "k", "x", "y"))
    assert small == spread
    for method in ("bonferroni", "fdr_bh", "fdr_by"):
        small, spread = both(spark, lambda t: adjust(t, ["g"], "w", "id", method))
        assert small == spread


def test_enrichment_forms_agree(spark):
    def values(t):
        return t.select(F.col("g").alias("sample"), F.col("id").alias("feature"), F.col("w").alias("value"))

    def sets(t):
        return t.select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("set_id"), F.col("id").alias("feature"))

    small, spread = both(spark, lambda t: running_extreme_scores(values(t), sets(t)))
    assert small == spread
    small, spread = both(spark, lambda t: rank_area_scores(values(t), sets(t)))
    assert small == spread
