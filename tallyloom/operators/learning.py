"""Baselines on vectors: scaling, PCA, cross-validated classifiers, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import running, top_rows
from tallyloom.operators.statistics import one_sample_t, rank_sum
from tallyloom.session import cut, cut_all, new_table

def vectors(rows: DataFrame, array: str, keep: Sequence[str]) -> DataFrame:
    return rows.select(*keep, array_to_vector(F.col(array).cast("array<double>")).alias("features"))


def standardised(values: DataFrame, feature: Sequence[str], value: str) -> DataFrame:
    """z-values with the population sd over all rows of a feature; 0 where it
    does not vary."""
    moments = values.groupBy(*feature).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return values.join(moments, list(feature)).withColumn("z", z).drop("_m", "_s")


def scaled_pca(k: int) -> list:
    """Stages: standardise (MLlib divides by the sample sd, which scales all
    components alike) and project."""
    return [
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        PCA(k=k, inputCol="scaled", outputCol="components"),
    ]


def bare(model: PipelineModel, path: str) -> PipelineModel:
    """``model`` written to ``path`` and read back, which leaves out its training summaries: they hold the
    session, and a session with tags cannot be sent to the tasks."""
    model.write().save(path)
    return PipelineModel.load(path)


def stratified_folds(rows: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1: within each class rows are dealt out in a seeded
    order, so folds have the classes in equal shares."""
    draw = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    dealt = running(rows.withColumn("_draw", draw), [label], [F.col("_draw"), F.col(key)], position="_at")
    return dealt.withColumn("fold", ((F.col("_at") - 1) % k).cast("int")).drop("_draw", "_at")


def fold_count(rows: DataFrame, label: str, k: int) -> int:
    """At most the size of the smallest class."""
    smallest = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    return max(2, min(k, smallest))


def cross_validated(rows: DataFrame, label: str, k: int, components: int | None = None, leaky: bool = False,
                    classifier: str = "logistic", keep: Sequence[str] = ()) -> DataFrame:
    """One written table (*keep, fold, label, prediction, score) of every row,
    predicted by a model that did not see its fold.

    Scaling and PCA are fitted inside the folds; ``leaky`` fits them on all
    rows first.  ``classifier`` is ``logistic`` or ``forest``; ``score`` is the
    probability of class 1, by which rows of any classifier are ranked for the AUC.
    """
    column = "components" if components else "features"
    prepared = rows
    stages = scaled_pca(components) if components else []
    if leaky and stages:
        prepared = Pipeline(stages=stages).fit(rows).transform(rows).drop("features", "scaled")
        stages = []
    # written once: every fold reads it, and a lost executor costs nothing
    prepared = cut(prepared)
    dealt = prepared.agg(F.max("fold")).first()[0]

    def predicted(fold: int) -> DataFrame:
        train = prepared.filter(F.col("fold") != fold)
        if classifier == "logistic":
            model = LogisticRegression(featuresCol=column, labelCol=label, regParam=1.0 / max(train.count(), 1),
                                       elasticNetParam=0.0, standardization=False, maxIter=100)
        elif classifier == "forest":
            model = RandomForestClassifier(featuresCol=column, labelCol=label, numTrees=100, seed=42)
        else:
            raise ValueError(f"unknown classifier {classifier}")
        fitted = bare(Pipeline(stages=[*stages, model]).fit(train), new_table(rows.sparkSession))
        return fitted.transform(prepared.filter(F.col("fold") == fold)).select(
            *keep, "fold", F.col(label).cast("double").alias("label"), "prediction",
            vector_to_array("probability").getItem(1).alias("score"))

    # each fold's predictions are written before the next model is fitted, so no model is part of a later plan;
    # small classes may allow fewer folds than asked for
    return cut_all(predicted(fold) for fold in range(min(k, dealt + 1)))


def fold_scores(predictions: DataFrame, binary: bool) -> DataFrame:
    """Accuracy, macro F1 and (two classes) AUC of each fold."""
    cells = predictions.groupBy("fold", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    accuracy = cells.groupBy("fold").agg((F.sum(hit) / F.sum("n")).alias("accuracy"))
    actual = cells.groupBy("fold", F.col("label").alias("c")).agg(F.sum("n").alias("_a"), F.sum(hit).alias("_h"))
    said = cells.groupBy("fold", F.col("prediction").alias("c")).agg(F.sum("n").alias("_p"))
    f1 = actual.join(said, ["fold", "c"], "full_outer").fillna(0).groupBy("fold").agg(
        F.avg(F.when(F.col("_a") + F.col("_p") > 0, 2 * F.col("_h") / (F.col("_a") + F.col("_p"))).otherwise(0.0)).alias("macro_f1"))
    out = accuracy.join(f1, "fold")
    if not binary:
        return out
    ranked = predictions.select("fold", F.col("label").cast("int").cast("string").alias("_g"), F.col("score").alias("value"))
    return out.join(rank_sum(ranked, ["fold"], "_g", "1", "0").select("fold", "auc"), "fold")


def score_summary(folds: DataFrame) -> DataFrame:
    columns = [c for c in folds.columns if c != "fold"]
    return folds.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_sd") for c in columns])


def compare_representations(first: DataFrame, second: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Paired t over folds, Cohen's d and share of folds the first one wins."""
    both = first.select("fold", F.col(metric).alias("_x")).join(second.select("fold", F.col(metric).alias("_y")), "fold")
    gaps = both.select(F.lit(metric).alias("metric"), (F.col("_x") - F.col("_y")).alias("gap"))
    wins = gaps.groupBy("metric").agg(F.avg((F.col("gap") > 0).cast("double")).alias("win_rate"))
    return one_sample_t(gaps, ["metric"], "gap").join(wins, "metric")


def forest_importances(rows: DataFrame, label: str, trees: int = 100, seed: int = 42) -> DataFrame:
    """(feature, importance, place) of a forest; one row per column."""
    model = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, seed=seed).fit(rows)
    parts = [(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())]
    ranked = sorted(parts, key=lambda p: (-p[1], p[0]))
    return rows.sparkSession.createDataFrame(
        [(f, v, i + 1) for i, (f, v) in enumerate(ranked)], "feature int, importance double, place int")


def cluster_sweep(rows: DataFrame, ks: Sequence[int], seed: int = 42, bisecting: bool = False) -> DataFrame:
    """(k, cost, silhouette, drop, elbow, best) over numbers of clusters.

    ``elbow`` marks the largest fall of the cost, ``best`` the highest
    silhouette.
    """
    rows = cut(rows)
    results = []
    for k in ks:
        kind = BisectingKMeans if bisecting else KMeans
        model = kind(k=k, seed=seed, featuresCol="features").fit(rows)
        scored = model.transform(rows)
        results.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator(featuresCol="features").evaluate(scored))))
    drops = [None] + [results[i - 1][1] - results[i][1] for i in range(1, len(results))]
    elbow = max((d, -results[i][0]) for i, d in enumerate(drops) if d is not None) if len(results) > 1 else (None, None)
    best = max(results, key=lambda r: (r[2], -r[0]))[0]
    return rows.sparkSession.createDataFrame(
        [(k, c, s, d, d is not None and (d, -k) == elbow, k == best) for (k, c, s), d in zip(results, drops)],
        "k int, cost double, silhouette double, drop double, elbow boolean, best boolean")


def assigned(rows: DataFrame, k: int, keep: Sequence[str], seed: int = 42, bisecting: bool = False) -> DataFrame:
    """One written table ``(*keep, cluster)``: which cluster each row was put into."""
    kind = BisectingKMeans if bisecting else KMeans
    fitted = kind(k=k, seed=seed, featuresCol="features").fit(rows)
    return cut(fitted.transform(rows).select(*keep, F.col("prediction").alias("cluster")))


def cluster_profiles(values: DataFrame, cluster: str, feature: str, value: str) -> DataFrame:
    """Mean per cluster and feature, its ratio to the overall mean."""
    overall = values.groupBy(feature).agg(F.avg(value).alias("overall"))
    means = values.groupBy(cluster, feature).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return means.join(overall, feature).withColumn(
        "fold", F.when(F.col("overall") != 0, F.col("mean") / F.col("overall")))


def cluster_summary(values: DataFrame, cluster: str, feature: str, value: str, member: str, n: int = 3) -> DataFrame:
    """``(cluster, size, dominant, leading)``: members, the feature of highest mean, and the ``n`` features of highest mean in order."""
    sizes = values.groupBy(cluster).agg(F.count_distinct(member).alias("size"))
    means = values.groupBy(cluster, feature).agg(F.avg(value).alias("_m"))
    best = top_rows(means, [cluster], [F.round("_m", 12).desc(), F.col(feature)], n).groupBy(cluster).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", feature))), lambda e: e[feature]).alias("leading"))
    return sizes.join(best, cluster).select(cluster, "size", F.get("leading", F.lit(0)).alias("dominant"), "leading")


def cluster_membership(assignment: DataFrame, groups: DataFrame, member: str, group: str = "set_id") -> DataFrame:
    """``(cluster, group, members, share, fold)``: members of each cluster in each group, and that share against the group's share of all."""
    sizes = assignment.groupBy("cluster").agg(F.count(F.lit(1)).alias("_size"))
    n = assignment.count()
    joined = assignment.join(groups.select(member, group).distinct(), member)
    counts = joined.groupBy("cluster", group).agg(F.count(F.lit(1)).alias("members"))
    overall = joined.groupBy(group).agg(F.count(F.lit(1)).alias("_all"))
    share = F.col("members") / F.col("_size")
    return counts.join(sizes, "cluster").join(overall, group).select(
        "cluster", group, "members", share.alias("share"), (share / (F.col("_all") / F.lit(n))).alias("fold"))
