"""Attribute texts, study designs and their statistics on small studies."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import metadata as md
from tallyloom.operators import design as dz


def study(spark, *per_sample):
    """``per_sample`` are attribute texts, one list per sample."""
    rows = [("d", f"s{i:02d}", p, text) for i, texts in enumerate(per_sample) for p, text in enumerate(texts)]
    attributes = spark.createDataFrame(rows, "dataset string, sample string, pos int, text string")
    return md.sample_design(md.sample_items(attributes, ["dataset", "sample"]))


def mode(spark, *per_sample):
    return dz.infer_design(study(spark, *per_sample)).first()


def test_case_control(spark):
    row = mode(spark, *[["group: control"]] * 6, *[["group: disease"]] * 6)
    assert (row["mode"], row.controls, row.cases) == (dz.CASE_CONTROL, 6, 6)


def test_time_series_wins_over_groups(spark):
    texts = [[f"time: {d} day", "group: control" if i % 2 else "group: disease"] for i, d in enumerate([0, 0, 1, 1, 3, 3, 7, 7])]
    assert mode(spark, *texts)["mode"] == dz.TIME_SERIES


def test_subtypes(spark):
    assert mode(spark, *[[f"subtype: s{i % 3}"] for i in range(12)])["mode"] == dz.SUBTYPES


def test_trait(spark):
    row = mode(spark, *[[f"bmi: {20 + i}.5"] for i in range(12)])
    assert (row["mode"], row.trait, row.primary_grouping) == (dz.TRAIT, "bmi", "bmi")


def test_unsupervised_and_small(spark):
    row = mode(spark, *[["tissue: blood"]] * 5)
    assert row["mode"] == dz.UNSUPERVISED and row.small_study


def test_two_attribute_lines_stay_with_their_samples(spark):
    rows = study(spark, ["batch: 1", "group: control"], ["batch: 2", "group: patient"]).orderBy("sample").collect()
    assert [r.group for r in rows] == ["control", "disease"]


@pytest.mark.parametrize("text, label", [
    ("healthy controls", "control"), ("abnormal", "abnormal"), ("growth factor", "growth_factor"), ("Tumor tissue", "disease"), ("wild type", "control")])
def test_group_words_are_whole_words(spark, text, label):
    assert spark.range(1).select(md.group_label(F.lit(text)).alias("x")).first().x == label


def test_loose_group_words(spark):
    assert spark.range(1).select(md.group_label(F.lit("abnormal"), loose=True).alias("x")).first().x == "control"


@pytest.mark.parametrize("text, days", [
    ("0 day", 0.0), ("12 h", 0.5), ("2 weeks", 14.0), ("1 month", 30.0), ("t7", 7.0), ("none", None), ("36 hours", 1.5)])
def test_times(spark, text, days):
    assert spark.range(1).select(md.days_in(F.lit(text)).alias("x")).first().x == days


def test_responses(spark):
    rows = study(spark, ["response: non-responder"], ["response: Responder"], ["outcome: remission"], ["x: y"]).orderBy("sample").collect()
    assert [r.response for r in rows] == ["non_responder", "responder", "responder", "unknown"]


def test_repeated_keys_last_wins_and_equals_sign(spark):
    rows = spark.createDataFrame([("d", "s", 0, "Age = 3"), ("d", "s", 1, "age: 7:8")], "dataset string, sample string, pos int, text string")
    items = md.sample_items(rows, ["dataset", "sample"])
    assert items.select(md.value_of(md.key_values(F.col("items")), F.lit("age")).alias("x")).first().x == "7:8"


def test_fallback_when_scores_do_not_support_the_design(spark):
    samples = study(spark, *[["group: control"]] * 3, *[["group: disease"]] * 3)
    values = spark.createDataFrame([("d", "s00", "f", 1.0), ("d", "s01", "f", 3.0)], "dataset string, sample string, feature string, value double")
    expected = spark.createDataFrame([("d", ["A"])], "dataset string, expected array<string>")
    out = dz.run_statistics(values, samples, expected, ["f", "g"], lambda f: f)
    row = out.filter(F.col("block") == dz.UNSUPERVISED).first()
    assert (row.key, row.metric, row.value) == ("f", "mean", 2.0)
    status = out.filter("block = 'status'").first()
    assert (status.key, status.value, status.note) == (dz.CASE_CONTROL, 1.0, dz.FALLBACK_REASONS[dz.CASE_CONTROL])
