"""One entry per branch of the term classifier."""

import pytest

from tallyloom.operators import classification as cl


def classify(spark, name, definition=None, rules=None):
    row = spark.createDataFrame([(1, name, definition)], "id int, name string, definition string")
    return cl.classify(row, rules).first()


@pytest.mark.parametrize("name, definition, kind, system, subsystem, confidence", [
    ("biological_process", "anything about insulin", "general", "0", None, 0.9),
    ("telomere", None, "standard", "A", "A1", 0.9),
    ("insulin and telomere", None, "standard", "A", "A1", 0.8),
    ("nothing known", None, "standard", "0", None, 0.1),
    ("IL-6 recognition", None, "inflammation", "B", None, 0.1),
    ("immune tolerance", None, "inflammation", "B", "B3", 0.9),
    ("lipoxin in macrophage", None, "inflammation", "A", "A4", 0.8),
    ("killing and repair", "pathogen killing attack", "complex", "B", None, 0.64),
    ("repair assembly and formation with death", "wound", "complex", "A", "A1", 0.64),
])
def test_branches(spark, name, definition, kind, system, subsystem, confidence):
    row = classify(spark, name, definition)
    assert (row.kind, row.system, row.subsystem) == (kind, system, subsystem)
    assert row.confidence == pytest.approx(confidence)


def test_two_sided_entries_are_discounted(spark):
    row = classify(spark, "clearance of debris", "formation of structures")
    assert row.kind == "complex" and row.destructive_score > 0 and row.constructive_score > 0
    assert row.confidence <= 0.9 and row.path[-1] == "complex_pathway_analysis"


def test_added_word(spark):
    assert classify(spark, "zymurgy").system == "0"
    assert classify(spark, "zymurgy", rules=cl.Rules().with_word("C", "zymurgy")).system == "C"


def test_equal_priorities_go_by_word_count(spark):
    rules = cl.Rules()
    rules.priority = {**rules.priority, "D": 5, "C": 5}
    row = classify(spark, "insulin hormone glycolysis", rules=rules)
    assert row.system == "D" and row.confidence == pytest.approx(0.7) and row.path[-1] == "pattern_count_D"


def test_probabilities_sum_to_one(spark):
    rows = spark.createDataFrame([(1, "dna repair in cell cycle"), (2, "nothing")], "id int, name string")
    out = cl.label_probabilities(rows, "id", "name").collect()
    assert {r.id for r in out} == {1} and sum(r.probability for r in out) == pytest.approx(1.0)
