"""Rules as rows: first match by scope and priority, thresholds, priorities and gain."""

from tallyloom.operators import rule_tables as rt


def test_first_rule(spark):
    rows = spark.createDataFrame([(1, "a", "control of x"), (2, "a", "case"), (3, "b", "control of x"), (4, "b", "nothing"), (5, None, "case"), (6, "a", None)],
                                 "id int, dataset string, title string")
    rules = rt.rule_frame(spark, [("a", 2, "control", "late"), ("a", 1, "^control", "own"), ("*", 0, "control", "any"), ("*", 5, "case", "case")])
    got = {r.id: r.effect for r in rt.first_by_rule(rows, rules, ["id"], "dataset", "title", otherwise="none").collect()}
    assert got == {1: "own", 2: "case", 3: "any", 4: "none", 5: "case", 6: "none"}


def test_thresholds(spark):
    metrics = spark.createDataFrame([("terms", "process_terms", 0.0), ("terms", "obsolete_share", 0.1), ("pathways", "pathways", 2000.0), ("coverage", "coverage", 0.85),
                                     ("terms", "errors", 3.0), ("pathways", "errors", 0.0), ("pathways", "coverage", 0.1)], "scope string, metric string, value double")
    got = {(r.scope, r.metric): (r.code, r.severity) for r in rt.broken_thresholds(metrics, rt.threshold_frame(spark)).collect()}
    assert got == {("terms", "process_terms"): ("no_process_terms", "error"), ("pathways", "pathways"): ("many_pathways", "info"),
                   ("coverage", "coverage"): ("medium_coverage", "warning"), ("terms", "errors"): ("repair_errors", "error")}


def test_priorities_and_gain(spark):
    counts = spark.createDataFrame([("errors", 3), ("warnings", 50), ("low_coverage", 7), ("no_match", 50), ("general", 0)], "category string, count long")
    got = [(r.category, r.priority, r.impact) for r in rt.issue_priorities(counts).orderBy("place").collect()]
    assert got == [("low_coverage", "high", "high"), ("errors", "high", "critical"), ("no_match", "medium", "moderate"), ("warnings", "medium", "moderate")]
    figures = spark.createDataFrame([(0, 0, 10), (3, 1, 10), (40, 0, 0)], "errors long, recoverable long, entries long")
    gain = [(r.error_gain, r.total_gain, r.error_effort, r.effort) for r in rt.estimated_gain(figures).orderBy("errors").collect()]
    assert gain == [(0.0, 0.0, None, "minimal"), (6.0, 12.0, "medium", "low"), (20.0, 20.0, "high", "low")]
