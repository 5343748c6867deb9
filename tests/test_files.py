"""Text files written to a folder and read back."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.catalogue import move_to_archive
from tallyloom.sources import matrices as mx
from tallyloom.sources import ontologies as on
from tallyloom.sources import platforms as pf
from tallyloom.sources import sinks, tables

MATRIX = """!Series_title\t"A study"
!Series_type\t"Expression profiling by array"
!Series_sample_taxid\t"9606"
!Series_sample_id\t"GSM1 GSM2 GSM3 GSM4 GSM5 GSM6"
!Sample_title\t"a"\t"b"\t"c"\t"d"\t"e"\t"f"
!Sample_geo_accession\t"GSM1"\t"GSM2"\t"GSM3"\t"GSM4"\t"GSM5"\t"GSM6"
!Sample_characteristics_ch1\t"group: control"\t"group: control"\t"group: x"\t"group: x"\t"group: x"\t"group: x"
!Sample_characteristics_ch1\t"age: 1"\t"age: 2"\t"age: 3"\t"age: 4"\t"age: 5"\t"age: 6"
!series_matrix_table_begin
"ID_REF"\t"GSM1"\t"GSM2"\t"GSM3"\t"GSM4"\t"GSM5"\t"GSM6"
"p1"\t1.5\t2\t3\tnull\t5\t6
"p2"\tx\t\t\t\t\t
"p3"\t-1\t0\t1\t2\t3\t4
!series_matrix_table_end
"""


@pytest.fixture
def matrix(spark, tmp_path):
    with gzip.open(tmp_path / "one_series_matrix.txt.gz", "wt") as f:
        f.write(MATRIX)
    return mx.read_lines(spark, str(tmp_path / "*.gz"))


def test_matrix(matrix):
    got = {(r.feature, r.sample): r.value for r in mx.matrix_values(matrix).collect()}
    assert len(got) == 11 and got[("p1", "GSM1")] == 1.5 and ("p1", "GSM4") not in got
    assert not any(f == "p2" for f, _ in got)


def test_matrix_verdict(matrix):
    row = mx.matrix_verdicts(matrix).first()
    assert (row.usable, row.reason, row.samples, row.table_lines) == (True, "ok", 6, 4)


def test_sample_lines_follow_their_sample(matrix):
    got = {(r.sample, r.text) for r in mx.sample_attributes(matrix).collect()}
    assert ("GSM1", "group: control") in got and ("GSM6", "age: 6") in got and len(got) == 12
    assert {r.title for r in mx.sample_table(matrix).collect()} == set("abcdef")
    assert mx.study_texts(matrix).first().title == "A study"


def test_lenient_matrix(spark, tmp_path):
    (tmp_path / "m.txt").write_text('"ID_REF"\t"XGSM1"\t"GSM2"\np1\t1\t2\np2\t1\n')
    got = mx.matrix_values(mx.read_lines(spark, str(tmp_path / "m.txt")), lenient=True).collect()
    assert {(r.feature, r.sample) for r in got} == {("p1", "GSM1"), ("p1", "GSM2")}


def test_platform_by_name_and_by_spot(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#c\n!platform_table_begin\nID\tGene Symbol\n1_at\tTP53 /// X\n2_at\t---\n3_at\tcontrol\n!platform_table_end\n")
    assert [tuple(r)[1:] for r in pf.platform_map(mx.read_lines(spark, str(tmp_path / "a.txt"))).collect()] == [("1_at", "TP53")]
    (tmp_path / "b.txt").write_text("ID\tSPOT_ID\nENSG01\tTP53\nENSG02\tBRCA1\nENSG03\tMYC\n")
    got = {tuple(r)[1:] for r in pf.platform_map(mx.read_lines(spark, str(tmp_path / "b.txt"))).collect()}
    assert got == {("ENSG01", "TP53"), ("ENSG02", "BRCA1"), ("ENSG03", "MYC")}
    (tmp_path / "c.txt").write_text("ID\tILMN_Gene\nILMN_1\tA;B\nILMN_2\tC\n")
    got = {r.feature: r.targets for r in pf.platform_map_all(mx.read_lines(spark, str(tmp_path / "c.txt")), pf.ILLUMINA_SYMBOL_COLUMNS).collect()}
    assert got == {"ILMN_1": ["A", "B"], "ILMN_2": ["C"]}


def test_ontology_and_pathway_files(spark, tmp_path):
    (tmp_path / "o.obo").write_text(
        'format-version: 1.2\n\n[Term]\nid: GO:0000001\nname: one\nnamespace: biological_process\ndef: "first" [x]\n'
        'synonym: "uno" EXACT []\nis_a: GO:0000002 ! two\nrelationship: part_of GO:0000003 ! three\n'
        "relationship: positively_regulates GO:0000004\n\n[Term]\nid: GO:0000002\nname: two\nis_obsolete: true\n\n[Typedef]\nid: part_of\n")
    rows = {r.id: r for r in on.terms(on.read_stanzas(spark, str(tmp_path / "o.obo"))).collect()}
    assert set(rows) == {"GO:0000001", "GO:0000002"}
    one = rows["GO:0000001"]
    assert (one.is_a, one.part_of, one.regulates, one.definition, one.synonyms) == (["GO:0000002"], ["GO:0000003"], ["GO:0000004"], "first", ["uno"])
    assert rows["GO:0000002"].obsolete and not one.obsolete
    (tmp_path / "p.keg").write_text("+D\n!\nAMetabolism\nB  Carbo\nC    00010  Glycolysis\nC    bad line\nAOther\nC    00020  Loose\nB  Late\nC    00030  In late\n!\n")
    got = {r.id: (r.name, r.class_a, r.class_b) for r in on.pathways(on.read_pathway_files(spark, str(tmp_path / "p.keg"))).collect()}
    assert got == {"00010": ("Glycolysis", "Metabolism", "Carbo"), "00020": ("Loose", "Other", ""), "00030": ("In late", "Other", "Late")}


def test_flat_records(spark):
    text = "ENTRY       hsa00010    Pathway\nNAME        Glyco\nGENE        3101  HK3; hexokinase 3\n            3098  HK1; hexokinase 1\nCOMPOUND    C00022  Pyruvate\n"
    rows = spark.createDataFrame([(text,)], "record string")
    assert {tuple(r) for r in on.record_features(rows).collect()} == {("00010", "HK3"), ("00010", "HK1")}
    assert spark.range(1).select(on.bare_pathway_id(F.lit("KEGG:hsa00010")).alias("x")).first().x == "00010"


def test_run_summaries(spark, tmp_path):
    for name, errors in (("a", []), ("b", ["failed"])):
        (tmp_path / f"{name}.json").write_text(json.dumps({
            "dataset_id": name, "disease_type": "cancer", "top_systems": ["A"], "errors": errors,
            "classification_results": {"x": 1}, "system_scores": {"A": 1}}))
    assert [r.dataset_id for r in tables.run_summaries(spark, str(tmp_path)).collect()] == ["a"]


def test_joined_study(spark):
    info = spark.createDataFrame([("s1", "x"), ("s2", None), ("s3", "y")], "sample_id string, group string")
    go = spark.createDataFrame([("s1", 1.0), ("s3", None)], "sample_id string, f double")
    sy = spark.createDataFrame([("s1", 2.0), ("s2", 1.0), ("s3", 3.0)], "sample_id string, A double")
    assert {tuple(r) for r in tables.joined_study(info, go, sy).collect()} == {("s1", "x", 1.0, 2.0), ("s3", "y", 0.0, 3.0)}
    with pytest.raises(ValueError):
        tables.joined_study(info.drop("group"), go, sy)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A"), (2, "B")], "id int, key string")
    rows.write.parquet(str(tmp_path / "t"))
    more = spark.createDataFrame([(2, "B"), (3, "A"), (3, "A")], "id int, key string")
    assert sinks.append_new(more, str(tmp_path / "t"), "id") == 1
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]
    sinks.write_by_key(rows, str(tmp_path / "k"), "key", batch_rows=1)
    assert sorted(p.name for p in (tmp_path / "k").iterdir() if p.is_dir()) == ["key=A", "key=B"]
    sinks.write_csv(rows, str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c"), "id int, key string")
    assert sinks.check_export(back, ["id", "key"], "id").first().valid
    sinks.run_metric(spark, str(tmp_path / "m"), "score", "ok", 2, 0.5)
    assert spark.read.parquet(str(tmp_path / "m")).first().step == "score"
    kept, archived = move_to_archive(rows.select(F.col("key").alias("dataset_id")), "A", "no data")
    assert [r.dataset_id for r in kept.collect()] == ["B"] and archived.first().remove_reason == "no data"


def test_byte_order_mark(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("﻿dataset_id,name\nD1,x\n".encode())
    row = tables.read_csv(spark, str(tmp_path / "b.csv"), "dataset_id string, name string").first()
    assert (row.dataset_id, row.name) == ("D1", "x")


def test_many_matrices_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.txt").write_text('!x\n!series_matrix_table_begin\n"PROBE_ID"\t"S1"\nA\t1\n!series_matrix_table_end\nother\t5\n')
    (tmp_path / "b.txt").write_text('"strange name"\t"S2"\nA\t2\n')
    got = {(r.file[-5:], r.feature, r["sample"], r.value) for r in mx.matrix_values(mx.read_lines(spark, str(tmp_path / "*.txt"))).collect()}
    assert got == {("a.txt", "A", "S1", 1.0), ("b.txt", "A", "S2", 2.0)}


def test_many_platforms(spark, tmp_path):
    (tmp_path / "a.txt").write_text("!platform_table_begin\nID\tGene Symbol\tNote\n1_at\tTP53\n2_at\tMYC\tx\ty\n!platform_table_end\n!sample_table_begin\nID_REF\tVALUE\tz\n7\t8\t9\n")
    (tmp_path / "b.txt").write_text("#c\nPROBE_ID\tname\tSYMBOL\np1\tn\tBRCA1\n")
    got = {(r.file[-5:], r.feature, r.target) for r in pf.platform_map(mx.read_lines(spark, str(tmp_path / "*.txt"))).collect()}
    assert got == {("a.txt", "1_at", "TP53"), ("b.txt", "p1", "BRCA1")}
    labels = "".join(f"id{i}\t{'control' if i % 2 else 'G' + str(i)}\n" for i in range(20))
    (tmp_path / "c.tsv").write_text("ID\tSPOT_ID\n" + labels)
    lines = mx.read_lines(spark, str(tmp_path / "c.tsv"))
    assert pf.symbol_columns(pf.platform_tables(lines)).first().symbol is None
    with pytest.raises(ValueError):
        pf.platform_map_all(lines)


def test_line_numbers_over_many_splits(spark, tmp_path):
    """Files cut into splits of a few hundred bytes keep the order of their lines, and with it markers and header."""
    rows = [f'"p{k}"\t{k}\t{k + 1}\t{k + 2}' for k in range(300)]
    for name, trailer in (("a", 'trailer\t9\t9\t9\n'), ("b", "")):
        (tmp_path / f"{name}.txt").write_text("!Series_title\t\"x\"\njunk before the table\n!series_matrix_table_begin\n\"ID_REF\"\t\"S1\"\t\"S2\"\t\"S3\"\n"
                                              + "\n".join(rows) + "\n!series_matrix_table_end\n" + trailer)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = mx.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        for name in ("a", "b"):
            got = [r.line for r in lines.filter(F.col("file").endswith(f"/{name}.txt")).orderBy("line_no").collect()]
            assert got == (tmp_path / f"{name}.txt").read_text().splitlines()
        numbers = [r.line_no for r in lines.filter(F.col("file").endswith("/a.txt")).orderBy("line_no").collect()]
        assert numbers == list(range(306))
        values = mx.matrix_values(lines).collect()
        assert len(values) == 2 * 900 and {r.sample for r in values} == {"S1", "S2", "S3"} and {r.feature for r in values} == {f"p{k}" for k in range(300)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_bad_platform_file_does_not_stop_the_others(spark):
    lines = spark.createDataFrame([("good", 0, "ID\tGene Symbol"), ("good", 1, "1\tTP53"), ("bad", 0, "ID\tLocus"), ("bad", 1, "2\t77"), ("none", 0, "!nothing")],
                                  "file string, line_no long, line string")
    assert [tuple(r) for r in pf.platform_map(lines).collect()] == [("good", "1", "TP53")]
    got = {r.file: (r.usable, r.reason) for r in pf.platform_verdicts(lines).collect()}
    assert got == {"good": (True, "ok"), "bad": (False, "no_symbol_column"), "none": (False, "no_table")}
