from collections import defaultdict

import corpus_pipeline
from tallyloom.llm import quality


def test_stages_on_odd_documents(spark, odd_docs, no_docs, tmp_path):
    for start in (odd_docs, no_docs):
        docs = start.drop("kept", "fingerprint")
        columns = docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs
            out = stage(spark, docs, "")
            path = f"{tmp_path}/{start.count()}-{k}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if name == "quality_rules":
                want = sorted(repr(tuple(r)) for r in before.collect() if quality.report(r.text)[-1])
                assert sorted(repr(tuple(r)) for r in docs.collect()) == want
            if name == "secret_scan":
                assert docs.count() == before.count()
                assert not docs.where("text LIKE '%hunter2%' OR text LIKE '%AKIA%'").count()
                assert not docs.where("n_chars != length(text)").count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
        filled = defaultdict(list)
        for r in docs.collect():
            filled[r.sequence_id].append((r.offset, r.length))
        for places in filled.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        assert bool(filled) == (start is odd_docs)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "piece", "ids", "sequence_id", "offset"} <= set(out.columns)
