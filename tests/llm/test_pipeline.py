"""Pipeline stages against the operators' own answers, by brute force where that is short."""

import corpus_pipeline
from lectern.llm import decontaminate, knn_quality, sharding


def test_stages_on_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == columns
        kept[name] = [r.doc_id for r in out.collect()]
        if name == "quality_classifier":
            good = {r.doc_id for r in knn_quality.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
            assert set(kept[name]) == good
        if name == "benchmark_decontamination":
            before = decontaminate.scan(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
            assert set(kept[name]) == {r.doc_id for r in before.where("NOT contaminated").collect()}
        docs = out
    last = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert last.count() == len(kept["mixing"])
    assert set(sharding.ADDED) <= set(last.columns)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0


def test_odd_rows(spark, odd, none, benchmark, labels, tmp_path):
    for name, df in (("benchmark", benchmark), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        docs.collect()
