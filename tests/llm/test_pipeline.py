from __future__ import annotations

import corpus_pipeline
from tests.llm.test_secret_scan import base
from tests.llm.test_shingle_dedup import brute
from versemill.llm import decontaminate, quality


def test_stages(spark, sf, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "packing"]
    one = corpus_pipeline.quality_rules(spark, docs, sf)
    weights = quality.fit_ratio(docs, spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"))
    assert {r.doc_id for r in one.collect()} == {
        r.doc_id for r in quality.assess(docs, weights).select("row.doc_id", "kept").collect() if r.kept
    }
    two = corpus_pipeline.near_dedup(spark, one, sf)
    groups = brute([(r.doc_id, r.text) for r in one.collect()])
    assert {str(r.doc_id) for r in two.collect()} == {least for _, least in groups}
    three = corpus_pipeline.benchmark_decontamination(spark, two, sf)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    held = {r.doc_id for r in decontaminate.leaks(two, bench).collect()}
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - held
    four = corpus_pipeline.secret_scans(spark, three, sf)
    before = {r.doc_id: r.text for r in three.collect()}
    for r in four.collect():
        assert (r.text == before[r.doc_id]) or base(before[r.doc_id]) or "[REDACTED]" in r.text
    for stage in (one, two, three, four):
        assert stage.columns == docs.columns
    five = corpus_pipeline.pack(spark, four, sf)
    assert {r.doc_id for r in five.select("doc_id").collect()} == set(before)
