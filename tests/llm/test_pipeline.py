"""The pipeline's stages keep what they should and hand on the columns of documents."""

from __future__ import annotations

import corpus_pipeline
from glyphmill.llm import decontam


def test_stages(spark, sf, tmp_path):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert out.columns == columns
        assert out.select("doc_id").distinct().count() == out.count() <= docs.count()
        seen[name] = docs = out
    texts = [r["text"].lower() for r in seen["exact_dedup"].select("text").collect()]
    assert len(set(texts)) == len(texts)
    items = [decontam.shingles(decontam.words(r["text"]), 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in seen["decontamination"].collect():
        own = decontam.shingles(decontam.words(r["text"]), 5)
        assert not any(len(i & own) >= 0.8 * len(i) for i in items)
    assert seen["bpe"].count() > 0.5 * before
    assert corpus_pipeline.run(spark, sf).count() == seen["bpe"].count()
