"""The pipeline's stages on the smallest tables and on odd rows."""

import corpus_pipeline
from quillstone.llm.queries import QUERIES

from .conftest import LONG


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, d)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes), name
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids and ids <= {r["doc_id"] for r in before.select("doc_id").collect()}, name
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, d).select("doc_id").distinct().count()
    assert pieces == before.count()


def test_run_gives_what_the_stages_give(spark):
    d = "/root/testdata/sf0.001"
    packed = corpus_pipeline.run(spark, d)
    assert packed.columns == QUERIES["op5_packing"](spark, d).columns and packed.count() > 0


def test_odd_rows_go_through(spark, odd, none):
    d = "/root/testdata/sf0.001"
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, d)
    kept = {r["text"] for r in corpus_pipeline.mask_personal(spark, odd, d).collect()}
    assert LONG in kept and None in kept
