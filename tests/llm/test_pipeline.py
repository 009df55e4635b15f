"""The pipeline on the smallest driver tables, stage by stage."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_stages(spark):
    import corpus_pipeline as cp
    from trialweave.llm.common import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, step in cp.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), "test-stage")
        assert docs.columns == columns, name
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.6 * len(ids)
        ids = now
    last = cp.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.collect()} <= ids
