"""Stages against what their operators promise, and the entries of the text queries."""

import corpus_pipeline
from tidemark.llm import queries


def test_stages_keep_columns_and_take_effect(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, "").cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and 0 < out.count() <= now.count(), name
        assert out.where("text is not null and n_chars <> char_length(text)").count() == 0
        now = out
    ids = {r.doc_id for r in now.collect()}
    assert not ids & {4, 5, 6, 7, 16} and 1 in ids and 2 not in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids


def test_stages_on_an_empty_table(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where("offset + length > 1024").count() == 0


def test_ten_queries():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)] and set(queries.oracle_sql()) <= set(queries.queries())
