import importlib

import pytest
from helpers import documents, with_clashes

import corpus_pipeline
from thali.llm.common import table, written
from thali.llm.queries import ORACLE_SQL, QUERIES


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "repeat_dedup", "packing"]
    entry = importlib.import_module("__spark_entry__")
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


def test_every_stage_works_on_what_is_left(spark):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = written(stage(spark, docs, folder))
        assert docs.columns == columns
        after = docs.count()
        assert 0 < after <= before
        assert (name != "repeat_dedup") or after == before
        before = after
    packed = corpus_pipeline.run(spark, folder)
    assert packed.select("doc_id").distinct().count() == before
    assert packed.filter("start = 0").agg({"doc_tokens": "sum"}).first()[0] == packed.agg({"length": "sum"}).first()[0]


@pytest.mark.parametrize("rows", [None, []])
def test_odd_rows_and_empty_tables(spark, rows):
    docs = with_clashes(documents(spark) if rows is None else documents(spark, rows))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() <= 2 * docs.count() + 10
        if stage is not corpus_pipeline.pack:
            assert out.columns == docs.columns
