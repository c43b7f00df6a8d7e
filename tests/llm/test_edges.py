"""Odd rows, an empty table and clashing columns: every query and every stage has a defined result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import CLASHING, odd_rows
from tidemill.llm import queries

ONE_ROW_EACH = [q for q in queries.QUERIES if not q.startswith("op1_")]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(name, spark, odd_dir):
    rows = queries.QUERIES[name](spark, odd_dir).collect()
    if name in ONE_ROW_EACH:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd_rows())
    else:
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd_rows()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_table(name, spark, empty_dir):
    assert queries.QUERIES[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_keeps_other_columns(name, stage, spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    out = stage(spark, docs, odd_dir)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert sorted(out.columns) == sorted(docs.columns)
        assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASHING)
    else:
        assert out.count() >= len(odd_rows())
