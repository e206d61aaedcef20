"""What a Python worker holds, and what the pipeline's stages shuffle."""

import tracemalloc
import weakref

import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

import corpus_pipeline
from pricelens.llm import common, near_dedup, quality_rules


class Held:
    def __init__(self):
        self.me = self  # as a tokenizer and its table of known words refer to each other


def task_of(monkeypatch, make):
    """The function that make() gives to the tasks."""
    caught, given = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **b: caught.append(f) or given(self, f, *a, **b))
    make()
    return caught[0]


@pytest.mark.parametrize("stage", [quality_rules.features, near_dedup.signatures])
def test_other_stages_give_the_tokenizer_back(spark, monkeypatch, stage):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    run = task_of(monkeypatch, lambda: stage(docs))
    held = weakref.ref(common.in_worker("tokenizer of the stage before", Held))
    assert sum(b.num_rows for b in run(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})]))) == 1
    assert held() is None


def test_strings_of_a_slice_alone(spark, monkeypatch):
    """A batch's texts are Python strings a slice at a time; slices keep the rows in order."""
    texts = [None, ""] + [chr(97 + i % 26) * (1 << 18) for i in range(128)]
    docs = spark.createDataFrame([("x",)], "text string")
    run = task_of(monkeypatch, lambda: common.with_columns(docs, lambda ts: [[len(t or "") for t in ts]], "n long"))
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    tracemalloc.start()
    try:
        n = [x for b in run(iter([batch])) for x in b.column(1).to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == [len(t or "") for t in texts] and peak < 8 << 20, peak  # all of them take 32 MB


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Rows are not shuffled to look up few ids; beyond the limit they are, with the same rows."""
    docs = corpus_pipeline.common.table(spark, "/root/testdata/sf0.001", "documents").where("text is not null")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = corpus_pipeline.near_duplicates(spark, docs, "")
        assert "BroadcastHashJoin [_id" in near._jdf.queryExecution().toString()
        monkeypatch.setattr(near_dedup, "FEW", 0)
        other = corpus_pipeline.near_duplicates(spark, docs, "")
        assert "BroadcastHashJoin [_id" not in other._jdf.queryExecution().toString()
        assert sorted(near.collect(), key=str) == sorted(other.collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
