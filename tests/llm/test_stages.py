"""Stages that keep whole rows: clashing columns, and what they shuffle."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citegraph.llm import common, contamination, near

FOLDER = "/root/testdata/sf0.001"
CLASHING = {"n_words": "mine", "n_hit": "mine", "contaminated": "mine", "row": "mine", "kept_one": "mine", "doc": "mine", "hash": "mine"}


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark):
    body = " ".join(f"w{i}" for i in range(40))
    texts = [(1, body), (2, body + " tail"), (2, body + " tail"), (3, "alone in the world of words"), (None, None), (4, ""), (5, "benchmark passage here")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})


def test_a_text_is_in_no_exchange_of_the_decontamination_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.contamination_stage(spark, docs, FOLDER)
    plan = executed(out)
    assert "Exchange" in plan and not re.search(r"(?<!Broadcast)Exchange hash", plan)
    kept = {r.doc_id for r in out.collect()}
    found = contamination.find_contamination(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    assert kept == {r.doc_id for r in found.filter("not contaminated").collect()} and len(kept) < docs.count()


@pytest.mark.parametrize("sent", [500_000, -1])
def test_rows_that_stay_keep_their_columns(spark, monkeypatch, sent):
    monkeypatch.setattr(common, "SENT_KEYS", sent)
    docs = rows(spark)
    items = spark.createDataFrame([("i", "benchmark passage here")], "item_id string, text string")
    out = contamination.drop_contaminated(docs, items)
    assert out.dtypes == docs.dtypes
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.filter("doc_id is null or doc_id <> 5").collect()))
    one = near.drop_near_duplicates(docs)
    assert one.dtypes == docs.dtypes and all(r.n_words == "mine" and r["row"] == "mine" for r in one.collect())
    assert sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 3, 4, 5]
    # Of repeated rows one stays, the smaller key of each group wins.
    alone = near.drop_near_duplicates(docs.filter("doc_id = 2"))
    assert alone.count() == 1


def test_no_text_is_shuffled_to_drop_near_duplicates(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = executed(near.drop_near_duplicates(docs))
    assert not re.search(r"(?<!Broadcast)Exchange hash", plan)


def test_a_core_has_one_python_worker_in_the_piece_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.piece_stage(spark, docs, FOLDER)
    assert len(re.findall("ArrowEvalPython", out._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert [(r.doc_id, r.round_trip) for r in out.orderBy("doc_id").collect()] == [(r.doc_id, True) for r in docs.orderBy("doc_id").collect()]
