"""What grows with the tables: plans that a query must not fall back to."""

from __future__ import annotations

import glob
import re

from pyspark.sql import functions as F

from citegraph.operators import vectors
from citegraph.queries import graph, normalising
from citegraph.queries.graph import Graph
from citegraph.queries.registry import QUERIES
from citegraph.sources import records

import __spark_entry__  # noqa: F401 - registers the queries

FOLDER = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_open_work_asks_for_keys_and_not_for_their_papers(spark):
    read = re.findall(r"ReadSchema: \S+", executed(QUERIES["not_yet_processed"](spark, FOLDER)))
    assert any("l_partkey" in columns for columns in read) and not any("l_orderkey" in columns for columns in read)


def test_keys_in_use_are_those_of_the_links(spark):
    g = Graph(spark, FOLDER)
    for keys, links, name in ((g.used_topics, g.paper_fos, "field_of_study_id"), (g.published_authors, g.paper_authors, "author_id")):
        found = [row[0] for row in keys.select(name).collect()]
        assert len(found) == len(set(found))
        assert set(found) == {row[0] for row in links.select(name).distinct().collect()}


def test_merged_tables_put_the_records_together_once(spark):
    plan = executed(QUERIES["merged_tables"](spark, FOLDER))
    assert "lineitem.parquet" not in plan and "orders.parquet" not in plan


def test_more_links_are_dealt_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINKS_PER_TASK", 100)
    links = Graph(spark, FOLDER).table("lineitem").count()
    plan = executed(QUERIES["diversity_indices"](spark, FOLDER))
    assert "hashpartitioning(author_id" in plan and f", {-(-links // 100)})" in plan


def test_landed_records_are_compressed_and_whole(spark, make, tmp_path):
    folder = str(tmp_path / "landed")
    records.write_records(make("Id long, DOI string, ordinal long", (1, "a", 1), (2, None, 2)), folder)
    assert glob.glob(f"{folder}/*.json.gz") and not glob.glob(f"{folder}/*.json")
    assert {(row.Id, row.DOI) for row in records.read_records(spark, folder).collect()} == {(1, "a"), (2, None)}


def test_words_are_sorted_without_a_comparison_lambda(spark):
    assert "array_sort(" not in optimized(Graph(spark, FOLDER).inverted_index)
    tokens = spark.range(1).select(vectors.term_counts(F.split(F.lit("b a b"), " ")).alias("terms"))
    assert tokens.first().terms == [("a", 1), ("b", 2)]
    texts = Graph(spark, FOLDER).table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("abstract"))
    assert "array_sort(" not in optimized(vectors._counted(texts, "id", "abstract"))


def test_names_are_cleaned_once_for_each_author(spark):
    plan = executed(QUERIES["infer_gender"](spark, FOLDER))
    assert "customer.parquet" not in plan and "regexp_replace" not in plan


def test_only_links_without_a_parent_become_distinct(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(normalising.store, "foreign_key_violations", lambda child, *rest: asked.append(child) or child.limit(0))
    QUERIES["foreign_keys"](spark, FOLDER)
    plans = [child._jdf.queryExecution().analyzed().toString() for child in asked if "lineitem.parquet" in child.inputFiles()[0]]
    assert len(plans) >= 7 and not any(re.search(r"Distinct|Deduplicate|Aggregate \[(paper|affiliation)_id", plan) for plan in plans)


def test_violating_links_count_once(spark, tmp_path):
    for name in ("nation", "part", "orders", "lineitem", "supplier", "customer", "documents"):
        table = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        # Links occur twice; some papers, topics and affiliations have no row of their own.
        table = table.unionByName(table) if name == "lineitem" else table
        table = table.filter("o_orderkey % 3 > 0") if name == "orders" else table.filter("s_suppkey % 2 = 0") if name == "supplier" else table
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    g = Graph(spark, str(tmp_path))
    found = {r.reference: r.n for r in QUERIES["foreign_keys"](spark, str(tmp_path)).collect()}
    no_paper = lambda df: df.join(g.paper_attributes, df["paper_id"] == F.col("id"), "left_anti").count()
    assert found["paper_authors.paper_id"] == no_paper(g.paper_authors) > 0
    assert found["author_affiliation.paper_id"] == no_paper(g.author_affiliation) > 0
    assert found["paper_fields_of_study.paper_id"] == no_paper(g.paper_fos) > 0
    none = g.author_affiliation.join(g.affiliation, F.col("affiliation_id") == F.col("id"), "left_anti").count()
    assert found["author_affiliation.affiliation_id"] == none > 0


def test_outputs_read_the_stored_topics_and_no_distinct_authorships(spark):
    plan = executed(QUERIES["country_topic_outputs"](spark, FOLDER))
    assert "part.parquet" not in plan
    assert not any("l_partkey" in columns for columns in re.findall(r"ReadSchema: \S+", plan))
