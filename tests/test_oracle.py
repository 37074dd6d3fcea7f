"""Every registered query against its SQL, and the shape of the plans."""

import pytest

import __spark_entry__ as entry
from oracle_compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
# The operators of the optional subpackage have tests of their own.
from citegraph.queries.registry import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    count, problem = compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert problem == ""
    assert count


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_the_fact_is_evaluated_once(spark, monkeypatch):
    """What specialisation returns reads stored cells only; the given tables are read by the one job that stores them."""
    plan = QUERIES["country_rca"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


def test_year_filter_and_columns_reach_the_scan(spark, tmp_path):
    from citegraph.operators import indicators
    from citegraph.queries.graph import Graph
    from citegraph.sources.store import Store

    graph, store = Graph(spark, FOLDER), Store(spark, str(tmp_path))
    tables = {"papers": graph.papers, "geocoded_places": graph.places, "author_affiliation": graph.author_affiliation}
    for name, table in tables.items():
        store.refresh(table, name)
    pairs = indicators.paper_entities(store.read("geocoded_places"), store.read("author_affiliation"))
    graph = indicators.country_collaboration(pairs, store.read("papers"), "1996")
    plan = graph._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "abstract" not in plan and "IsNotNull(affiliation_id)" in plan
