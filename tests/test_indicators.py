import math
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citegraph.operators import indicators
from conftest import as_set

FACT = "field_of_study_id long, country string, paper_id long, citations int, year string"
GOLDEN = [(123, "UK", 1, 10, "2018"), (13, "UK", 2, 2, "2018"), (13, "US", 3, 7, "2018"), (123, "US", 4, 78, "2018"),
          (123, "US", 5, 32, "2018"), (123, "AU", 6, 1, "2018")]


def cell(df, topic, name):
    rows = df.filter(F.col("field_of_study_id") == topic).collect()
    return {(r["entity"], r["year"]): round(r[name], 6) for r in rows}


def test_rca_golden(make):
    fact = make(FACT, *GOLDEN)
    by_sum = indicators.rca_by_sum(fact, "country", paper_thresh=1, year_thresh="2013")
    assert cell(by_sum, 13, "rca_sum") == {("UK", "2018"): 2.407407, ("US", "2018"): 0.864198}
    by_count = indicators.rca_by_count(fact, "country", paper_thresh=1, year_thresh="2013")
    assert cell(by_count, 13, "rca_count") == {("UK", "2018"): 1.5, ("US", "2018"): 1.0}


def test_rca_thresholds(make):
    fact = make(FACT, *GOLDEN)
    # At least two papers on the topic (inclusive), more than two citations in all (strict).
    rows = indicators.rca_by_sum(fact, "country", paper_thresh=2, year_thresh="2013")
    assert as_set(rows.select("entity", "field_of_study_id")) == {("US", 123)}
    assert indicators.rca_by_sum(fact, "country", paper_thresh=1, year_thresh="2018").count() == 0
    # AU has a single citation: not more than one.
    assert "AU" not in {r["entity"] for r in indicators.rca_by_sum(fact, "country", paper_thresh=1).collect()}


def test_null_country_counts_in_the_world_only(make):
    fact = make(FACT, (1, "A", 1, 10, "2018"), (2, "A", 2, 10, "2018"), (1, None, 3, 20, "2018"))
    rca = indicators.rca_by_sum(fact, "country", paper_thresh=1, year_thresh="2013")
    # A: (10/20) / (30/40) on topic 1.
    assert cell(rca, 1, "rca_sum") == {("A", "2018"): round(0.5 / 0.75, 6)}
    assert cell(rca, 2, "rca_sum") == {("A", "2018"): round(0.5 / 0.25, 6)}


def test_rca_is_capped_and_survives_zero_citations(make):
    fact = make(FACT, (1, "A", 1, 100, "2018"), (2, "B", 2, 5000, "2018"), (3, "A", 3, 0, "2018"))
    rca = indicators.rca_by_sum(fact, "country", paper_thresh=1, year_thresh="2013")
    assert cell(rca, 1, "rca_sum") == {("A", "2018"): 6.0}
    assert cell(rca, 3, "rca_sum") == {}


def shannon(counts):
    total = sum(counts)
    return -sum(c / total * math.log2(c / total) for c in counts if c)


def indices(make, counts):
    df = make("g int, c int, n int", *[(1, i, n) for i, n in enumerate(counts)])
    return indicators.diversity(df, ["g"], "c", count_col="n").first()


def test_diversity_golden(make):
    assert indices(make, [5])["dominance"] == 1 and indices(make, [5])["shannon"] == 0
    assert indices(make, [5])["simpson"] == 0
    assert indices(make, [5, 5])["shannon"] == pytest.approx(1)
    assert indices(make, [1, 1, 1, 1, 0])["shannon"] == pytest.approx(2)
    assert indices(make, [1, 0, 2, 5, 2])["simpson"] == pytest.approx(0.66)
    assert indices(make, [4, 3, 4, 0, 1, 0, 2])["observed"] == 5
    assert indices(make, [0, 1, 1, 4, 2, 5, 2, 4, 1, 2])["observed"] == 9
    assert indices(make, [7] * 6)["enspie"] == pytest.approx(6)
    assert indices(make, [13] * 4)["enspie"] == pytest.approx(4)
    empty = indices(make, [0, 0, 0])
    assert empty["observed"] == 0 and empty["shannon"] is None and empty["simpson_e"] is None


def test_diversity_rejects_bad_counts(make):
    with pytest.raises(ValueError):
        indicators.diversity(make("g int, c int, n double", (1, 1, 0.5)), ["g"], "c", count_col="n")
    with pytest.raises(Exception, match="negative"):
        indices(make, [1, -1])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 40), min_size=1, max_size=12).filter(sum))
def test_diversity_properties(make, counts):
    row = indices(make, counts)
    total, observed = sum(counts), sum(c > 0 for c in counts)
    dominance = sum((c / total) ** 2 for c in counts)
    assert row["dominance"] == pytest.approx(dominance) and row["simpson"] == pytest.approx(1 - dominance)
    assert row["shannon"] == pytest.approx(shannon(counts), abs=1e-9)
    assert 0 <= row["shannon"] <= math.log2(observed) + 1e-9
    assert 0 < row["simpson_e"] <= 1 + 1e-9


def test_research_diversity(make):
    places = make("affiliation_id long, country string", (1, "A"), (2, ""), (3, None), (4, "A"))
    links = make("affiliation_id long, author_id long, paper_id long", (1, 1, 1), (4, 2, 1), (1, 1, 2), (2, 1, 3),
                 (3, 1, 4), (1, 1, 5))
    papers = make("id long, year string, citations int", *[(i, "2015", 1) for i in range(1, 5)], (5, "2014", 1))
    tags = make("paper_id long, field_of_study_id long", (1, 11), (1, 12), (2, 11), (3, 11), (4, 11), (5, 12))
    closure = make("field_of_study_id long, descendant long", (9, 9), (9, 11), (9, 12))
    rows = indicators.research_diversity(indicators.paper_entities(places, links), papers, tags, closure, fos_thresh=2, year_thresh="2015")
    (row,) = rows.collect()
    assert (row["year"], row["entity"], row["field_of_study_id"]) == ("2015", "A", 9)
    assert row["shannon_diversity"] == pytest.approx(shannon([2, 1]))
    assert row["simpson_diversity"] == pytest.approx(1 - 5 / 9)
    assert row["simpson_e_diversity"] == pytest.approx(9 / 5 / 2)
    # Three (topic, paper) pairs are not more than three; "2014" is included by the inclusive threshold.
    assert indicators.research_diversity(indicators.paper_entities(places, links), papers, tags, closure, 3, "2015").count() == 0
    assert indicators.research_diversity(indicators.paper_entities(places, links), papers, tags, closure, 0, "2014").count() == 2


def test_female_share(make):
    links = make("affiliation_id long, author_id long, paper_id long", (1, 1, 1), (2, 1, 1), (1, 2, 1), (1, 2, 2),
                 (1, 2, 3), (1, 3, 3), (1, 4, 4), (1, 5, 5))
    gender = make("id long, gender string, probability double", (1, "female", 0.7), (2, "male", 0.9),
                  (3, "unknown", 0.9), (4, "female", 0.69), (5, "unknown", 1.0))
    share = indicators.paper_female_share(links, gender)
    # Two affiliations count twice; male + unknown has no share; an uncertain author is not seen at all.
    assert as_set(share) == {(1, 2 / 3), (2, 0.0)}


def test_gender_diversity_uses_direct_tags(make):
    places = make("affiliation_id long, country string", (1, "A"), (2, "A"), (3, ""))
    links = make("affiliation_id long, author_id long, paper_id long", (1, 1, 1), (2, 1, 1), (1, 1, 2), (1, 1, 3),
                 (3, 1, 4))
    papers = make("id long, year string, citations int", *[(i, "1990", 1) for i in range(1, 5)])
    tags = make("paper_id long, field_of_study_id long", (1, 9), (2, 9), (3, 10), (4, 9))
    share = make("paper_id long, female_share double", (1, 1.0), (2, 0.0), (3, 0.0), (4, 1.0))
    topics = make("field_of_study_id long", (9,))
    rows = indicators.gender_diversity(indicators.paper_entities(places, links), papers, tags, share, topics, paper_thresh=1)
    assert as_set(rows) == {(0.5, "1990", "A", 9)}
    closure = make("field_of_study_id long, descendant long", (9, 9), (9, 10))
    rows = indicators.gender_diversity(indicators.paper_entities(places, links), papers, tags, share, topics, 1, closure)
    assert [round(r["female_share"], 6) for r in rows.collect()] == [0.333333]


def collaboration(make, sets):
    names = sorted({c for s in sets for c in s if c})
    ids = {c: i for i, c in enumerate(names)}
    places = make("affiliation_id long, country string", *[(i, c) for c, i in ids.items()], (90, ""), (91, None))
    links = [(ids[c], 1, p) for p, s in enumerate(sets) for c in s] + [(90, 1, p) for p in range(len(sets))]
    papers = make("id long, year string", *[(p, "2015") for p in range(len(sets))])
    linked = make("affiliation_id long, author_id long, paper_id long", *links, (91, 1, 0))
    rows = indicators.country_collaboration(indicators.paper_entities(places, linked), papers, "2013")
    return {(r["country_a"], r["country_b"]): r["weight"] for r in rows.collect()}


def test_collaboration_golden(make):
    assert collaboration(make, [["a", "b"], ["a", "b", "c"]]) == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=8), min_size=1, max_size=20))
def test_collaboration_equals_brute_force(make, sets):
    expected = Counter(pair for s in sets for pair in combinations(sorted(set(s)), 2))
    assert collaboration(make, sets) == dict(expected)


def test_one_paper_with_most_author_rows(spark, make):
    """A paper with a third of all rows weighs as much as its countries."""
    links = spark.range(30000).selectExpr(
        "id % 5 as affiliation_id", "id as author_id", "case when id % 3 = 0 then 1 else id end as paper_id"
    )
    places = make("affiliation_id long, country string", *[(i, f"c{i}") for i in range(5)])
    pairs = indicators.paper_entities(places, links)
    assert pairs.filter("paper_id = 1").count() == 5
    assert pairs.count() == 5 + links.filter("paper_id <> 1").count()
