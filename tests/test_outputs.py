import json

from citegraph.operators import outputs
from citegraph.operators.indicators import paper_entities
from conftest import as_set

PLACES = [(1, "A"), (2, "B"), (3, ""), (4, None), (5, "C")]


def graph(make):
    return {
        "places": make("affiliation_id long, country string", *PLACES),
        "links": make("affiliation_id long, author_id long, paper_id long", (2, 1, 1), (1, 2, 1), (5, 1, 2), (3, 1, 3),
                      (4, 1, 3), (None, 3, 2)),
        "papers": make("id long, year string, date string, original_title string, abstract string, citations int",
                       (1, "2015", "2015-02-03", "One", "text", 5), (2, "2012", "2012-01-01", "Two", "text", 7),
                       (3, "2015", "2015-12-31", "Three", None, None), (4, "2016", "2016-01-01", "Four", "x", 1)),
        "tags": make("paper_id long, field_of_study_id long", (1, 10), (1, 11), (2, 10), (3, 10)),
        "fos": make("id long, name string", (10, "ten"), (11, "eleven"), (12, "twelve")),
    }


def test_all_metrics_need_every_indicator(make):
    key = "year string, entity string, field_of_study_id long"
    rd = make(f"shannon_diversity double, {key}", (1.0, "2015", "A", 10), (2.0, "2015", None, 10), (3.0, "2015", "B", 10))
    rca = make(f"rca_sum double, {key}", (0.5, "2015", "A", 10), (0.5, "2015", "B", 11))
    gd = make(f"female_share double, {key}", (0.25, "2015", "A", 10), (0.5, "2015", "B", 10))
    metrics = outputs.all_metrics(rd, rca, gd, make("id long, name string", (10, "ten")))
    assert as_set(metrics) == {("2015", "A", 1.0, 10, 0.5, 0.25, "ten")}


def test_a_paper_counts_for_one_country(make):
    g = graph(make)
    assert as_set(outputs.credited_country(g["links"], g["places"])) == {(1, "A"), (2, "C")}
    metrics = make("year string, country string, shannon_diversity double, field_of_study_id long, rca_sum double, "
                   "female_share double, name string",
                   ("2015", "A", 1.0, 10, 2.0, 0.5, "ten"), ("2015", "B", 1.0, 10, 2.0, 0.5, "ten"))
    cells = outputs.country_topic_outputs(g["papers"], g["tags"], g["links"], g["places"], metrics)
    assert as_set(cells) == {("A", 10, "2015", 1, 5, "ten", 1.0, 2.0, 0.5)}


def test_paper_lists(make):
    g = graph(make)
    assert as_set(outputs.papers_by_country(paper_entities(g["places"], g["links"]))) == {("A", 1), ("B", 1), ("C", 2)}
    years = outputs.papers_by_year(g["papers"])
    assert as_set(years) == {("2015", 1), ("2015", 3), ("2016", 4)}
    assert as_set(outputs.list_counts(years, "year")) == {("2015", 2), ("2016", 1)}
    chosen = make("field_of_study_id long", (10,), (12,), (10,))
    topics = outputs.papers_by_topic(g["tags"], chosen, g["fos"])
    assert as_set(topics) == {(10, "ten", 1), (10, "ten", 2), (10, "ten", 3), (12, "twelve", None)}
    assert as_set(outputs.list_counts(topics, "field_of_study_id")) == {(10, 3), (12, 0)}
    names = outputs.topics_by_paper(g["tags"], make("field_of_study_id long", (10,), (11,)), g["fos"])
    assert {(r["id"], tuple(r["field_of_study"])) for r in names.collect()} == {
        (1, ("eleven", "ten")), (2, ("ten",)), (3, ("ten",))}


def test_flat_export(make):
    g = graph(make)
    vectors = make("id long, vector_3d array<double>, citations int", (1, [1.0, 2.0, 3.0], 5), (4, [0.0, 0.0, 0.0], 1))
    topics = outputs.paper_topic_names(g["tags"], make("field_of_study_id long", (10,), (11,)), g["fos"])
    countries = outputs.papers_by_country(paper_entities(g["places"], g["links"]))
    flat = outputs.flat_export(vectors, g["papers"], topics, countries)
    assert {(r["id"], tuple(r["vector_3d"]), r["citations"], r["year"], r["field_of_study"], r["country"])
            for r in flat.collect()} == {
        (1, (1.0, 2.0, 3.0), 5, "2015", topic, country) for topic in ("ten", "eleven") for country in "AB"}


def test_search_documents(make, tmp_path):
    g = graph(make)
    authors = make("id long, name string", (1, "Ann"), (2, "Bob"))
    affiliation = make("id long, affiliation string", (1, "aff one"), (2, "aff two"))
    people = outputs.search_authors(g["links"], authors, affiliation)
    outputs.write_search_documents(outputs.search_documents(g["papers"], g["tags"], g["fos"], people), str(tmp_path / "docs"))
    landed = [json.loads(line) for part in (tmp_path / "docs").glob("part-*") for line in part.read_text().splitlines()]
    # Paper 3 has no abstract, paper 4 no topic.
    assert sorted(landed, key=lambda d: d["id"]) == [
        {"id": 1, "year": 2015, "publication_date": "2015-02-03", "original_title": "One", "abstract": "text",
         "citations": 5, "fields_of_study": [{"name": "eleven", "id": 11}, {"name": "ten", "id": 10}],
         "authors": [{"author_id": 1, "name": "Ann", "affiliation": "aff two"}, {"author_id": 2, "name": "Bob", "affiliation": "aff one"}]},
        {"id": 2, "year": 2012, "publication_date": "2012-01-01", "original_title": "Two", "abstract": "text",
         "citations": 7, "fields_of_study": [{"name": "ten", "id": 10}],
         "authors": [{"author_id": 1, "name": "Ann", "affiliation": ""}]},
    ]
    nobody = outputs.search_documents(g["papers"], g["tags"], g["fos"], people.limit(0))
    assert {(r["id"], len(r["authors"])) for r in nobody.collect()} == {(1, 0), (2, 0)}
    # Author 3 is unknown, affiliation 5 has no name.
    assert as_set(people) == {
        (1, 1, "Ann", "aff two"), (1, 2, "Bob", "aff one"), (2, 1, "Ann", ""), (3, 1, "Ann", "")}
