from citegraph import config, schemas
from citegraph.operators import enrich
from citegraph.operators.lists import dense_index
from conftest import as_set


def place(**overrides):
    parts = [("441", ["subpremise"]), ("London", ["postal_town"]),
             ("Greater London", ["administrative_area_level_2", "political"]),
             ("England", ["administrative_area_level_1", "political"]), ("United Kingdom", ["country", "political"]),
             ("SE1 0HS", ["postal_code"])]
    result = {
        "address_components": [{"long_name": n, "short_name": n, "types": t} for n, t in parts],
        "formatted_address": "30 Great Guildford St, London", "name": "A Place", "place_id": "abc",
        "geometry": {"location": {"lat": 51.504589, "lng": -0.0970865}}, "types": ["establishment"],
        "website": "https://example.org", **overrides,
    }
    return {"affiliation_id": 5, "result": result}


def test_place_details(make):
    twice = enrich.geocoded_places(make(schemas.PLACE_RESPONSE, place(), place()))
    assert twice.count() == 1
    row = twice.first().asDict()
    assert row == {
        "id": "abc", "affiliation_id": 5, "lat": 51.504589, "lng": -0.0970865, "name": "A Place",
        "address": "30 Great Guildford St, London", "types": ["establishment"], "website": "https://example.org",
        "postal_town": "London", "administrative_area_level_2": "Greater London",
        "administrative_area_level_1": "England", "country": "United Kingdom",
    }
    bare = enrich.geocoded_places(make(schemas.PLACE_RESPONSE, place(website=None, address_components=[]))).first()
    assert bare["website"] is None and bare["country"] is None


def test_name_batches(make):
    authors = [(i, f"Name{i:04d} Surname") for i in range(2400)] + [(9000 + i, "Name0000 Surname") for i in range(40)]
    df = make("id long, name string", *authors, (99999, "A. Nobody"))
    rows = enrich.name_batches(df, 1000).collect()
    names = {}
    for row in rows:
        names.setdefault(row["proc_name"], set()).add(row["id"])
    assert names["Name0000 Surname"] == {0, *range(9000, 9040)} and len(rows) == 2440
    batch = {row["proc_name"]: row["batch_id"] for row in rows}
    assert len(names) == 2400
    assert [batch[f"Name{i:04d} Surname"] for i in (0, 999, 1000, 1999, 2000, 2399)] == [0, 0, 1, 1, 2, 2]


def test_dense_index(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as k")
    rows = dense_index(df, ["k"]).collect()
    assert all(row["k"] == row["position"] for row in rows) and len(rows) == 1000


def test_gender_fan_out(make):
    responses = make(
        schemas.GENDER_RESPONSE,
        (("Foo Bar",), (120,), True, "Foo", 0.9, "female"),
        (("Foo Bar",), (120,), True, "Foo", 0.9, "female"),
        (("Old Name",), (1,), True, "Old", 0.9, "male"),
        (("No Body",), (0,), False, None, None, None),
    )
    names = make("proc_name string, id long, batch_id long",
                 ("Foo Bar", 1, 0), ("Foo Bar", 2, 0), ("Foo Bar", 3, 0), ("Old Name", 4, 0), ("No Body", 5, 0))
    stored = make("full_name string", ("Old Name",))
    found = enrich.author_gender(responses, names, stored)
    assert sorted(found.collect()) == [(i, "Foo Bar", "Foo", "female", 120, 0.9) for i in (1, 2, 3)]
    # The response landed last counts.
    later = make(schemas.GENDER_RESPONSE + ", ordinal int", (("Foo Bar",), (9,), True, "Foo", 0.8, "male", 2),
                 (("Foo Bar",), (120,), True, "Foo", 0.9, "female", 1))
    assert {r["gender"] for r in enrich.author_gender(later, names, stored).collect()} == {"male"}


def test_flags(make):
    affiliations = make("id long, affiliation string", (1, "university of x"), (2, "acme corp"), (3, "old institute"))
    stored = make("id long, non_industry int", (3, 1))
    assert as_set(enrich.affiliation_type(affiliations, stored)) == {(1, 1), (2, 0)}
    assert as_set(enrich.affiliation_type(affiliations, tokens=("corp",))) == {(1, 0), (2, 1), (3, 0)}
    journals = make("id long, journal_name string, paper_id long", (1, "biorxiv", 5), (1, "biorxiv", 6), (2, "nature", 7))
    assert sorted(enrich.open_access_journals(journals).collect()) == [(1, 1), (2, 0)]
    assert as_set(enrich.open_access_journals(journals, ("nature",))) == {(1, 0), (2, 1)}


def test_country_association(make):
    places = make("country string", ("Egypt",), ("Taiwan",), ("Greece",), ("",), (None,), ("Egypt",))
    assert as_set(enrich.country_association(places)) == {
        ("Egypt", "Egypt, Arab Rep."), ("Taiwan", None), ("Greece", "Greece"),
    }
    assert ("Greece", "Hellas") in as_set(enrich.country_association(places, {"Greece": "Hellas"}))
    assert as_set(enrich.country_association(places, {})) == {("Egypt",) * 2, ("Taiwan",) * 2, ("Greece",) * 2}


def country(name):
    return (name, name[:2], name[:3], "capital", "region", "subregion", 10)


def test_country_details(make):
    association = make("google_country string, wb_country string", ("India", "India"), ("Greece", "Greece"),
                       ("Czechia", "Czech Republic"), ("Nowhere", "Nowhere"))
    responses = make(
        schemas.COUNTRY_RESPONSE,
        ("India", [country("British Indian Ocean Territory"), country("India")]),
        ("Greece", [country("Greece"), country("Other")]),
        ("Czech Republic", [country("Czech Republic")]),
    )
    rows = enrich.country_details(responses, association).select("name", "google_name", "wb_name")
    assert as_set(rows) == {
        ("India", "India", "India"), ("Greece", "Greece", "Greece"), ("Czech Republic", "Czechia", "Czech Republic"),
    }


def test_fixed_lists():
    assert len(config.NON_INDUSTRY_TOKENS) == 127 and len(config.OPEN_ACCESS_JOURNALS) == 135
    assert len(config.PLACE_TO_INDICATOR_COUNTRY) == 20 and len(config.PLACE_TO_DETAILS_COUNTRY) == 8
