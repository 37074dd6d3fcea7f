import json

from pyspark.sql import functions as F

from citegraph import schemas
from citegraph.operators import normalise
from citegraph.sources import country_indicators, records, store
from conftest import as_set

RECORD = {
    "logprob": -3.25, "prob": 1.5, "Id": 10, "Ti": "a title", "Pt": "1", "DN": "A Title", "Y": 2017,
    "D": "2017-03-03", "CC": 31, "RId": [5, 6], "DOI": "10.1/x", "PB": "A Publisher", "BT": "a",
    "AA": [
        {"DAuN": "Foo", "AuId": 1, "AfN": "harbour college", "AfId": 7, "S": 1},
        {"DAuN": "Bar", "AuId": 2, "AfId": None, "S": 2},
        {"DAuN": "Baz", "AuId": 3, "AfN": "none", "AfId": 0, "S": 3},
    ],
    "F": [{"DFN": "Tide", "FId": 21}, {"DFN": "Lantern", "FId": 22}],
    "J": {"JN": "river notes", "JId": 31}, "C": {"CN": "foo bar", "CId": 41},
    "IA": {"IndexLength": 3, "InvertedIndex": {"Under": [0], "bridges,": [2], "low": [1]}},
    "S": [{"U": "https://example.org/1"}, {"Ty": 3, "U": "https://example.org/2"}],
}
BARE = {
    "logprob": -1.0, "prob": 0.5, "Id": 11, "Ti": "t", "Pt": "1", "DN": "T", "Y": 2018, "D": "2018-01-01", "CC": 0,
    "AA": [{"DAuN": "Foo later", "AuId": 1, "AfId": None, "S": 1}],
}


def land(path, *files):
    path.mkdir()
    for name, rows in files:
        (path / name).write_text("\n".join(json.dumps(row) for row in rows))
    return str(path)


def test_record_parsers(spark, tmp_path):
    raw = records.read_records(spark, land(tmp_path / "raw", ("a.json", [RECORD, BARE])))
    papers = {row["id"]: row.asDict() for row in normalise.papers(raw).collect()}
    assert papers[10] == {
        "id": 10, "prob": 1.5, "title": "a title", "publication_type": "1", "year": "2017", "date": "2017-03-03",
        "citations": 31, "original_title": "A Title", "references": [5, 6], "doi": "10.1/x",
        "publisher": "A Publisher", "bibtex_doc_type": "a", "abstract": "Under low bridges,",
        "source": "https://example.org/1",
    }
    optional = ("references", "doi", "publisher", "bibtex_doc_type", "abstract", "source")
    assert all(papers[11][name] is None for name in optional)
    assert as_set(normalise.journals(raw)) == {(31, "river notes", 10)}
    assert as_set(normalise.conferences(raw)) == {(41, "foo bar", 10)}
    assert as_set(normalise.paper_authors(raw)) == {(10, 1, 1), (10, 2, 2), (10, 3, 3), (11, 1, 1)}
    assert as_set(normalise.authors(raw)) == {(1, "Foo later"), (2, "Bar"), (3, "Baz")}
    assert as_set(normalise.paper_fields_of_study(raw)) == {(10, 21), (10, 22)}
    assert as_set(normalise.fields_of_study(raw)) == {(21, "Tide"), (22, "Lantern")}
    assert as_set(normalise.affiliations(raw)) == {(7, "harbour college")}
    assert as_set(normalise.author_affiliation(raw)) == {
        (7, 1, 10), (None, 2, 10), (None, 3, 10), (None, 1, 11),
    }


def test_doi_filter_and_array_files(spark, tmp_path):
    folder = tmp_path / "arrays"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([RECORD, BARE]))
    raw = records.read_records(spark, str(folder), with_doi=True, multi_line=True)
    assert [row["Id"] for row in raw.collect()] == [10]


def test_last_record_in_listing_order_wins(spark, tmp_path):
    files = [
        ("dump-10.json", [{**BARE, "CC": 1}, {**BARE, "CC": 2}]),
        ("dump-2.json", [{**BARE, "CC": 3}, {**BARE, "CC": 4}]),
        ("dump-1.json", [{**BARE, "CC": 5}]),
    ]
    raw = records.read_records(spark, land(tmp_path / "raw", *files))
    assert [row["CC"] for row in normalise.latest_per_key(raw, "Id").collect()] == [4]


def test_one_key_with_most_copies(spark):
    raw = spark.range(20000).select(
        F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id")).alias("Id"), F.col("id").alias("CC"),
        F.col("id").alias("ordinal"),
    )
    latest = normalise.latest_per_key(raw, "Id")
    assert latest.filter("Id = 7").first()["CC"] == 19999 - 19999 % 3 + (1 if 19999 % 3 >= 1 else 0)
    assert latest.count() == raw.select("Id").distinct().count()


def test_merge_is_idempotent(make):
    new = make("Id long, v string, ordinal long", (1, "a", 0), (1, "b", 1), (2, "c", 2), (3, "d", 3))
    stored = make("id long", (3,))
    first = normalise.rows_to_append(new, stored, "Id", "id")
    assert as_set(first.select("Id", "v")) == {(1, "b"), (2, "c")}
    again = normalise.rows_to_append(new, stored.union(first.select("Id")), "Id", "id")
    assert again.count() == 0


def test_duplicate_topic_ids_keep_the_last_name(make):
    pairs = [("Biology", 86803240), ("Biofilm", 58123911), ("Bacterial growth", 17741926), ("Bacteria", 523546767),
             ("Agar plate", 62643968), ("Agar", 2778660310), ("Agar", 2778660310), ("Agar foo bar", 2778660310)]
    rows = [{"DFN": name, "FId": id_} for name, id_ in pairs]
    raw = make(f"{schemas.RAW_RECORD}, ordinal long", {"Id": 1, "F": rows, "ordinal": 0})
    topics = normalise.fields_of_study(raw)
    assert topics.count() == 6
    assert topics.filter("id = 2778660310").first()["name"] == "Agar foo bar"


def test_best_match_per_title(make):
    schema = "Id long, Ti string, logprob double, ordinal long"
    golden = make(schema, (1, "test title", 44.0, 0), (2, "test title", 10.0, 1), (3, "another title", 5.0, 2),
                  (4, "another title", 10.0, 3))
    assert as_set(normalise.best_match_per_title(golden)) == {(1,), (4,)}
    tie = make(schema, (9, "t", 1.0, 0), (2, "t", 1.0, 1))
    assert as_set(normalise.best_match_per_title(tie)) == {(9,)}
    unknown = make("Id long, Ti string, logprob double, ordinal int", (1, "a", -5.0, 1), (2, "a", None, 0), (3, "b", None, 2))
    assert as_set(normalise.best_match_per_title(unknown)) == {(1,), (3,)}
    # The last probability of an id counts, at the id's first place.
    repeated = make(schema, (9, "t", 5.0, 0), (2, "t", 3.0, 1), (9, "t", 3.0, 2))
    assert as_set(normalise.best_match_per_title(repeated)) == {(9,)}


def test_topic_hierarchy_keeps_absent_and_empty_apart(make):
    landed = make(schemas.RAW_TOPIC, {"Id": 1, "FL": 1, "FC": [{"FId": 2}, {"FId": 99}, {"FId": 2}], "FP": [{"FId": 98}]},
                  {"Id": 2, "FL": 2}, {"Id": 3, "FL": 0}, {"Id": 50, "FL": 1})
    ours = make("id long, name string", (1, "a"), (2, "b"), (3, "c"))
    stored = make("id long, level int, frequency long", (3, 0, None))
    assert {(r[0], tuple(r[1] or ()) if r[1] is not None else None, tuple(r[2]) if r[2] is not None else None)
            for r in normalise.topic_hierarchy(landed, ours, stored).collect()} == {(1, (2,), ()), (2, None, None)}
    assert as_set(normalise.topic_metadata(landed, ours, stored)) == {(1, 1, None), (2, 2, None)}


def test_indicators(make):
    raw = make("country string, year string, value double", ("A", "2012", 1.0), ("A", "2013", 2.0),
               ("B", "2019", 3.0), ("B", "2020", 4.0))
    assert as_set(country_indicators.load_indicator(raw)) == {("A", "2013", 2.0), ("B", "2019", 3.0)}
    assert as_set(country_indicators.load_indicator(raw, country="B")) == {("B", "2019", 3.0)}
    other = make("country string, year string, indicator double", ("C", "2013", 1.0))
    names = country_indicators.country_names(country_indicators.load_indicator(raw), other)
    assert as_set(names) == {("A",), ("B",), ("C",)}


def test_indicator_files(spark, tmp_path):
    (tmp_path / "gdp.csv").write_text("country,year,value\nA,2015,1.5\nB,2001,2.5\n")
    raw = country_indicators.read_indicator_files(spark, str(tmp_path / "gdp.csv"))
    assert as_set(country_indicators.load_indicator(raw)) == {("A", "2015", 1.5)}


def test_store(spark, make, tmp_path):
    kept = store.Store(spark, str(tmp_path / "tables"))
    kept.create_empty("authors")
    assert kept.read("authors").count() == 0
    kept.append(make("id int, name string", (1, "a")), "authors")
    kept.append(make("id int, name string", (2, "b")), "authors")
    assert as_set(kept.read("authors")) == {(1, "a"), (2, "b")}
    kept.update(kept.read("authors").withColumn("name", F.upper("name")), "authors")
    assert as_set(kept.read("authors")) == {(1, "A"), (2, "B")}
    kept.refresh(make("id int", (3,)), "authors")
    assert as_set(kept.read("authors")) == {(3, None)}


def test_every_declared_table_can_be_created(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "tables"))
    for name in schemas.TABLES:
        kept.create_empty(name)
        assert kept.read(name).count() == 0


def test_nan_text_and_foreign_keys(spark, make, tmp_path):
    path = str(tmp_path / "old")
    make("id long, name string", (1, "NaN"), (2, "b")).write.parquet(path)
    assert as_set(store.read_table(spark, path, "authors", nan_text=True)) == {(1, None), (2, "b")}
    child = make("author_id long", (1,), (5,), (None,))
    assert as_set(store.foreign_key_violations(child, "author_id", make("id long", (1,)), "id")) == {(5,)}


def test_papers_are_laid_out_by_year(spark, make, tmp_path):
    kept = store.Store(spark, str(tmp_path / "tables"))
    kept.create_empty("papers")
    kept.append(make("id long, year string", (1, "2015"), (2, None), (3, "2016")), "papers")
    assert as_set(kept.read("papers").select("id", "year")) == {(1, "2015"), (2, None), (3, "2016")}
    assert as_set(kept.read("papers").filter("year > '2015'").select("id")) == {(3,)}
    assert (tmp_path / "tables" / "papers" / "year=2016").is_dir()


def test_bucketed_tables_join_without_a_shuffle(spark, make, tmp_path):
    kept = store.Store(spark, str(tmp_path / "tables"))
    kept.save_bucketed(make("paper_id long, field_of_study_id long", (1, 10), (2, 11)), "paper_fields_of_study",
                       "paper_id", 4)
    kept.save_bucketed(make("affiliation_id long, author_id long, paper_id long", (1, 1, 1)), "author_affiliation",
                       "paper_id", 4)
    tags, links = spark.table("paper_fields_of_study"), spark.table("author_affiliation")
    joined = tags.hint("merge").join(links, "paper_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.select("paper_id", "field_of_study_id").collect() == [(1, 10)]
    for name in ("paper_fields_of_study", "author_affiliation"):
        spark.sql(f"drop table {name}")


def test_other_file_formats(spark, make, tmp_path):
    rows = [(1, "a"), (2, None)]
    for format in ("orc", "json", "csv"):
        kept = store.Store(spark, str(tmp_path / format), format)
        kept.refresh(make("id long, name string", *rows), "authors")
        assert as_set(kept.read("authors")) == set(rows)


def test_intervals_up_to_today(make):
    got = normalise.assign_intervals(make("date string", ("2000-01-01",), ("2020-06-15",), ("1999-12-31",), (None,)))
    found = {row["date"]: (row["interval_start"], row["interval_end"]) for row in got.collect()}
    assert found["2000-01-01"][0] == "2000-01-01"
    assert found["2020-06-15"][0] <= "2020-06-15" <= found["2020-06-15"][1]
    assert set(found) == {"2000-01-01", "2020-06-15"}
