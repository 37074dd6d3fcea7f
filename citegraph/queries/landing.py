"""Files: what the readers and sinks leave must give the same rows as the plans they stand for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.operators import normalise, outputs, topics
from citegraph.queries import enriching, normalising, presenting
from citegraph.queries.graph import Graph
from citegraph.queries.registry import query, same_result_as
from citegraph.session import materialise
from citegraph.sources import country_indicators, records
from citegraph.sources.store import Store


def landed(g: Graph, df: DataFrame, label: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """``df`` written as JSON lines and read with its declared schema."""
    folder = normalising.fresh_folder(g, label)
    df.write.json(folder)
    return read(g.spark, folder)


# --- landed responses and records ---------------------------------------------------------------------
@same_result_as("geocoded_places")
def landed_places(g: Graph) -> DataFrame:
    return enriching.flat_places(landed(g, enriching._place_responses(g), "places", records.read_place_details))


@same_result_as("infer_gender")
def landed_genders(g: Graph) -> DataFrame:
    names = enriching.named_authors(g)
    return enriching.genders_from(names, landed(g, enriching.gender_responses(names), "genders", records.read_gender_responses))


@same_result_as("country_details")
def landed_countries(g: Graph) -> DataFrame:
    responses = landed(g, enriching.country_responses(g), "countries", records.read_country_details)
    return enriching.enrich.country_details(responses, enriching.enrich.country_association(g.places))


@same_result_as("topic_metadata")
def landed_topic_metadata(g: Graph) -> DataFrame:
    found = landed(g, normalising.landed_topics(g), "topics", records.read_topics)
    return normalise.topic_metadata(found, g.fields_of_study, normalising.described(g))


@query("SELECT country, year, round(value, 2) AS indicator FROM country_values WHERE year BETWEEN '1995' AND '1998'")
def landed_indicators(g: Graph) -> DataFrame:
    folder = normalising.fresh_folder(g, "indicators")
    g.country_values.select("country", "year", "value").write.option("header", "true").csv(folder)
    table = country_indicators.load_indicator(country_indicators.read_indicator_files(g.spark, folder), "1995", "1998")
    return table.withColumn("indicator", F.round("indicator", 2))


@query(
    """SELECT o_orderkey AS id,
        (SELECT count(*) FROM authorship a JOIN authors ON authors.id = a.author_id
            WHERE a.paper_id = o_orderkey) AS authors,
        (SELECT count(*) FROM paper_fos p WHERE p.paper_id = o_orderkey) AS topics
    FROM orders"""
)
def scan_all_records(g: Graph) -> DataFrame:
    """Every landed record, with or without a DOI."""
    folder = normalising.fresh_folder(g, "landed")
    records.write_records(g.landed(people=True, topics=True), folder)
    size = lambda name: F.coalesce(F.size(name), F.lit(0)).cast("long")
    return records.read_records(g.spark, folder).select(F.col("Id").alias("id"), size("AA").alias("authors"), size("F").alias("topics"))


@same_result_as("parse_papers")
def landed_papers(g: Graph) -> DataFrame:
    return normalising.parsed_papers(_records(g, texts=True))


@same_result_as("parse_authors")
def landed_authors(g: Graph) -> DataFrame:
    """The name seen last, by the order of the landed files, which here follows the order keys."""
    return normalise.authors(_records(g, people=True))


@same_result_as("parse_paper_fields_of_study")
def landed_paper_fields_of_study(g: Graph) -> DataFrame:
    return normalise.paper_fields_of_study(_records(g, topics=True))


def _records(g: Graph, **parts: bool) -> DataFrame:
    folder = normalising.fresh_folder(g, "landed")
    records.write_records(g.landed(**parts), folder)
    return records.read_records(g.spark, folder)


# --- an incremental run over every graph table --------------------------------------------------------
_NEW = "FROM orders WHERE o_orderstatus <> 'F'"
_OLD = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"
_WORK = """SELECT a.*, name, nullif(affiliation_id, 0) AS placed FROM authorship a JOIN authors ON authors.id = a.author_id"""


def _fresh_ids(column: str, rows: str, paper: str = "paper_id") -> str:
    seen = f"SELECT {column} FROM ({rows}) WHERE {paper} IN ({_OLD}) AND {column} IS NOT NULL"
    return f"SELECT DISTINCT {column} AS a FROM ({rows}) WHERE {paper} NOT IN ({_OLD}) AND {column} IS NOT NULL AND {column} NOT IN ({seen})"


@query(
    f"""SELECT 'papers' AS table_name, cast(o_orderkey AS varchar) AS row {_NEW}
    UNION ALL SELECT 'paper_journal', concat(o_custkey % 50, '/', o_orderkey) {_NEW} AND o_orderstatus <> 'O'
    UNION ALL SELECT 'paper_conferences', concat(o_custkey % 7, '/', o_orderkey) {_NEW} AND o_orderstatus = 'O'
    UNION ALL SELECT DISTINCT 'paper_authors', concat(paper_id, '/', author_id, '/', l_linenumber) FROM ({_WORK})
        WHERE paper_id NOT IN ({_OLD})
    UNION ALL SELECT DISTINCT 'author_affiliation', concat(coalesce(cast(placed AS varchar), '-'), '/', author_id, '/', paper_id)
        FROM ({_WORK}) WHERE paper_id NOT IN ({_OLD})
    UNION ALL SELECT 'paper_fields_of_study', concat(paper_id, '/', field_of_study_id) FROM paper_fos WHERE paper_id NOT IN ({_OLD})
    UNION ALL SELECT 'authors', cast(a AS varchar) FROM ({_fresh_ids("author_id", _WORK)})
    UNION ALL SELECT 'affiliation', cast(a AS varchar) FROM ({_fresh_ids("placed", _WORK)})
    UNION ALL SELECT 'fields_of_study', cast(a AS varchar) FROM ({_fresh_ids("field_of_study_id", "SELECT * FROM paper_fos")})"""
)
def merged_tables(g: Graph) -> DataFrame:
    """The rows that a second run adds to each table, if the first one had the fulfilled orders."""
    # Nine tables are parsed from each of the two runs, so the records are put together once and the new ones found once.
    every = materialise(g.landed(people=True, topics=True).select("Id", "Pt", "J", "C", "AA", "F", "ordinal"))
    first = every.filter(F.col("Pt") == "F")
    stored = normalise.latest_per_key(first.select("Id", "ordinal"), "Id").select(F.col("Id").alias("id"))
    fresh = materialise(normalise.rows_to_append(every, stored, "Id", "id"))
    links = {
        "paper_journal": (normalise.journals, ["id", "paper_id"]),
        "paper_conferences": (normalise.conferences, ["id", "paper_id"]),
        "paper_authors": (normalise.paper_authors, ["paper_id", "author_id", "order"]),
        "author_affiliation": (normalise.author_affiliation, ["affiliation_id", "author_id", "paper_id"]),
        "paper_fields_of_study": (normalise.paper_fields_of_study, ["paper_id", "field_of_study_id"]),
    }
    things = {"authors": normalise.authors, "affiliation": normalise.affiliations, "fields_of_study": normalise.fields_of_study}
    added = {"papers": (fresh.select(F.col("Id").alias("id")), ["id"])}
    for name, (parse, columns) in links.items():
        added[name] = (normalise.not_yet_stored(parse(fresh), parse(first), "paper_id"), columns)
    for name, parse in things.items():
        added[name] = (normalise.not_yet_stored(parse(fresh), parse(first), "id"), ["id"])
    shown = [
        rows.select(
            F.lit(name).alias("table_name"),
            F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("row"),
        )
        for name, (rows, columns) in added.items()
    ]
    return reduce(DataFrame.unionByName, shown)


# --- stored tables ------------------------------------------------------------------------------------
@query(
    """SELECT 'authors' AS table_name, id AS a, cast(NULL AS bigint) AS b, name AS c FROM authors
    UNION ALL SELECT 'author_affiliation', affiliation_id, author_id, cast(paper_id AS varchar) FROM author_affiliation
    UNION ALL SELECT 'paper_fields_of_study', paper_id, field_of_study_id, NULL FROM paper_fos
    UNION ALL SELECT 'papers', id, citations, concat(year, '/', date, '/', original_title) FROM papers"""
)
def stored_contents(g: Graph) -> DataFrame:
    """Tables written and read back, with their values."""
    store = Store(g.spark, normalising.fresh_folder(g, "tables"))
    tables = {
        "authors": (g.authors, "id", None, F.col("name")),
        "author_affiliation": (g.author_affiliation, "affiliation_id", "author_id", F.col("paper_id").cast("string")),
        "paper_fields_of_study": (g.paper_fos, "paper_id", "field_of_study_id", F.lit(None).cast("string")),
        "papers": (g.paper_attributes, "id", "citations", F.concat_ws("/", "year", "date", "original_title")),
    }
    shown = []
    for name, (table, a, b, c) in tables.items():
        store.refresh(table, name)
        second = F.col(b).cast("long") if b else F.lit(None).cast("long")
        shown.append(store.read(name).select(F.lit(name).alias("table_name"), F.col(a).alias("a"), second.alias("b"), c.alias("c")))
    return reduce(DataFrame.unionByName, shown)


@same_result_as("topic_frequency")
def updated_in_place(g: Graph) -> DataFrame:
    """The frequencies computed from the stored table that they replace."""
    store = Store(g.spark, normalising.fresh_folder(g, "tables"))
    store.refresh(g.metadata, "field_of_study_metadata")
    store.update(topics.topic_frequency(g.paper_fos, store.read("field_of_study_metadata")), "field_of_study_metadata")
    return store.read("field_of_study_metadata")


@same_result_as("search_authors")
def search_authors_file(g: Graph) -> DataFrame:
    """The search files read back: JSON leaves out nulls and keeps every row."""
    folder = normalising.fresh_folder(g, "search")
    rows = outputs.search_authors(g.author_affiliation, g.authors, g.affiliation)
    outputs.write_search_documents(rows, folder)
    return g.spark.read.schema(rows.schema).json(folder)


@same_result_as("flat_export")
def flat_export_file(g: Graph) -> DataFrame:
    """The compressed export read back."""
    folder = normalising.fresh_folder(g, "flat")
    outputs.write_flat_export(presenting.flat_export(g), folder)
    return g.spark.read.parquet(folder)
