"""Sources and normalisation: landed records, stored tables, parsers, incremental runs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph import schemas
from citegraph.functions import text
from citegraph.operators import normalise
from citegraph.queries.graph import Graph
from citegraph.queries.registry import query
from citegraph.session import shared_folder
from citegraph.sources import country_indicators, records, store


def fresh_folder(g: Graph, label: str) -> str:
    return f"{shared_folder(g.spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query(
    """SELECT o_orderkey AS id, concat('10.1000/', cast(o_orderkey AS varchar)) AS doi,
        (SELECT count(*) FROM authorship a JOIN authors ON authors.id = a.author_id
            WHERE a.paper_id = o_orderkey) AS authors,
        (SELECT count(*) FROM paper_fos p WHERE p.paper_id = o_orderkey) AS topics
    FROM orders WHERE o_orderstatus = 'F'"""
)
def scan_records(g: Graph) -> DataFrame:
    folder = fresh_folder(g, "landed")
    records.write_records(g.raw, folder)
    landed = records.read_records(g.spark, folder, with_doi=True)
    return landed.select(
        F.col("Id").alias("id"),
        F.col("DOI").alias("doi"),
        F.size("AA").cast("long").alias("authors"),
        F.coalesce(F.size("F"), F.lit(0)).cast("long").alias("topics"),
    )


@query(
    """SELECT 'author_affiliation' AS table_name, count(*) AS n FROM author_affiliation
    UNION ALL SELECT 'authors', count(*) FROM authors
    UNION ALL SELECT 'fields_of_study', count(*) FROM levels
    UNION ALL SELECT 'paper_fields_of_study', count(*) FROM paper_fos
    UNION ALL SELECT 'papers', 2 * count(*) FROM papers"""
)
def scan_tables(g: Graph) -> DataFrame:
    kept = store.Store(g.spark, fresh_folder(g, "tables"))
    tables = {
        "author_affiliation": g.author_affiliation,
        "authors": g.authors,
        "fields_of_study": g.fields_of_study,
        "paper_fields_of_study": g.paper_fos,
        "papers": g.papers,
    }
    for name, table in tables.items():
        kept.refresh(table, name)
    kept.append(g.papers, "papers")
    counts = [
        kept.read(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name in tables
    ]
    return reduce(DataFrame.unionByName, counts)


_CHILDREN = {
    "paper_journal": "SELECT paper_id FROM journals JOIN orders ON o_orderkey = paper_id WHERE o_orderstatus <> 'O'",
    "paper_conferences": "SELECT o_orderkey AS paper_id FROM orders WHERE o_orderstatus = 'O'",
    "paper_authors": 'SELECT paper_id, author_id FROM paper_authors',
    "author_affiliation": "SELECT * FROM author_affiliation",
    "paper_fields_of_study": "SELECT * FROM paper_fos",
    "geocoded_places": "SELECT * FROM places",
}
_PARENTS = {"papers": "papers", "authors": "authors", "affiliation": "affiliation", "fields_of_study": "levels"}


@query(
    " UNION ALL ".join(
        f"SELECT '{child}.{column}' AS reference, count(*) AS n FROM ({_CHILDREN[child]}) "
        f"WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {_PARENTS[parent]})"
        for child, column, parent, key in schemas.FOREIGN_KEYS
    )
)
def foreign_keys(g: Graph) -> DataFrame:
    """Rows of each declared reference without a parent; the tables are those of the graph.

    Links are looked up as often as they occur, and only those without a parent become distinct rows.
    """
    links = {
        "paper_authors": g.authorship_links("paper_id", "author_id"),
        "author_affiliation": g.authorship_links("affiliation_id", "author_id", "paper_id"),
        "paper_fields_of_study": g.topic_links,
    }
    tables = {
        "paper_journal": normalise.journals(g.landed()),
        "paper_conferences": normalise.conferences(g.landed()),
        "geocoded_places": g.places,
        "papers": g.paper_attributes,
        "authors": g.authors,
        "affiliation": g.affiliation,
        "fields_of_study": g.fields_of_study,
    }

    def violations(child: str, column: str, parent: str, key: str) -> DataFrame:
        found = store.foreign_key_violations(links.get(child, tables.get(child)), column, tables[parent], key)
        return found.distinct() if child in links else found

    counts = [
        violations(child, column, parent, key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(f"{child}.{column}").alias("reference"), "n")
        for child, column, parent, key in schemas.FOREIGN_KEYS
    ]
    return reduce(DataFrame.unionByName, counts)


_INDICATOR_YEARS = {
    "wb_gdp": ("1995", "1998", "all"),
    "wb_rnd_expenditure": ("1996", "1999", "all"),
    "wb_edu_expenditure": ("1997", "2000", "all"),
    "wb_female_workforce": ("1995", "2001", ["India", "Egypt", "NATION_9"]),
}


def _indicators(g: Graph) -> dict[str, DataFrame]:
    return {
        name: country_indicators.load_indicator(g.country_values, start, end, country)
        for name, (start, end, country) in _INDICATOR_YEARS.items()
    }


@query(
    """SELECT 'wb_gdp' AS table_name, country, year, round(value, 2) AS indicator FROM country_values
        WHERE year BETWEEN '1995' AND '1998'
    UNION ALL SELECT 'wb_rnd_expenditure', country, year, round(value, 2) FROM country_values
        WHERE year BETWEEN '1996' AND '1999'
    UNION ALL SELECT 'wb_edu_expenditure', country, year, round(value, 2) FROM country_values
        WHERE year BETWEEN '1997' AND '2000'
    UNION ALL SELECT 'wb_female_workforce', country, year, round(value, 2) FROM country_values
        WHERE year BETWEEN '1995' AND '2001' AND country IN ('India', 'Egypt', 'NATION_9')"""
)
def load_indicators(g: Graph) -> DataFrame:
    tables = [
        table.select(F.lit(name).alias("table_name"), "country", "year", F.round("indicator", 2).alias("indicator"))
        for name, table in _indicators(g).items()
    ]
    return reduce(DataFrame.unionByName, tables)


@query("SELECT DISTINCT country FROM country_values WHERE year BETWEEN '1995' AND '2001'")
def indicator_countries(g: Graph) -> DataFrame:
    return country_indicators.country_names(*_indicators(g).values())


# Start, end and intervals per year of the interval query: 7 years in 21 intervals.
_START, _END, _PER_YEAR, _INTERVALS = "1995-01-15", "2001-11-20", 3, 21


@query(
    f"""SELECT id, date, strftime(a, '%Y-%m-%d') AS interval_start, strftime(b, '%Y-%m-%d') AS interval_end
    FROM papers JOIN (
        SELECT cast(make_timestamp(first + i * step) AS date) AS a,
            cast(CASE WHEN i = {_INTERVALS - 1} THEN make_timestamp(last)
                ELSE make_timestamp(first + (i + 1) * step) END AS date) AS b
        FROM (SELECT epoch_us(timestamp '{_START}') AS first, epoch_us(timestamp '{_END}') AS last,
                cast(round((epoch_us(timestamp '{_END}') - epoch_us(timestamp '{_START}')) / {_INTERVALS})
                    AS bigint) AS step,
                unnest(range({_INTERVALS})) AS i))
    ON cast(date AS date) BETWEEN a AND b"""
)
def date_intervals(g: Graph) -> DataFrame:
    return normalise.assign_intervals(g.paper_attributes.select("id", "date"), _START, _END, _PER_YEAR)


# --- parsers ------------------------------------------------------------------------------------------
@query(
    """SELECT o_orderkey AS id, concat(o_orderpriority, ' ', cast(o_custkey AS varchar)) AS title,
        o_orderstatus AS publication_type, year, date, citations, original_title,
        CASE WHEN o_orderstatus = 'F' THEN concat('10.1000/', cast(o_orderkey AS varchar)) END AS doi,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS publisher, 'a' AS bibtex_doc_type,
        CASE WHEN o_orderkey > 1
            THEN concat(cast(o_orderkey - 1 AS varchar), ',', cast(o_orderkey - 2 AS varchar)) END AS refs,
        CASE WHEN o_orderstatus <> 'P'
            THEN concat('https://example.org/paper/', cast(o_orderkey AS varchar)) END AS source,
        replace(abstract, chr(0), '') AS abstract
    FROM orders JOIN papers ON id = o_orderkey"""
)
def parse_papers(g: Graph) -> DataFrame:
    return parsed_papers(g.landed(texts=True))


def parsed_papers(raw: DataFrame) -> DataFrame:
    return normalise.papers(raw).select(
        "id", "title", "publication_type", "year", "date", "citations", "original_title", "doi", "publisher",
        "bibtex_doc_type", F.array_join(F.col("references").cast("array<string>"), ",").alias("refs"), "source",
        "abstract",
    )


@query("SELECT doc_id AS id, replace(text, chr(0), '') AS abstract FROM documents")
def abstracts(g: Graph) -> DataFrame:
    """Every document rebuilt from its word -> positions map."""
    abstract = text.abstract_from_inverted_index(F.col("IA.InvertedIndex"))
    return g.inverted_index.select("id", abstract.alias("abstract"))


@query(
    f"""SELECT j.id, journal_name, paper_id FROM journals j JOIN orders ON o_orderkey = paper_id
    WHERE o_orderstatus <> 'O'"""
)
def parse_journals(g: Graph) -> DataFrame:
    return normalise.journals(g.landed())


@query(
    """SELECT o_custkey % 7 AS id, concat('conference ', o_orderpriority) AS conference_name,
        o_orderkey AS paper_id FROM orders WHERE o_orderstatus = 'O'"""
)
def parse_conferences(g: Graph) -> DataFrame:
    return normalise.conferences(g.landed())


_KNOWN = "JOIN authors ON authors.id = a.author_id"


@query(f"SELECT DISTINCT author_id AS id, name FROM authorship a {_KNOWN}")
def parse_authors(g: Graph) -> DataFrame:
    return normalise.authors(g.landed(people=True))


@query(f"""SELECT DISTINCT paper_id, author_id, l_linenumber AS "order" FROM authorship a {_KNOWN}""")
def parse_paper_authors(g: Graph) -> DataFrame:
    return normalise.paper_authors(g.landed(people=True))


@query("SELECT DISTINCT id, name FROM levels JOIN paper_fos ON field_of_study_id = id")
def parse_fields_of_study(g: Graph) -> DataFrame:
    return normalise.fields_of_study(g.landed(topics=True))


@query("SELECT paper_id, field_of_study_id FROM paper_fos")
def parse_paper_fields_of_study(g: Graph) -> DataFrame:
    return normalise.paper_fields_of_study(g.landed(topics=True))


@query(
    f"""SELECT DISTINCT f.id, affiliation FROM affiliation f JOIN authorship a ON f.id = affiliation_id
    {_KNOWN} WHERE f.id <> 0"""
)
def parse_affiliations(g: Graph) -> DataFrame:
    return normalise.affiliations(g.landed(people=True))


@query(
    f"""SELECT DISTINCT nullif(affiliation_id, 0) AS affiliation_id, author_id, paper_id
    FROM authorship a {_KNOWN}"""
)
def parse_author_affiliation(g: Graph) -> DataFrame:
    return normalise.author_affiliation(g.landed(people=True))


# --- incremental runs ---------------------------------------------------------------------------------
@query(
    """SELECT id, CASE WHEN o_orderpriority = '1-URGENT' THEN citations + 1 ELSE citations END AS citations
    FROM papers JOIN orders ON o_orderkey = id WHERE o_orderstatus <> 'F'"""
)
def incremental_merge(g: Graph) -> DataFrame:
    """Urgent orders landed a second time with one more citation; fulfilled orders are stored already."""
    orders = g.table("orders")
    first = g.landed().select("Id", "CC", "ordinal")
    urgent = orders.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("Id"))
    again = first.join(urgent, "Id", "left_semi").select(
        "Id", (F.col("CC") + 1).alias("CC"), (F.col("ordinal") + F.lit(1 << 40)).alias("ordinal")
    )
    stored = orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("id"))
    fresh = normalise.rows_to_append(first.unionByName(again), stored, "Id", "id")
    return fresh.select(F.col("Id").alias("id"), F.col("CC").alias("citations"))


@query(
    """SELECT 'document without vector' AS missing, id FROM papers WHERE abstract IS NOT NULL
        AND id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT 'affiliation without country', id FROM affiliation
        WHERE id NOT IN (SELECT affiliation_id FROM places WHERE country IS NOT NULL)
    UNION ALL SELECT 'author never published', id FROM authors
        WHERE id NOT IN (SELECT author_id FROM paper_authors)
    UNION ALL SELECT 'topic without papers', id FROM levels
        WHERE id NOT IN (SELECT field_of_study_id FROM paper_fos)
    UNION ALL SELECT 'author without gender', id FROM authors WHERE id NOT IN (SELECT id FROM gender WHERE gender <> 'unknown')
    UNION ALL SELECT 'vector without projection', id FROM vectors
        WHERE id NOT IN (SELECT id FROM papers WHERE length(abstract) >= 300)"""
)
def not_yet_processed(g: Graph) -> DataFrame:
    located = g.places.filter(F.col("country").isNotNull())
    with_abstract = g.papers.filter(F.col("abstract").isNotNull())
    sites = {
        "document without vector": (with_abstract, g.table("embeddings"), "vec_id"),
        "affiliation without country": (g.affiliation, located, "affiliation_id"),
        "author never published": (g.authors, g.published_authors, "author_id"),
        "topic without papers": (g.fields_of_study, g.used_topics, "field_of_study_id"),
        "author without gender": (g.authors, g.gender.filter("gender <> 'unknown'"), "id"),
        "vector without projection": (g.vectors, g.papers.filter(F.char_length("abstract") >= 300), "id"),
    }
    left = [
        normalise.not_yet_stored(new.select("id"), stored, "id", key).select(F.lit(label).alias("missing"), "id")
        for label, (new, stored, key) in sites.items()
    ]
    return reduce(DataFrame.unionByName, left)


@query(
    """SELECT o_orderkey AS id FROM (
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_custkey
            ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1"""
)
def best_match_per_title(g: Graph) -> DataFrame:
    found = normalise.best_match_per_title(g.landed().select("Id", "Ti", "logprob", "ordinal"))
    return found.select(F.col("Id").alias("id"))


# --- topics -------------------------------------------------------------------------------------------
def landed_topics(g: Graph) -> DataFrame:
    """Landed topics: every link also names one topic that is not ours."""

    def with_stranger(ids):
        return F.transform(F.flatten(F.array(ids, F.array(F.lit(-1).cast("long")))), lambda i: F.struct(i.alias("FId")))

    down = g.edges.groupBy(F.col("parent").alias("id")).agg(with_stranger(F.collect_list("child")).alias("FC"))
    up = g.edges.groupBy(F.col("child").alias("id")).agg(with_stranger(F.collect_list("parent")).alias("FP"))
    return (
        g.metadata.join(down, "id", "left").join(up, "id", "left")
        .select(F.col("id").alias("Id"), F.col("level").alias("FL"), "FC", "FP")
    )


def described(g: Graph) -> DataFrame:
    """Topics that an earlier run described: the top level."""
    return g.metadata.filter(F.col("level") == 0)


@query("SELECT id, level, cast(NULL AS bigint) AS frequency FROM levels WHERE level > 0")
def topic_metadata(g: Graph) -> DataFrame:
    return normalise.topic_metadata(landed_topics(g), g.fields_of_study, described(g))


@query(
    """SELECT id,
        (SELECT string_agg(cast(child AS varchar), ',' ORDER BY child) FROM edges WHERE parent = id) AS children,
        (SELECT string_agg(cast(parent AS varchar), ',' ORDER BY parent) FROM edges WHERE child = id) AS parents
    FROM levels WHERE level > 0"""
)
def topic_hierarchy(g: Graph) -> DataFrame:
    links = normalise.topic_hierarchy(landed_topics(g), g.fields_of_study, described(g))

    def joined(name: str):
        return F.array_join(F.col(name).cast("array<string>"), ",")

    return links.select("id", joined("child_id").alias("children"), joined("parent_id").alias("parents"))
