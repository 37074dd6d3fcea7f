"""Enrichment: places, names, gender, flags, countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegraph import config
from citegraph.operators import enrich
from citegraph.queries.graph import Graph
from citegraph.queries.registry import query, rounded
from citegraph.session import materialise


def _sql_text(value: str | None) -> str:
    return "cast(NULL AS varchar)" if value is None else "'" + value.replace("'", "''") + "'"


def _sql_list(values) -> str:
    return ", ".join(_sql_text(value) for value in values)


def _sql_pairs(mapping) -> str:
    return ", ".join(f"({_sql_text(key)}, {_sql_text(value)})" for key, value in mapping.items())


# --- places -------------------------------------------------------------------------------------------
def _place_responses(g: Graph) -> DataFrame:
    """Place details of every supplier: the nation as country, its region at two levels, some towns.

    The country component comes twice, so that the later one has to win; one component carries two of
    the wanted types, so that the stronger has to win.
    """

    def component(name: Column, *types: str) -> Column:
        return F.struct(
            name.alias("long_name"), name.alias("short_name"), F.array(*[F.lit(t) for t in types]).alias("types")
        )

    region = g.table("region").withColumnRenamed("r_regionkey", "n_regionkey")
    suppliers = g.table("supplier").join(
        g.table("nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey"
    ).join(region, "n_regionkey")
    town = component(F.concat(F.lit("town of "), F.col("n_name")), "locality", "postal_town", "country")
    components = F.array_compact(
        F.array(
            component(F.lit("Old country"), "country", "political"),
            component(F.col("r_name"), "administrative_area_level_1", "political"),
            F.when(F.col("s_suppkey") % 2 == 0, component(F.lower("r_name"), "administrative_area_level_2")),
            F.when(F.col("s_suppkey") % 3 == 0, town),
            component(F.col("n_name"), "country", "political"),
            component(F.lit("12345"), "postal_code"),
        )
    )
    return suppliers.select(
        F.col("s_suppkey").alias("affiliation_id"),
        F.struct(
            components.alias("address_components"),
            F.concat_ws(", ", "s_name", "n_name").alias("formatted_address"),
            F.struct(
                F.struct(
                    (F.col("s_acctbal") / 100).alias("lat"), (F.col("s_acctbal") / 50).alias("lng")
                ).alias("location")
            ).alias("geometry"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("place-"), F.col("s_suppkey").cast("string")).alias("place_id"),
            F.array(F.lit("point_of_interest"), F.lit("establishment")).alias("types"),
            F.when(F.col("s_suppkey") % 4 == 0, F.lit("https://example.org")).alias("website"),
        ).alias("result"),
    )


@query(
    """SELECT concat('place-', cast(s_suppkey AS varchar)) AS id, s_suppkey AS affiliation_id,
        round(s_acctbal / 100 + 1e-9, 6) AS lat, round(s_acctbal / 50 + 1e-9, 6) AS lng,
        concat(s_name, ', ', n_name) AS address,
        s_name AS name, 'point_of_interest,establishment' AS types,
        CASE WHEN s_suppkey % 4 = 0 THEN 'https://example.org' END AS website,
        CASE WHEN s_suppkey % 3 = 0 THEN concat('town of ', n_name) END AS postal_town,
        CASE WHEN s_suppkey % 2 = 0 THEN lower(r_name) END AS administrative_area_level_2,
        r_name AS administrative_area_level_1, n_name AS country
    FROM suppliers JOIN region ON r_regionkey = n_regionkey"""
)
def geocoded_places(g: Graph) -> DataFrame:
    return flat_places(_place_responses(g))


def flat_places(responses: DataFrame) -> DataFrame:
    places = enrich.geocoded_places(responses)
    return rounded(places.withColumn("types", F.array_join("types", ",")), "lat", "lng")


# --- names and gender ---------------------------------------------------------------------------------
# The rule word by word for DuckDB, whose patterns have other flags.
_CLEANED = r"""
, words AS (
    SELECT id, string_split(regexp_replace(name, '[)(#"!:]|-{2,}', '', 'g'), ' ') AS w FROM authors)
, cleaned AS (
    SELECT id, trim(array_to_string(list_append(forenames, w[-1]), ' ')) AS proc_name
    FROM (
        SELECT id, w, list_filter(list_transform(w[:-2],
            lambda t: regexp_replace(regexp_replace(t, '.?\.', '', 'g'), '[A-Z]*-[A-Z]\b', '', 'g')),
            lambda t: length(t) > 1) AS forenames
        FROM words)
    WHERE len(forenames) > 0)
"""


@query(_CLEANED + "SELECT id, proc_name FROM cleaned")
def clean_names(g: Graph) -> DataFrame:
    return enrich.cleaned_names(g.authors)


_BATCH = 100


@query(
    _CLEANED
    + f"""SELECT proc_name, id, (dense_rank() OVER (ORDER BY encode(proc_name)) - 1) // {_BATCH} AS batch_id FROM cleaned"""
)
def name_batches(g: Graph) -> DataFrame:
    return enrich.name_batches(g.authors, _BATCH)


@query(
    _CLEANED
    + """SELECT id, proc_name AS full_name, split_part(proc_name, ' ', 1) AS first_name,
        CASE WHEN length(proc_name) % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
        cast(length(proc_name) * 10 AS integer) AS samples, round(length(proc_name) / 40.0 + 1e-9, 6) AS probability
    FROM cleaned WHERE length(proc_name) % 5 <> 0 AND proc_name NOT LIKE 'B%'"""
)
def infer_gender(g: Graph) -> DataFrame:
    """The service answers by name length; names that start with B were collected before."""
    names = named_authors(g)
    return genders_from(names, gender_responses(names))


def named_authors(g: Graph) -> DataFrame:
    """The authors by name, for the responses and for those who get them."""
    return materialise(enrich.name_batches(g.dealt_out(g.authors), _BATCH))


def gender_responses(names: DataFrame) -> DataFrame:
    length = F.char_length("proc_name")
    # One response per author, so a name is answered as often as it occurs.
    return names.select(
        F.struct(F.col("proc_name").alias("full_name")).alias("input"),
        F.struct((length * 10).alias("samples")).alias("details"),
        (length % 5 != 0).alias("result_found"),
        F.split_part("proc_name", F.lit(" "), F.lit(1)).alias("first_name"),
        (length / 40.0).cast("double").alias("probability"),
        F.when(length % 2 == 0, "female").otherwise("male").alias("gender"),
    )


def genders_from(names: DataFrame, responses: DataFrame) -> DataFrame:
    stored = names.filter(F.col("proc_name").startswith("B")).select(F.col("proc_name").alias("full_name"))
    return rounded(enrich.author_gender(responses, names, stored), "probability")


# --- flags --------------------------------------------------------------------------------------------
@query(
    f"""SELECT id, cast(exists(SELECT 1 FROM (SELECT unnest([{_sql_list(config.NON_INDUSTRY_TOKENS)}]) AS token)
        WHERE contains(affiliation, token)) AS integer) AS non_industry
    FROM affiliation WHERE id NOT IN (SELECT affiliation_id FROM places WHERE country = '')"""
)
def affiliation_type(g: Graph) -> DataFrame:
    """Affiliations in a place without country were typed before."""
    stored = g.places.filter(F.col("country") == "").select(F.col("affiliation_id").alias("id"))
    return enrich.affiliation_type(g.affiliation, stored)


@query(
    f"""SELECT id, cast(journal_name IN ({_sql_list(config.OPEN_ACCESS_JOURNALS)}) AS integer) AS open_access
    FROM (SELECT DISTINCT id, journal_name FROM journals)"""
)
def open_access(g: Graph) -> DataFrame:
    return enrich.open_access_journals(g.journals)


# --- countries ----------------------------------------------------------------------------------------
_ASSOCIATION = f"""
, mapping(place_name, indicator_name) AS (VALUES {_sql_pairs(config.PLACE_TO_INDICATOR_COUNTRY)})
, association AS (
    SELECT country AS google_country,
        CASE WHEN place_name IS NOT NULL THEN indicator_name ELSE country END AS wb_country
    FROM (SELECT DISTINCT country FROM places WHERE country <> '')
    LEFT JOIN mapping ON place_name = country)
"""


@query(_ASSOCIATION + "SELECT google_country, wb_country FROM association")
def country_association(g: Graph) -> DataFrame:
    return enrich.country_association(g.places)


@query(
    _ASSOCIATION
    + f"""
, other(place_name, service_name) AS (VALUES {_sql_pairs(config.PLACE_TO_DETAILS_COUNTRY)})
, asked AS (
    SELECT google_country, wb_country, coalesce(service_name, google_country) AS asked_name,
        CASE WHEN google_country IN ({_sql_list(config.SECOND_MATCH_COUNTRIES)}) THEN 2 ELSE 1 END AS match
    FROM association LEFT JOIN other ON place_name = google_country)
SELECT concat(asked_name, ' ', cast(match AS varchar)) AS name, concat('capital ', cast(match AS varchar)) AS capital,
    upper(substr(asked_name, 1, 2)) AS "alpha2Code", upper(substr(asked_name, 1, 3)) AS "alpha3Code",
    concat('region of ', asked_name) AS region, concat('subregion of ', asked_name) AS subregion,
    length(asked_name) * 1000 + match AS population, google_country AS google_name, wb_country AS wb_name
FROM asked WHERE google_country <> 'Russia'"""
)
def country_details(g: Graph) -> DataFrame:
    """The service knows countries by its own names, has two matches for each and none for Russia."""
    return enrich.country_details(country_responses(g), enrich.country_association(g.places))


def country_responses(g: Graph) -> DataFrame:
    association = enrich.country_association(g.places)
    _, renamed = enrich.lookup(config.PLACE_TO_DETAILS_COUNTRY, F.col("google_country"))
    asked = association.filter(F.col("google_country") != "Russia").select(
        F.coalesce(renamed, F.col("google_country")).alias("query_name")
    )

    def match(number: int) -> Column:
        name = F.col("query_name")
        return F.struct(
            F.concat(name, F.lit(f" {number}")).alias("name"),
            F.upper(F.substring(name, 1, 2)).alias("alpha2Code"),
            F.upper(F.substring(name, 1, 3)).alias("alpha3Code"),
            F.lit(f"capital {number}").alias("capital"),
            F.concat(F.lit("region of "), name).alias("region"),
            F.concat(F.lit("subregion of "), name).alias("subregion"),
            (F.char_length(name) * 1000 + number).cast("long").alias("population"),
        )

    responses = asked.select("query_name", F.array(match(1), match(2)).alias("body"))
    return responses.union(responses)  # landed twice
