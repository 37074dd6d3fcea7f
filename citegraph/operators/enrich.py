"""Places, names, gender, institution and journal flags, countries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegraph import config
from citegraph.functions import geo, text
from citegraph.operators.lists import dense_index
from citegraph.operators.normalise import not_yet_stored, one_per_key
from citegraph.session import materialise


def geocoded_places(responses: DataFrame) -> DataFrame:
    """Flatten place-details responses (affiliation_id, result) to one row per affiliation, also if it was asked twice."""
    responses = one_per_key(responses, "affiliation_id")
    result = F.col("result")
    components = result["address_components"]
    return responses.select(
        result["place_id"].alias("id"),
        "affiliation_id",
        result["geometry"]["location"]["lat"].alias("lat"),
        result["geometry"]["location"]["lng"].alias("lng"),
        result["formatted_address"].alias("address"),
        result["name"].alias("name"),
        result["types"].alias("types"),
        result["website"].alias("website"),
        *[geo.address_component(components, kind).alias(kind) for kind in geo.COMPONENT_TYPES],
    )


# --- names and gender ---------------------------------------------------------------------------------
def cleaned_names(authors: DataFrame) -> DataFrame:
    """id and proc_name for the authors whose name keeps a full forename."""
    return authors.select("id", text.clean_name(F.col("name")).alias("proc_name")).filter(
        F.col("proc_name").isNotNull()
    )


def name_batches(authors: DataFrame, batch_size: int = config.NAME_BATCH_SIZE) -> DataFrame:
    """proc_name, id and the batch_id of the name, names in alphabetical order: one row per author."""
    # Cleaning is costly per name, and the names are read for the numbers and for the authors.
    names = materialise(cleaned_names(authors))
    numbered = dense_index(names.select("proc_name").distinct(), ["proc_name"], "_rank")
    batches = numbered.select(
        "proc_name", F.floor(F.col("_rank") / F.lit(batch_size)).cast("long").alias("batch_id")
    )
    return names.join(batches, "proc_name").select("proc_name", "id", "batch_id")


def author_gender(responses: DataFrame, names: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per author id for every name the service resolved and that is not stored yet.

    A name that was asked repeatedly counts with one response.
    """
    found = responses.filter(F.col("result_found")).withColumn("full_name", F.col("input.full_name"))
    found = one_per_key(found, "full_name").select(
        "full_name", "first_name", "gender", F.col("details.samples").alias("samples"), "probability"
    )
    fresh = found.join(stored.select("full_name").distinct(), "full_name", "left_anti")
    ids = names.select(F.col("proc_name").alias("full_name"), "id")
    return fresh.join(ids, "full_name").select(
        "id", "full_name", "first_name", "gender", "samples", "probability"
    )


# --- flags --------------------------------------------------------------------------------------------
def affiliation_type(
    affiliation: DataFrame,
    stored: DataFrame | None = None,
    tokens: Sequence[str] = config.NON_INDUSTRY_TOKENS,
) -> DataFrame:
    """non_industry = 1 if the name contains any of the tokens; only affiliations not typed before."""
    fresh = affiliation if stored is None else not_yet_stored(affiliation, stored, "id")
    return fresh.select("id", text.contains_any(F.col("affiliation"), tokens).alias("non_industry"))


def open_access_journals(
    journals: DataFrame, names: Sequence[str] = config.OPEN_ACCESS_JOURNALS
) -> DataFrame:
    """open_access = 1 if the journal name is one of the names; one row per distinct (id, name)."""
    distinct = journals.select("id", "journal_name").distinct()
    return distinct.select("id", text.equals_any(F.col("journal_name"), names).alias("open_access"))


# --- countries ----------------------------------------------------------------------------------------
def lookup(mapping: Mapping[str, str | None], key: Column) -> tuple[Column, Column]:
    """(key is mapped, mapped value) for a small constant dictionary."""
    if not mapping:
        return F.lit(False), F.lit(None).cast("string")
    constant = F.create_map(*[F.lit(item).cast("string") for item in chain.from_iterable(mapping.items())])
    return F.coalesce(F.map_contains_key(constant, key), F.lit(False)), F.try_element_at(constant, key)


def country_association(
    places: DataFrame, mapping: Mapping[str, str | None] = config.PLACE_TO_INDICATOR_COUNTRY
) -> DataFrame:
    """Every non-empty place country with the name the indicators use for it."""
    name = F.col("google_country")
    mapped, value = lookup(mapping, name)
    return (
        places.filter(F.col("country") != "")
        .select(F.col("country").alias("google_country"))
        .distinct()
        .select(name, F.when(mapped, value).otherwise(name).alias("wb_country"))
    )


def country_details(
    responses: DataFrame,
    association: DataFrame,
    mapping: Mapping[str, str | None] = config.PLACE_TO_DETAILS_COUNTRY,
    second_match: Sequence[str] = config.SECOND_MATCH_COUNTRIES,
) -> DataFrame:
    """Attributes of each associated country, looked up by its name and else by its mapped name.

    A country without a response is dropped.  A few names match another country first, so their second
    match is used.
    """
    name = F.col("google_country")
    _, mapped = lookup(mapping, name)
    answers = one_per_key(responses, "query_name").select("query_name", "body")
    by_name = answers.select(F.col("query_name").alias("google_country"), F.col("body").alias("_body"))
    by_mapping = answers.select(F.col("query_name").alias("_mapped"), F.col("body").alias("_other"))
    position = F.when(name.isin(list(second_match)), F.lit(1)).otherwise(F.lit(0))
    fields = ["alpha2Code", "alpha3Code", "name", "capital", "region", "subregion", "population"]
    return (
        association.withColumn("_mapped", mapped)
        .join(by_name, "google_country", "left")
        .join(by_mapping, "_mapped", "left")
        .withColumn("_answer", F.get(F.coalesce("_body", "_other"), position))
        .filter(F.col("_answer").isNotNull())
        .select(
            *[F.col("_answer")[field].alias(field) for field in fields],
            F.col("google_country").alias("google_name"),
            F.col("wb_country").alias("wb_name"),
        )
    )
