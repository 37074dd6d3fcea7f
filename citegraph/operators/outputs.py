"""Front-end tables and search documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph import config


def all_metrics(
    research_diversity: DataFrame, rca_country: DataFrame, gender_diversity: DataFrame, fos: DataFrame
) -> DataFrame:
    """Cells that have all three indicators, with the topic name."""
    cell = ["year", "field_of_study_id", "entity"]
    names = fos.select(F.col("id").alias("field_of_study_id"), "name")
    return (
        research_diversity.filter(F.col("entity").isNotNull())
        .select(*cell, "shannon_diversity")
        .join(rca_country.select(*cell, "rca_sum"), cell)
        .join(gender_diversity.select(*cell, "female_share"), cell)
        .join(names, "field_of_study_id")
        .select(
            "year",
            F.col("entity").alias("country"),
            "shannon_diversity",
            "field_of_study_id",
            "rca_sum",
            "female_share",
            "name",
        )
    )


def credited_country(author_affiliation: DataFrame, places: DataFrame) -> DataFrame:
    """One country per paper: that of its smallest located (affiliation_id, country)."""
    located = places.filter(F.col("country") != "").select("affiliation_id", "country")
    return (
        author_affiliation.select("paper_id", "affiliation_id")
        .join(located, "affiliation_id")
        .groupBy("paper_id")
        .agg(F.min(F.struct("affiliation_id", "country")).alias("_first"))
        .select("paper_id", F.col("_first.country").alias("country"))
    )


def country_topic_outputs(
    papers: DataFrame,
    paper_fos: DataFrame,
    author_affiliation: DataFrame,
    places: DataFrame,
    metrics: DataFrame,
) -> DataFrame:
    """Papers and citations per country, topic and year for the cells of ``metrics`` (all_metrics).

    Papers count for the topics they carry directly and for one country.
    """
    cell = ["field_of_study_id", "country", "year"]
    topics = metrics.select("field_of_study_id").distinct()
    tags = paper_fos.select("paper_id", "field_of_study_id").join(topics, "field_of_study_id", "left_semi")
    dated = papers.select(F.col("id").alias("paper_id"), "citations", "year")
    outputs = (
        credited_country(author_affiliation, places)
        .join(dated, "paper_id")
        .join(tags, "paper_id")
        .groupBy(*cell)
        .agg(
            F.count(F.lit(1)).alias("paper_count"),
            F.coalesce(F.sum("citations"), F.lit(0)).alias("total_citations"),
        )
    )
    return outputs.join(metrics, cell).select(
        "country",
        "field_of_study_id",
        "year",
        "paper_count",
        "total_citations",
        "name",
        "shannon_diversity",
        "rca_sum",
        "female_share",
    )


# --- paper lists --------------------------------------------------------------------------------------
# One row per key and paper, whatever the size of the key; ``list_counts`` has the length of each list.
def list_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("paper_id").alias("count"))


def papers_by_country(pairs: DataFrame) -> DataFrame:
    """country, paper_id from the distinct (paper_id, country) of ``indicators.paper_entities``."""
    return pairs.filter(F.col("country").isNotNull()).select("country", "paper_id")


def papers_by_topic(paper_fos: DataFrame, filtered: DataFrame, fos: DataFrame) -> DataFrame:
    """field_of_study_id, name, paper_id of the direct tags; a topic without papers has one row without a paper."""
    topics = filtered.select("field_of_study_id").distinct().join(
        fos.select(F.col("id").alias("field_of_study_id"), "name"), "field_of_study_id"
    )
    tags = paper_fos.select("field_of_study_id", "paper_id")
    return topics.join(tags, "field_of_study_id", "left").select("field_of_study_id", "name", "paper_id")


def papers_by_year(papers: DataFrame, year_thresh: str = config.PAPER_YEAR) -> DataFrame:
    """year, paper_id for the years after ``year_thresh``."""
    return papers.filter(F.col("year") > year_thresh).select("year", F.col("id").alias("paper_id"))


def paper_topic_names(paper_fos: DataFrame, filtered: DataFrame, fos: DataFrame) -> DataFrame:
    """id, field_of_study: one row per paper and name of a selected topic it carries."""
    names = fos.select(F.col("id").alias("field_of_study_id"), F.col("name").alias("field_of_study"))
    topics = filtered.select("field_of_study_id").distinct().join(names, "field_of_study_id")
    tags = paper_fos.select("paper_id", "field_of_study_id")
    return tags.join(topics, "field_of_study_id").select(F.col("paper_id").alias("id"), "field_of_study")


def topics_by_paper(paper_fos: DataFrame, filtered: DataFrame, fos: DataFrame) -> DataFrame:
    """id, field_of_study: sorted names of the selected topics a paper carries; never longer than those."""
    named = paper_topic_names(paper_fos, filtered, fos)
    return named.groupBy("id").agg(F.sort_array(F.collect_list("field_of_study")).alias("field_of_study"))


def flat_export(
    doc_vectors: DataFrame, papers: DataFrame, topic_names: DataFrame, paper_country: DataFrame
) -> DataFrame:
    """One row per projected paper, topic name (``paper_topic_names``) and country (``papers_by_country``)."""
    countries = paper_country.select("country", F.col("paper_id").alias("id"))
    return (
        doc_vectors.join(papers.select("id", "year"), "id")
        .join(topic_names, "id")
        .join(countries, "id")
        .select("id", "vector_3d", "citations", "year", "field_of_study", "country")
    )


# --- search documents ---------------------------------------------------------------------------------
def search_documents(papers: DataFrame, paper_fos: DataFrame, fos: DataFrame, authors: DataFrame) -> DataFrame:
    """One document per paper with a topic: attributes, topics and authors, each a list that only the paper bounds.

    ``authors`` are the rows of ``search_authors``.  They are gathered by paper, whose lists differ little in length;
    a paper without known authors has an empty list.
    """
    attributes = ["original_title", "abstract", "citations"]
    described = papers.dropna(subset=["id", "year", "date", *attributes]).select("id", "date", *attributes)
    topic = F.struct("name", F.col("field_of_study_id").alias("id"))
    topics = (
        paper_fos.select("paper_id", "field_of_study_id")
        .join(fos.select(F.col("id").alias("field_of_study_id"), "name"), "field_of_study_id")
        .groupBy(F.col("paper_id").alias("id"))
        .agg(F.sort_array(F.collect_list(topic)).alias("fields_of_study"))
    )
    author = F.struct("author_id", "name", "affiliation")
    written = authors.groupBy("id").agg(F.sort_array(F.collect_list(author)).alias("authors"))
    none = F.array().cast(written.schema["authors"].dataType)
    return described.join(topics, "id").join(written, "id", "left").select(
        "id",
        F.year(F.to_date("date")).alias("year"),
        F.col("date").alias("publication_date"),
        *attributes,
        "fields_of_study",
        F.coalesce("authors", none).alias("authors"),
    )


def search_authors(author_affiliation: DataFrame, authors: DataFrame, affiliation: DataFrame) -> DataFrame:
    """id (of the paper), author_id, name, affiliation: one row per known author and affiliation of a paper."""
    # Unplaced authorships are many and match nothing: each gets a key of its own instead of sharing the
    # null partition.
    unplaced = F.concat(F.lit("none "), F.pmod(F.xxhash64("author_id", "paper_id"), F.lit(1 << 20)).cast("string"))
    return (
        author_affiliation.join(authors.select(F.col("id").alias("author_id"), "name"), "author_id")
        .withColumn("_place", F.coalesce(F.col("affiliation_id").cast("string"), unplaced))
        .join(affiliation.select(F.col("id").cast("string").alias("_place"), "affiliation"), "_place", "left")
        .select(
            F.col("paper_id").alias("id"),
            "author_id",
            F.coalesce("name", F.lit("")).alias("name"),
            F.coalesce("affiliation", F.lit("")).alias("affiliation"),
        )
    )


def write_search_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def write_flat_export(export: DataFrame, path: str, compression: str = "gzip") -> None:
    export.write.mode("overwrite").option("compression", compression).parquet(path)
