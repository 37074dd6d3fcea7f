"""From landed records to the tables of the publication graph.

``raw`` is a DataFrame of landed records with a sortable column ``ordinal`` giving listing order.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph import config
from citegraph.functions import dates, text


# --- one row per key ----------------------------------------------------------------------------------
def latest_per_key(df: DataFrame, key: str, order: str = "ordinal") -> DataFrame:
    """The last row of every key.  max_by combines before the shuffle, so many copies of one key cost
    one row per map task and not one overloaded window partition."""
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("_row"))
        .select("_row.*")
    )


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row of every key: the last one where ``ordinal`` tells the order, else one chosen by its content."""
    if "ordinal" in df.columns:
        return latest_per_key(df, key).drop("ordinal")
    content = F.xxhash64(*[F.to_json(F.struct(F.col(name))) for name in df.columns])
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), content).alias("_row")).select("_row.*")


def not_yet_stored(new: DataFrame, stored: DataFrame, key: str, stored_key: str | None = None) -> DataFrame:
    """Rows of ``new`` whose key is not in ``stored``: what an incremental run still has to process."""
    known = stored.select(F.col(stored_key or key).alias(key))
    return new.join(known, key, "left_anti")


def rows_to_append(new: DataFrame, stored: DataFrame, key: str, stored_key: str | None = None) -> DataFrame:
    """De-duplicate by key (last wins) and drop what is stored already.

    Copies go first, so that the anti-join meets one row per key and reuses the partitioning by key.
    """
    return not_yet_stored(latest_per_key(new, key), stored, key, stored_key)


# --- parsers ------------------------------------------------------------------------------------------
def papers(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("Id").alias("id"),
        "prob",
        F.col("Ti").alias("title"),
        F.col("Pt").alias("publication_type"),
        F.col("Y").cast("string").alias("year"),
        F.col("D").alias("date"),
        F.col("CC").alias("citations"),
        F.col("DN").alias("original_title"),
        F.col("RId").alias("references"),
        F.col("DOI").alias("doi"),
        F.col("PB").alias("publisher"),
        F.col("BT").alias("bibtex_doc_type"),
        text.abstract_from_inverted_index(F.col("IA.InvertedIndex")).alias("abstract"),
        F.get("S", F.lit(0))["U"].alias("source"),
    )


def journals(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("J").isNotNull()).select(
        F.col("J.JId").alias("id"), F.col("J.JN").alias("journal_name"), F.col("Id").alias("paper_id")
    )


def conferences(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("C").isNotNull()).select(
        F.col("C.CId").alias("id"), F.col("C.CN").alias("conference_name"), F.col("Id").alias("paper_id")
    )


def _author_rows(raw: DataFrame) -> DataFrame:
    return raw.select("ordinal", F.col("Id").alias("paper_id"), F.posexplode("AA").alias("pos", "a"))


def _last_name(rows: DataFrame, id_: str, name: str, alias: str) -> DataFrame:
    """id and the name seen last; ties within a record go to the later list element."""
    return (
        rows.filter(F.col(id_).isNotNull())
        .groupBy(F.col(id_).alias("id"))
        .agg(F.max_by(F.col(name), F.struct("ordinal", "pos")).alias(alias))
    )


def authors(raw: DataFrame) -> DataFrame:
    return _last_name(_author_rows(raw), "a.AuId", "a.DAuN", "name")


def paper_authors(raw: DataFrame) -> DataFrame:
    return (
        _author_rows(raw)
        .select("paper_id", F.col("a.AuId").alias("author_id"), F.col("a.S").alias("order"))
        .distinct()
    )


def _topic_rows(raw: DataFrame) -> DataFrame:
    return raw.select("ordinal", F.col("Id").alias("paper_id"), F.posexplode("F").alias("pos", "f"))


def fields_of_study(raw: DataFrame) -> DataFrame:
    return _last_name(_topic_rows(raw), "f.FId", "f.DFN", "name")


def paper_fields_of_study(raw: DataFrame) -> DataFrame:
    return _topic_rows(raw).select("paper_id", F.col("f.FId").alias("field_of_study_id")).distinct()


def _affiliation_rows(raw: DataFrame) -> DataFrame:
    return _author_rows(raw).withColumn("affiliation_id", F.nullif(F.col("a.AfId"), F.lit(0)))


def affiliations(raw: DataFrame) -> DataFrame:
    return _last_name(_affiliation_rows(raw), "affiliation_id", "a.AfN", "affiliation")


def author_affiliation(raw: DataFrame) -> DataFrame:
    return (
        _affiliation_rows(raw)
        .select("affiliation_id", F.col("a.AuId").alias("author_id"), "paper_id")
        .distinct()
    )


# --- titles, topics, dates ----------------------------------------------------------------------------
def best_match_per_title(entities: DataFrame) -> DataFrame:
    """Ids with the highest ``logprob`` of their title; the id seen first wins a tie.

    ``entities`` has Id, Ti, logprob and ordinal.  If an id repeats within a title its last probability
    counts, at the place where the id was first seen.  An unknown probability is lower than any other.
    """
    per_id = entities.groupBy("Ti", "Id").agg(
        F.max_by("logprob", "ordinal").alias("logprob"), F.min("ordinal").alias("seen")
    )
    # A known probability first, the highest of these, then the smallest place: all in one comparable struct.
    best = F.min_by("Id", F.struct(F.col("logprob").isNull(), (-F.col("logprob")).alias("p"), "seen"))
    return per_id.groupBy("Ti").agg(best.alias("Id")).select("Id").distinct()


def topic_metadata(topics: DataFrame, fields_of_study: DataFrame, stored: DataFrame) -> DataFrame:
    """id, level and a still unknown frequency for topics that are ours and not yet described."""
    return _new_topics(topics, fields_of_study, stored).select(
        F.col("Id").alias("id"), F.col("FL").alias("level"), F.lit(None).cast("long").alias("frequency")
    )


def topic_hierarchy(topics: DataFrame, fields_of_study: DataFrame, stored: DataFrame) -> DataFrame:
    """id, child_id, parent_id restricted to known topics; absent list -> null, no overlap -> empty."""
    fresh = _new_topics(topics, fields_of_study, stored).select("Id", "FC", "FP")
    known = fields_of_study.select(F.col("id").alias("other"))

    def linked(column: str, alias: str) -> DataFrame:
        links = fresh.select("Id", F.explode(column).alias("link")).select("Id", F.col("link.FId").alias("other"))
        return (
            links.join(known, "other", "left_semi")
            .groupBy("Id")
            .agg(F.sort_array(F.collect_set("other")).alias(alias))
        )

    empty = F.array().cast("array<long>")
    return (
        fresh.join(linked("FC", "children"), "Id", "left")
        .join(linked("FP", "parents"), "Id", "left")
        .select(
            F.col("Id").alias("id"),
            F.when(F.col("FC").isNotNull(), F.coalesce("children", empty)).alias("child_id"),
            F.when(F.col("FP").isNotNull(), F.coalesce("parents", empty)).alias("parent_id"),
        )
    )


def _new_topics(topics: DataFrame, fields_of_study: DataFrame, stored: DataFrame) -> DataFrame:
    ours = fields_of_study.select(F.col("id").alias("Id"))
    known = stored.select(F.col("id").alias("Id"))
    return one_per_key(topics, "Id").join(ours, "Id", "left_semi").join(known, "Id", "left_anti")


def assign_intervals(
    papers: DataFrame,
    start: str = config.START_DATE,
    end: str = config.END_DATE,
    intervals_in_a_year: int = config.INTERVALS_IN_A_YEAR,
    date_col: str = "date",
) -> DataFrame:
    """Add the collection interval(s) of a paper's date; a boundary day belongs to both neighbours.

    Equal spans make the interval number plain arithmetic, so there is no range join: each row tries the
    few numbers around its date and keeps those whose inclusive bounds hold it.
    """
    first, last = dates.parse_date(start), dates.parse_date(end)
    count = dates.interval_count(first, last, intervals_in_a_year)
    return date_intervals_of(papers, first, last, count, date_col)


def date_intervals_of(
    papers: DataFrame, first: datetime, last: datetime, count: int, date_col: str = "date"
) -> DataFrame:
    day = F.to_date(date_col)
    numbered = papers.withColumn(
        "_interval", F.explode(dates.candidate_indexes(day, first, last, count))
    )
    starts = dates.boundary(first, last, count, F.col("_interval"))
    ends = dates.boundary(first, last, count, F.col("_interval") + 1)
    return (
        numbered.withColumn("interval_start", starts)
        .withColumn("interval_end", ends)
        .filter(day.between(F.col("interval_start"), F.col("interval_end")))
        .drop("_interval")
        .withColumn("interval_start", F.date_format("interval_start", "yyyy-MM-dd"))
        .withColumn("interval_end", F.date_format("interval_end", "yyyy-MM-dd"))
    )
