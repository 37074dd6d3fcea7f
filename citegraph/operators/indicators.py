"""Country- and institution-level indicators.

Every indicator is one grouped query over all topics and years at once.  Facts are reduced to distinct
(paper, entity) pairs before they meet the topics, so a paper with very many authors weighs no more than
its number of countries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from citegraph import config
from citegraph.functions import maths
from citegraph.session import materialise


def paper_entities(places: DataFrame, author_affiliation: DataFrame, entity_col: str = "country") -> DataFrame:
    """Distinct (paper_id, entity) for located affiliations.

    Only the empty country is dropped.  A null country stays: its papers count in world totals although
    they form no entity.
    """
    located = places.filter(~F.col("country").eqNullSafe(F.lit(""))).select("affiliation_id", "country")
    links = author_affiliation.select("paper_id", "affiliation_id")
    return links.join(located, "affiliation_id").select("paper_id", entity_col).distinct()


def base_fact(
    pairs: DataFrame,
    papers: DataFrame,
    paper_fos: DataFrame,
    topics: DataFrame | None = None,
    year: Column | None = None,
) -> DataFrame:
    """field_of_study_id, entity, paper_id, citations, year: one row per topic, entity and paper.

    ``pairs`` comes from ``paper_entities``; its second column names the entity.  ``papers`` and
    ``paper_fos`` are unique by their primary keys, so the joins keep the pairs distinct without another
    shuffle.  ``topics`` restricts the tags to the ids in its column field_of_study_id; ``year`` is an
    optional predicate that reaches the scan of the papers.
    """
    (entity_col,) = [name for name in pairs.columns if name != "paper_id"]
    dated = papers if year is None else papers.filter(year)
    dated = dated.select(F.col("id").alias("paper_id"), "year", "citations")
    tags = paper_fos.select("paper_id", "field_of_study_id")
    if topics is not None:
        tags = tags.join(topics.select("field_of_study_id"), "field_of_study_id", "left_semi")
    return (
        pairs.join(dated, "paper_id")
        .join(tags, "paper_id")
        .select("field_of_study_id", entity_col, "paper_id", "citations", "year")
    )


def topic_cells(fact: DataFrame, entity_col: str, value: str = "citations") -> DataFrame:
    """field_of_study_id, entity, year with the summed ``value`` and the number of ``papers``.

    Everything that compares entities is computed from this small table, null entities included.
    """
    return fact.groupBy("field_of_study_id", F.col(entity_col).alias("entity"), "year").agg(
        F.coalesce(F.sum(value), F.lit(0)).alias("value"), F.count("paper_id").alias("papers")
    )


# --- revealed comparative advantage -------------------------------------------------------------------
def _advantage(cells: DataFrame, measure: str, entity_filter: Column, cell_filter: Column, name: str) -> DataFrame:
    """(cell / entity total) / (topic total / world total) per topic, entity and year.

    The totals are aggregates of the small cell table joined back, not windows: a window over the year
    alone would gather every cell of a year in one task.
    """
    entities = (
        cells.filter(F.col("entity").isNotNull())
        .groupBy("entity", "year")
        .agg(F.sum(measure).alias("_entity"))
        .filter(entity_filter)
    )
    topics = cells.groupBy("field_of_study_id", "year").agg(F.sum(measure).alias("_topic"))
    world = cells.groupBy("year").agg(F.sum(measure).alias("_world"))
    ratio = maths.ratio_of_ratios(F.col(measure), F.col("_entity"), F.col("_topic"), F.col("_world"))
    return (
        cells.filter(F.col("entity").isNotNull() & cell_filter)
        .join(entities, ["entity", "year"])
        .join(topics, ["field_of_study_id", "year"])
        .join(F.broadcast(world), "year")  # one row per year
        .select("entity", "year", ratio.alias(name), "field_of_study_id")
        .filter(F.col(name).isNotNull())
    )


def rca_by_sum(
    fact: DataFrame,
    entity_col: str,
    value: str = "citations",
    paper_thresh: int = config.MIN_PAPERS,
    year_thresh: str = config.METRIC_YEAR,
    cap: float = config.RCA_CAP,
) -> DataFrame:
    """Specialisation on summed values of the rows of ``fact``; see ``rca_of_cells``.

    The cells, one row per topic, entity and year, are stored once, so the fact is evaluated once.
    """
    cells = materialise(topic_cells(fact.filter(F.col("year") > year_thresh), entity_col, value))
    return rca_of_cells(cells, paper_thresh, year_thresh, cap)


def rca_of_cells(
    cells: DataFrame,
    paper_thresh: int = config.MIN_PAPERS,
    year_thresh: str = config.METRIC_YEAR,
    cap: float = config.RCA_CAP,
) -> DataFrame:
    """entity, year, rca_sum, field_of_study_id for years after ``year_thresh``.

    An (entity, year) qualifies for a topic with at least ``paper_thresh`` papers on it, and only if the
    entity's value over all topics exceeds that same threshold.  ``cells`` is read for the cells and for each
    of the three totals: pass a stored table.
    """
    cells = cells.filter(F.col("year") > year_thresh)
    rca = _advantage(
        cells, "value", F.col("_entity") > paper_thresh, F.col("papers") >= paper_thresh, "rca_sum"
    ).withColumn("rca_sum", F.least("rca_sum", F.lit(cap)))
    return rca.select("entity", "year", "rca_sum", "field_of_study_id")


def rca_by_count(
    fact: DataFrame,
    entity_col: str,
    paper_thresh: int = config.MIN_PAPERS,
    year_thresh: str = config.METRIC_YEAR,
) -> DataFrame:
    """entity, year, rca_count, field_of_study_id on paper counts: no topic minimum and no cap."""
    cells = materialise(topic_cells(fact.filter(F.col("year") > year_thresh), entity_col))
    return _advantage(cells, "papers", F.col("_entity") > paper_thresh, F.lit(True), "rca_count")


# --- diversity ----------------------------------------------------------------------------------------
DIVERSITY_COLUMNS = ("dominance", "shannon", "simpson", "enspie", "observed", "simpson_e")


def _diversity_aggregates(n: Column) -> list[Column]:
    n = n.cast("double")
    return [
        F.sum(n).alias("_n"),
        F.sum(n * n).alias("_squares"),
        F.sum(F.when(n > 0, n * F.ln(n)).otherwise(0.0)).alias("_n_ln_n"),
        F.sum((n > 0).cast("long")).alias("observed"),
    ]


def _diversity_columns(base: float) -> dict[str, Column]:
    n = F.when(F.col("_n") > 0, F.col("_n"))
    dominance = F.col("_squares") / (n * n)
    entropy = (F.ln(n) - F.col("_n_ln_n") / n) / F.lit(math.log(base))
    return {
        "dominance": dominance,
        # A single category leaves a rounding residue around zero.
        "shannon": F.when(n.isNotNull(), F.greatest(entropy, F.lit(0.0))),
        "simpson": 1 - dominance,
        "enspie": 1 / dominance,
        "observed": F.col("observed"),
        "simpson_e": 1 / dominance / F.when(F.col("observed") > 0, F.col("observed")),
    }


def diversity(
    df: DataFrame,
    group_cols: list[str],
    category_col: str,
    base: float = 2,
    count_col: str | None = None,
) -> DataFrame:
    """Six diversity indices of the category counts in each group.

    Rows are counted unless ``count_col`` holds the counts; those must be non-negative integers.
    """
    if count_col is None:
        counts = df.groupBy(*group_cols, category_col).agg(F.count(F.lit(1)).alias("_count"))
    else:
        if not isinstance(df.schema[count_col].dataType, IntegralType):
            raise ValueError("counts must be integers")
        checked = F.when(
            F.col(count_col) < 0, F.raise_error(F.lit("counts must not be negative")).cast("long")
        ).otherwise(F.col(count_col))
        counts = df.groupBy(*group_cols, category_col).agg(F.sum(checked).alias("_count"))
    indices = _diversity_columns(base)
    return counts.groupBy(*group_cols).agg(*_diversity_aggregates(F.col("_count"))).select(
        *group_cols, *[indices[name].alias(name) for name in DIVERSITY_COLUMNS]
    )


def closure_topics(closure: DataFrame) -> DataFrame:
    """field_of_study_id of everything below (and including) the topics of a closure."""
    return closure.select(F.col("descendant").alias("field_of_study_id")).distinct()


def research_diversity(
    pairs: DataFrame,
    papers: DataFrame,
    paper_fos: DataFrame,
    closure: DataFrame,
    fos_thresh: int = config.MIN_TOPICS,
    year_thresh: str = config.METRIC_YEAR,
) -> DataFrame:
    """Diversity of the descendants of each topic that a country publishes on, per year."""
    fact = base_fact(pairs, papers, paper_fos, closure_topics(closure), F.col("year") >= year_thresh)
    return research_diversity_of_cells(topic_cells(fact, "country"), closure, fos_thresh, year_thresh)


def research_diversity_of_cells(
    cells: DataFrame,
    closure: DataFrame,
    fos_thresh: int = config.MIN_TOPICS,
    year_thresh: str = config.METRIC_YEAR,
) -> DataFrame:
    """The same from topic cells that cover the closure.

    The number of papers of a country on one topic in one year is the same under every ancestor, so it
    is counted once and only those counts are joined to the closure.
    """
    counts = cells.filter(F.col("entity").isNotNull() & (F.col("year") >= year_thresh)).select(
        F.col("field_of_study_id").alias("descendant"), "entity", "year", "papers"
    )
    indices = _diversity_columns(2)
    return (
        counts.join(closure, "descendant")
        .groupBy("field_of_study_id", "year", "entity")
        .agg(*_diversity_aggregates(F.col("papers")))
        .filter(F.col("_n") > fos_thresh)
        .select(
            indices["shannon"].alias("shannon_diversity"),
            indices["simpson_e"].alias("simpson_e_diversity"),
            indices["simpson"].alias("simpson_diversity"),
            "year",
            "entity",
            "field_of_study_id",
        )
    )


# --- gender -------------------------------------------------------------------------------------------
def paper_female_share(
    author_affiliation: DataFrame, gender: DataFrame, thresh: float = config.GENDER_PROBABILITY
) -> DataFrame:
    """paper_id, female_share over the author-affiliation rows with a sufficiently certain gender.

    An all-male paper gets 0.0.  Any other paper without a female row has no share.
    """
    certain = gender.filter(F.col("probability") >= thresh).select(F.col("id").alias("author_id"), "gender")
    return (
        author_affiliation.select("paper_id", "author_id")
        .join(certain, "author_id")
        .groupBy("paper_id")
        .agg(
            F.count_if(F.col("gender") == "female").alias("_female"),
            F.count_if(F.col("gender") == "male").alias("_male"),
            F.count(F.lit(1)).alias("_all"),
        )
        .filter((F.col("_female") > 0) | (F.col("_male") == F.col("_all")))
        .select("paper_id", (F.col("_female") / F.col("_all")).alias("female_share"))
    )


def gender_diversity(
    pairs: DataFrame,
    papers: DataFrame,
    paper_fos: DataFrame,
    female_share: DataFrame,
    topics: DataFrame,
    paper_thresh: int = config.MIN_PAPERS,
    closure: DataFrame | None = None,
) -> DataFrame:
    """Mean female share per topic, year and country with more than ``paper_thresh`` papers.

    Papers count for the topics they carry directly; pass ``closure`` to include descendants.
    """
    if closure is not None:
        links = paper_fos.select("paper_id", F.col("field_of_study_id").alias("descendant"))
        paper_fos = links.join(closure, "descendant").select("paper_id", "field_of_study_id").distinct()
    fact = base_fact(pairs.filter(F.col("country").isNotNull()), papers, paper_fos, topics)
    return (
        fact.filter(F.col("year").isNotNull())
        .join(female_share, "paper_id")
        .groupBy("field_of_study_id", "year", "country")
        .agg(F.avg("female_share").alias("female_share"), F.count(F.lit(1)).alias("_papers"))
        .filter(F.col("_papers") > paper_thresh)
        .select("female_share", "year", F.col("country").alias("entity"), "field_of_study_id")
    )


# --- collaboration ------------------------------------------------------------------------------------
def country_collaboration(
    pairs: DataFrame, papers: DataFrame, year: str = config.COLLABORATION_YEAR
) -> DataFrame:
    """country_a < country_b, weight = papers they share, per year after ``year``.

    Papers are first grouped by their whole set of countries, so pairs are formed once per distinct set
    and year and carry the number of papers behind them.  A set is never longer than the list of
    countries.
    """
    dated = papers.filter(F.col("year") > year).select(F.col("id").alias("paper_id"), "year")
    sets = (
        pairs.filter(F.col("country").isNotNull())
        .groupBy("paper_id")
        .agg(F.sort_array(F.collect_set("country")).alias("countries"))
        .filter(F.size("countries") > 1)
        .join(dated, "paper_id")
        .groupBy("year", "countries")
        .agg(F.count(F.lit(1)).alias("papers"))
    )
    # The set is sorted, so everything after position i is the larger end of a pair.
    return (
        sets.select("year", "papers", "countries", F.posexplode("countries").alias("i", "country_a"))
        .select(
            "year",
            "papers",
            "country_a",
            F.explode(F.slice("countries", F.col("i") + 2, F.size("countries"))).alias("country_b"),
        )
        .groupBy("country_a", "country_b", "year")
        .agg(F.sum("papers").alias("weight"))
        .select("country_a", "country_b", "weight", "year")
    )
