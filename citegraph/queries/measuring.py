"""Topics and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.operators import indicators, topics
from citegraph.queries.graph import PAPERS, YEAR, Graph
from citegraph.queries.registry import query, rounded


# --- topics -------------------------------------------------------------------------------------------
@query("SELECT id, level, frequency FROM metadata")
def topic_frequency(g: Graph) -> DataFrame:
    return g.frequencies


@query(
    """, cuts AS (
        SELECT level, cast(floor(CASE level WHEN 1 THEN quantile_cont(frequency, 0.75)
            ELSE quantile_cont(frequency, 0.9) END) AS bigint) AS threshold
        FROM metadata WHERE level IN (1, 2) GROUP BY level)
    SELECT level, id AS field_of_study_id FROM metadata JOIN cuts USING (level) WHERE frequency > threshold"""
)
def filter_topics(g: Graph) -> DataFrame:
    return topics.filter_topics(g.frequencies, levels=[1, 2], percentiles=[75, 90])


@query(
    """, hops AS (
        SELECT id AS topic, id AS descendant, 0 AS hop FROM levels
        UNION SELECT topic, child, hop + 1 FROM hops JOIN edges ON parent = descendant WHERE hop < 5)
    SELECT DISTINCT topic AS field_of_study_id, descendant FROM hops"""
)
def topic_closure(g: Graph) -> DataFrame:
    roots = g.fields_of_study.select(F.col("id").alias("field_of_study_id"))
    return topics.topic_closure(g.hierarchy, roots)


@query(
    """SELECT topic AS field_of_study_id, year, count(*) AS paper_count,
        cast(sum(citations) AS bigint) AS total_citations,
        (SELECT string_agg(cast(descendant AS varchar), ',' ORDER BY descendant) FROM closure c
            WHERE c.topic = t.topic) AS all_children
    FROM topic_papers t JOIN papers ON id = paper_id GROUP BY topic, year"""
)
def yearly_topic_totals(g: Graph) -> DataFrame:
    g = g.hold("closure")
    totals = topics.yearly_topic_totals(g.paper_attributes, g.paper_fos, g.closure)
    return totals.withColumn("all_children", F.array_join(F.col("all_children").cast("array<string>"), ","))


# --- specialisation -----------------------------------------------------------------------------------
def paper_countries(g: Graph) -> DataFrame:
    return g.paper_countries


def country_fact(g: Graph) -> DataFrame:
    return indicators.base_fact(paper_countries(g), g.paper_attributes, g.paper_fos, g.filtered)


def affiliation_fact(g: Graph) -> DataFrame:
    pairs = indicators.paper_entities(g.places, g.affiliation_links, "affiliation_id")
    return indicators.base_fact(pairs, g.paper_attributes, g.paper_fos, g.filtered)


AFFILIATION_FACT = """
, affiliation_fact AS (
    SELECT f.field_of_study_id, a.affiliation_id, paper_id, citations, year
    FROM (SELECT DISTINCT paper_id, affiliation_id FROM author_affiliation JOIN places USING (affiliation_id)
        WHERE country IS DISTINCT FROM '') a
    JOIN papers ON id = paper_id JOIN paper_fos f USING (paper_id)
    WHERE f.field_of_study_id IN (SELECT field_of_study_id FROM filtered))
"""


def rca_sql(fact: str, entity: str) -> str:
    """CTE rca(entity, year, rca_sum, field_of_study_id)."""
    return f"""
, cells AS (
    SELECT field_of_study_id, {entity} AS entity, year, sum(citations) AS value, count(*) AS papers
    FROM {fact} WHERE year > '{YEAR}' GROUP BY ALL)
, entity_totals AS (SELECT entity, year, sum(value) AS e FROM cells WHERE entity IS NOT NULL GROUP BY ALL)
, topic_totals AS (SELECT field_of_study_id, year, sum(value) AS t FROM cells GROUP BY ALL)
, world_totals AS (SELECT year, sum(value) AS w FROM cells GROUP BY ALL)
, rca AS (
    SELECT entity, year, field_of_study_id, least(
        (cast(value AS double) / cast(e AS double)) / (cast(t AS double) / cast(w AS double)), 6) AS rca_sum
    FROM cells JOIN entity_totals USING (entity, year) JOIN topic_totals USING (field_of_study_id, year)
        JOIN world_totals USING (year)
    WHERE papers >= {PAPERS} AND e > {PAPERS} AND t > 0)
"""


@query("SELECT field_of_study_id, country, paper_id, citations, year FROM fact")
def base_fact_country(g: Graph) -> DataFrame:
    return country_fact(g)


@query(AFFILIATION_FACT + "SELECT * FROM affiliation_fact")
def base_fact_affiliation(g: Graph) -> DataFrame:
    return affiliation_fact(g)


@query(
    rca_sql("fact", "country")
    + "SELECT entity, year, round(rca_sum + 1e-9, 6) AS rca_sum, field_of_study_id FROM rca"
)
def country_rca(g: Graph) -> DataFrame:
    rca = indicators.rca_by_sum(country_fact(g), "country", paper_thresh=PAPERS, year_thresh=YEAR)
    return rounded(rca, "rca_sum")


@query(
    AFFILIATION_FACT
    + rca_sql("affiliation_fact", "affiliation_id")
    + "SELECT entity, year, round(rca_sum + 1e-9, 6) AS rca_sum, field_of_study_id FROM rca"
)
def affiliation_rca(g: Graph) -> DataFrame:
    rca = indicators.rca_by_sum(affiliation_fact(g), "affiliation_id", paper_thresh=PAPERS, year_thresh=YEAR)
    return rounded(rca, "rca_sum")


@query(
    f""", cells AS (
        SELECT field_of_study_id, country AS entity, year, count(*) AS n FROM fact WHERE year > '{YEAR}' GROUP BY ALL)
    , entity_totals AS (SELECT entity, year, sum(n) AS e FROM cells WHERE entity IS NOT NULL GROUP BY ALL)
    , topic_totals AS (SELECT field_of_study_id, year, sum(n) AS t FROM cells GROUP BY ALL)
    , world_totals AS (SELECT year, sum(n) AS w FROM cells GROUP BY ALL)
    SELECT entity, year, field_of_study_id, round((cast(n AS double) / cast(e AS double))
        / (cast(t AS double) / cast(w AS double)) + 1e-9, 6) AS rca_count
    FROM cells JOIN entity_totals USING (entity, year) JOIN topic_totals USING (field_of_study_id, year)
        JOIN world_totals USING (year) WHERE e > {PAPERS}"""
)
def country_rca_by_count(g: Graph) -> DataFrame:
    rca = indicators.rca_by_count(country_fact(g), "country", paper_thresh=PAPERS, year_thresh=YEAR)
    return rounded(rca, "rca_count")


# --- diversity ----------------------------------------------------------------------------------------
@query(
    """, counts AS (
        SELECT author_id, field_of_study_id, count(*) AS n FROM paper_authors JOIN paper_fos USING (paper_id)
        GROUP BY ALL)
    , totals AS (SELECT author_id, sum(n) AS total FROM counts GROUP BY 1)
    , shares AS (SELECT author_id, cast(n AS double) / cast(total AS double) AS p
        FROM counts JOIN totals USING (author_id))
    SELECT author_id, round(sum(p * p) + 1e-9, 6) AS dominance,
        round(greatest(-sum(p * log2(p)), 0) + 1e-9, 6) AS shannon,
        round(1 - sum(p * p) + 1e-9, 6) AS simpson, round(1 / sum(p * p) + 1e-9, 6) AS enspie, count(*) AS observed,
        round(1 / sum(p * p) / count(*) + 1e-9, 6) AS simpson_e
    FROM shares GROUP BY author_id"""
)
def diversity_indices(g: Graph) -> DataFrame:
    """Topic diversity of every author."""
    tagged = g.paper_authors.join(g.dealt(g.paper_fos, "paper_id"), "paper_id").select("author_id", "field_of_study_id")
    tagged = g.dealt(tagged, "author_id")
    indices = indicators.diversity(tagged, ["author_id"], "field_of_study_id")
    return rounded(indices, "dominance", "shannon", "simpson", "enspie", "simpson_e")


RESEARCH_DIVERSITY = f"""
, tag_counts AS (
    SELECT topic, year, country, descendant, count(*) AS n
    FROM closure JOIN paper_fos ON field_of_study_id = descendant JOIN paper_country USING (paper_id)
        JOIN papers ON id = paper_id
    WHERE country IS NOT NULL AND year >= '{YEAR}' GROUP BY ALL)
, tag_totals AS (SELECT topic, year, country, sum(n) AS total, count(*) AS observed FROM tag_counts GROUP BY ALL)
, tag_shares AS (
    SELECT topic, year, country, observed, cast(n AS double) / cast(total AS double) AS p
    FROM tag_counts JOIN tag_totals USING (topic, year, country) WHERE total > 10)
, research AS (
    SELECT topic AS field_of_study_id, year, country AS entity, greatest(-sum(p * log2(p)), 0) AS shannon_diversity,
        1 - sum(p * p) AS simpson_diversity, 1 / sum(p * p) / any_value(observed) AS simpson_e_diversity
    FROM tag_shares GROUP BY topic, year, country)
"""


@query(
    RESEARCH_DIVERSITY
    + """SELECT field_of_study_id, year, entity, round(shannon_diversity + 1e-9, 6) AS shannon_diversity,
        round(simpson_diversity + 1e-9, 6) AS simpson_diversity,
        round(simpson_e_diversity + 1e-9, 6) AS simpson_e_diversity
    FROM research"""
)
def research_diversity(g: Graph) -> DataFrame:
    return rounded(research(g.hold("closure")), "shannon_diversity", "simpson_diversity", "simpson_e_diversity")


def research(g: Graph) -> DataFrame:
    return indicators.research_diversity(
        paper_countries(g), g.paper_attributes, g.paper_fos, g.closure, fos_thresh=10, year_thresh=YEAR
    )


# --- gender -------------------------------------------------------------------------------------------
FEMALE_SHARE = """
, paper_gender AS (
    SELECT paper_id, count(*) FILTER (gender = 'female') AS f, count(*) FILTER (gender = 'male') AS m, count(*) AS n
    FROM author_affiliation JOIN gender ON id = author_id WHERE probability >= 0.7 GROUP BY paper_id)
, share AS (
    SELECT paper_id, cast(f AS double) / cast(n AS double) AS female_share FROM paper_gender WHERE f > 0 OR m = n)
"""
GENDER_DIVERSITY = (
    FEMALE_SHARE
    + """
, gendered AS (
    SELECT avg(female_share) AS female_share, year, country AS entity, field_of_study_id
    FROM fact JOIN share USING (paper_id) WHERE country IS NOT NULL GROUP BY ALL HAVING count(*) > 10)
"""
)


def female_share(g: Graph) -> DataFrame:
    return indicators.paper_female_share(g.author_affiliation, g.gender)


def gender(g: Graph) -> DataFrame:
    return indicators.gender_diversity(paper_countries(g), g.paper_attributes, g.paper_fos, female_share(g), g.filtered)


@query(FEMALE_SHARE + "SELECT paper_id, round(female_share + 1e-9, 6) AS female_share FROM share")
def paper_female_share(g: Graph) -> DataFrame:
    return rounded(female_share(g), "female_share")


@query(
    GENDER_DIVERSITY
    + "SELECT round(female_share + 1e-9, 6) AS female_share, year, entity, field_of_study_id FROM gendered"
)
def gender_diversity(g: Graph) -> DataFrame:
    return rounded(gender(g), "female_share")


@query(
    FEMALE_SHARE
    + """SELECT round(avg(female_share) + 1e-9, 6) AS female_share, year, country AS entity,
        topic AS field_of_study_id
    FROM topic_papers JOIN papers ON id = paper_id JOIN paper_country USING (paper_id) JOIN share USING (paper_id)
    WHERE country IS NOT NULL GROUP BY year, country, topic HAVING count(*) > 10"""
)
def gender_diversity_with_descendants(g: Graph) -> DataFrame:
    diversity = indicators.gender_diversity(
        paper_countries(g), g.paper_attributes, g.paper_fos, female_share(g), g.filtered, closure=g.closure
    )
    return rounded(diversity, "female_share")


# --- collaboration ------------------------------------------------------------------------------------
@query(
    f"""SELECT a.country AS country_a, b.country AS country_b, count(*) AS weight, year
    FROM paper_country a JOIN paper_country b USING (paper_id) JOIN papers ON id = paper_id
    WHERE a.country < b.country AND year > '{YEAR}' GROUP BY ALL"""
)
def country_collaboration(g: Graph) -> DataFrame:
    return indicators.country_collaboration(paper_countries(g), g.paper_attributes, YEAR)
