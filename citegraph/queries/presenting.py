"""Vectors and output tables."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCAModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph import config
from citegraph.operators import indicators, outputs, vectors
from citegraph.operators.lists import dense_index
from citegraph.queries import algebra, measuring
from citegraph.queries.graph import PAPERS, YEAR, Graph
from citegraph.queries.registry import query, rounded
from citegraph.session import materialise, staged_path, staging

# --- mean vectors and neighbours ----------------------------------------------------------------------
_MEANS = """
, embedded AS (
    SELECT topic, year, country, paper_id, unnest(cast(vector AS double[])) AS x,
        generate_subscripts(vector, 1) AS pos
    FROM topic_papers JOIN papers ON papers.id = paper_id JOIN paper_country USING (paper_id)
        JOIN vectors ON vectors.id = paper_id WHERE country IS NOT NULL)
, means AS (
    SELECT topic AS field_of_study_id, year, country, pos, avg(x) AS x, count(*) AS n
    FROM embedded GROUP BY ALL HAVING count(*) > 2)
"""


def _country_vectors(g: Graph, year: str | None = None) -> DataFrame:
    pairs = measuring.paper_countries(g)
    return vectors.country_vectors(pairs, g.paper_attributes, g.paper_fos, g.vectors, g.closure, year=year)


@query(_MEANS + "SELECT field_of_study_id, year, country, cast(pos - 1 AS integer) AS pos, round(x + 1e-9, 6) AS x, n FROM means")
def country_vectors(g: Graph) -> DataFrame:
    exploded = _country_vectors(g).select(
        "field_of_study_id", "year", "country", F.posexplode("vector").alias("pos", "x"), "n"
    )
    return rounded(exploded, "x")


@query(
    _MEANS
    + f"""
, points AS (
    SELECT field_of_study_id, year, country, list(cast(cast(x AS float) AS double) ORDER BY pos) AS v
    FROM means WHERE year > '{YEAR}' GROUP BY ALL)
, crowded AS (SELECT field_of_study_id, year FROM points GROUP BY ALL HAVING count(*) > 5)
, distances AS (
    SELECT a.field_of_study_id, a.year, a.country AS country_a, b.country AS country_b,
        list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS closeness
    FROM points a JOIN points b ON a.field_of_study_id = b.field_of_study_id AND a.year = b.year
        AND a.country <> b.country
    JOIN crowded c ON c.field_of_study_id = a.field_of_study_id AND c.year = a.year)
SELECT country_a, country_b, round(closeness + 1e-9, 6) AS closeness, year, field_of_study_id FROM distances
QUALIFY row_number() OVER (PARTITION BY field_of_study_id, year, country_a ORDER BY closeness, country_b) <= 5"""
)
def country_similarity(g: Graph) -> DataFrame:
    near = vectors.country_similarity(_country_vectors(g, YEAR), year=YEAR)
    return rounded(near, "closeness")


@query(
    """, v AS (SELECT vec_id AS id, cast(embedding AS double[]) AS v FROM embeddings)
    , pairs AS (
        SELECT q.id AS query_id, c.id, list_sum(list_transform(list_zip(q.v, c.v),
            lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM v q, v c)
    SELECT query_id, id, round(distance + 1e-9, 6) AS distance,
        cast(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS integer) AS rank
    FROM pairs QUALIFY rank <= 5"""
)
def nearest_documents(g: Graph) -> DataFrame:
    points = g.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rounded(vectors.nearest_neighbours(points, points, 5), "distance")


@query(
    """, numbered AS (
        SELECT cast(row_number() OVER (ORDER BY label, vec_id) - 1 AS bigint) AS id,
            cast(embedding AS double[]) AS v FROM embeddings)
    , pairs AS (
        SELECT q.id AS query_id, c.id, list_sum(list_transform(list_zip(q.v, c.v),
            lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
        FROM numbered q, numbered c WHERE q.id <> c.id)
    SELECT query_id, id, round(distance + 1e-9, 6) AS distance,
        cast(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS integer) AS rank
    FROM pairs QUALIFY rank <= 3"""
)
def nearest_positions(g: Graph) -> DataFrame:
    """Neighbours by position in (label, vec_id) order, for vectors without ids of their own; searched
    cell by cell."""
    numbered = dense_index(g.table("embeddings").select("label", "vec_id", "embedding"), ["label", "vec_id"], "id")
    points = numbered.select("id", F.col("embedding").alias("vector"))
    return rounded(vectors.nearest_neighbours(points, points, 3, exclude_self=True, block_rows=100, cells=16), "distance")


# --- text vectors -------------------------------------------------------------------------------------
def _documents(g: Graph) -> DataFrame:
    return g.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("abstract"))


_STOP_WORDS = ("the", "and", "of", "in", "to", "le", "la", "de", "en", "el")
_WEIGHTS = f""", tokens AS (
        SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents)
    , counted AS (
        SELECT id, term, count(*) AS tf FROM tokens
        WHERE term NOT IN ({", ".join(f"'{word}'" for word in _STOP_WORDS)}) GROUP BY ALL)
    , vocabulary AS (
        SELECT term, ln((1.0 + (SELECT count(*) FROM documents WHERE text IS NOT NULL)) / (1.0 + count(*))) + 1 AS idf
        FROM counted GROUP BY term)
    , weighted AS (SELECT id, term, tf * idf AS w FROM counted JOIN vocabulary USING (term))
    , weights AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM weighted)"""


@query(_WEIGHTS + " SELECT id, term, round(w + 1e-9, 6) AS weight FROM weights")
def tfidf_weights(g: Graph) -> DataFrame:
    return rounded(vectors.tfidf_weights(_documents(g), stop_words=_STOP_WORDS), "weight")


def _start(j: int) -> str:
    return f"cast('0x' || substr(md5(term || '/{j}'), 1, 8) AS bigint) / 4294967296.0 - 0.5"


@query(
    _WEIGHTS
    + f"""
    , start AS (SELECT DISTINCT term, {_start(0)} AS x, {_start(1)} AS y FROM weights)
    , once AS (SELECT id, sum(w * x) AS x, sum(w * y) AS y FROM weights JOIN start USING (term) GROUP BY id)
    , space AS (SELECT term, sum(w * x) AS x, sum(w * y) AS y FROM weights JOIN once USING (id) GROUP BY term)
    , gram AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM space)
    , placed AS (SELECT id, sum(w * x) AS x, sum(w * y) AS y FROM weights JOIN space USING (term) GROUP BY id)
    SELECT doc_id AS id, round(coalesce((x * x * yy - 2 * x * y * xy + y * y * xx) / (xx * yy - xy * xy), 0) + 1e-9, 6)
        AS length FROM documents LEFT JOIN placed ON id = doc_id, gram WHERE text IS NOT NULL"""
)
def tfidf_svd_one_pass(g: Graph) -> DataFrame:
    """Two columns after one pass on the terms: the plane itself, before anything has converged."""
    embedded, _ = vectors.tfidf_svd_vectors(_documents(g), k=2, stop_words=_STOP_WORDS, passes=1, oversample=0, on="terms")
    return _lengths(embedded)


def _lengths(embedded: DataFrame) -> DataFrame:
    """Axes are only defined up to sign, the length of a document in their space is not."""
    length = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    return rounded(embedded.select("id", length.alias("length")), "length")


_COMPONENTS = 10
_SUBSPACE = _WEIGHTS + algebra.subspace("weights", _COMPONENTS + config.SVD_OVERSAMPLE, config.SVD_PASSES)


@query(
    _SUBSPACE
    + f"""
    , placed AS (
        SELECT id, sum(u * u * value) AS length
        FROM (SELECT id, rank, value, sum(x * e) AS u FROM space JOIN best ON i = j WHERE rank <= {_COMPONENTS} GROUP BY ALL)
        GROUP BY id)
    SELECT doc_id AS id, round(coalesce(length, 0) + 1e-9, 6) AS length
    FROM documents LEFT JOIN placed ON id = doc_id WHERE text IS NOT NULL"""
)
def tfidf_svd(g: Graph) -> DataFrame:
    """Ten columns with the operator's own passes and spare columns."""
    embedded, _ = vectors.tfidf_svd_vectors(_documents(g), k=_COMPONENTS, stop_words=_STOP_WORDS, on="documents")
    return _lengths(embedded)


@query(
    _SUBSPACE
    + f"""
    , errors AS (
        SELECT rank, value, sum((z - value * u) * (z - value * u)) AS error
        FROM (
            SELECT id, rank, value, sum(a.x * e) AS u, sum(b.x * e) AS z
            FROM space a JOIN image b USING (id, j) JOIN best ON i = j WHERE rank <= {_COMPONENTS} GROUP BY ALL)
        GROUP BY ALL)
    SELECT cast(rank AS integer) AS component, round(sqrt(value) + 1e-9, 6) AS singular_value,
        round(sqrt(error) / max(value) OVER () + 1e-9, 6) AS residual FROM errors"""
)
def tfidf_singular_values(g: Graph) -> DataFrame:
    """The singular values with their residuals, which neither sign nor rotation changes."""
    with staging(g.spark):
        weights = materialise(vectors.tfidf_weights(_documents(g), stop_words=_STOP_WORDS, placed=True), outlive=True)
    *_, found = vectors.svd_vectors(weights, _COMPONENTS, on="documents")
    rows = [(i + 1, float(v), float(r)) for i, (v, r) in enumerate(zip(found.values, found.residuals))]
    return rounded(g.spark.createDataFrame(rows, "component int, singular_value double, residual double"), "singular_value", "residual")


def _shape_of_text(texts: list[str]) -> list[list[float]]:
    """A stand-in encoder: characters, spaces and lines of the whole text."""
    return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]


@query(
    """SELECT id, cast(length(abstract) AS double) AS chars,
        cast(length(abstract) - length(replace(abstract, ' ', '')) AS double) AS spaces,
        cast(length(abstract) - length(replace(abstract, chr(10), '')) AS double) AS lines
    FROM papers WHERE abstract IS NOT NULL AND id NOT IN (SELECT vec_id FROM embeddings WHERE label <> 3)"""
)
def encode_documents(g: Graph) -> DataFrame:
    """Documents whose vector has another label than the one to be encoded anew have been encoded before."""
    stored = g.table("embeddings").filter("label <> 3").select(F.col("vec_id").alias("id"))
    encoded = vectors.encode_documents(g.papers, _shape_of_text, stored)
    return encoded.select("id", *[F.col("vector")[i].alias(n) for i, n in enumerate(("chars", "spaces", "lines"))])


def _word_lengths(texts: list[str]) -> list[np.ndarray]:
    """A stand-in word encoder: one row (length, 1) per space-separated word."""
    return [np.array([[len(word), 1.0] for word in t.split(" ")]) for t in texts]


@query(
    """SELECT doc_id AS id, round(cast(length(replace(text, ' ', '')) AS double)
        / (1 + length(text) - length(replace(text, ' ', ''))) + 1e-9, 6) AS mean_length, 1.0::double AS ones
    FROM documents WHERE text IS NOT NULL"""
)
def encode_words(g: Graph) -> DataFrame:
    encoded = vectors.encode_documents(_documents(g), _word_lengths, word_vectors=True)
    lengths = encoded.select("id", F.col("vector")[0].alias("mean_length"), F.col("vector")[1].alias("ones"))
    return rounded(lengths, "mean_length")


# --- projection ---------------------------------------------------------------------------------------
_EXCLUDED = (3, 14, 159, 265)


def _projectable(g: Graph) -> DataFrame:
    return vectors.projectable(g.vectors, g.papers, _EXCLUDED)


@query(
    f"""SELECT id, citations FROM papers WHERE id NOT IN {_EXCLUDED}
    AND length(abstract) >= 300"""
)
def projectable_documents(g: Graph) -> DataFrame:
    return _projectable(g).select("id", "citations")


_DIMENSIONS = 64


def _coordinates(fitted: str = "true", placed: str = "true") -> str:
    """CTE ``coordinates`` (id, citations, x, y, z): lengths along the principal axes of the ``fitted`` documents.

    The sign of an axis is not defined; its coordinates are compared without it.
    """
    axis = lambda n: f"round(max(c) FILTER (rank = {n}) + 1e-9, 6)"
    return (
        f"""
    , chosen AS (
        SELECT p.id, citations, cast(vector AS double[]) AS v FROM papers p JOIN vectors USING (id)
        WHERE p.id NOT IN {_EXCLUDED} AND length(abstract) >= 300)
    , numbers AS MATERIALIZED (
        SELECT id, citations, cast(unnest(range({_DIMENSIONS})) AS integer) AS j, unnest(v) AS x FROM chosen)
    , centred AS MATERIALIZED (SELECT id, j, x - avg(x) OVER (PARTITION BY j) AS x FROM numbers WHERE {fitted})"""
        + algebra.inner("spread", "centred", "centred")
        + algebra.eigen("axes", "spread", _DIMENSIONS)
        + f"""
    , coordinates AS (
        SELECT id, citations, {axis(1)} AS x, {axis(2)} AS y, {axis(3)} AS z
        FROM (SELECT id, citations, rank, abs(sum(x * e)) AS c FROM numbers JOIN axes ON i = j
            WHERE rank <= 3 AND {placed} GROUP BY ALL)
        GROUP BY ALL)"""
    )


def _unsigned(projected: DataFrame, *columns: str) -> DataFrame:
    axes = [F.abs(F.col("vector_3d")[i]).alias(n) for i, n in enumerate("xyz")]
    return rounded(projected.select(*columns, *axes), *"xyz")


@query(_coordinates() + " SELECT * FROM coordinates")
def projection(g: Graph) -> DataFrame:
    documents = _projectable(g)
    return _unsigned(vectors.project(documents, vectors.fit_projection(documents)), "id", "citations")


@query(_coordinates("id % 3 <> 0", "id % 3 = 0") + " SELECT * FROM coordinates")
def projection_of_new_documents(g: Graph) -> DataFrame:
    """Two months: the axes of what was there first are saved, and later place only the documents that came since."""
    first = g.papers.filter("id % 3 <> 0")
    path = staged_path(g.spark)
    with staging(g.spark):
        fitted = materialise(vectors.projectable(g.vectors, first, _EXCLUDED))
        model = vectors.fit_projection(fitted)
        model.write().overwrite().save(path)
        stored = materialise(vectors.project(fitted, model).select("id"))
        new = vectors.projectable(g.vectors, g.papers, _EXCLUDED, stored=stored)
        return materialise(_unsigned(vectors.project(new, PCAModel.load(path)), "id", "citations"), outlive=True)


# --- output tables ------------------------------------------------------------------------------------
_METRICS = (
    measuring.RESEARCH_DIVERSITY
    + measuring.GENDER_DIVERSITY
    + measuring.rca_sql("fact", "country")
    + """
, metrics AS (
    SELECT year, entity AS country, round(shannon_diversity + 1e-9, 6) AS shannon_diversity, field_of_study_id,
        round(rca_sum + 1e-9, 6) AS rca_sum, round(female_share + 1e-9, 6) AS female_share, name
    FROM research JOIN rca USING (year, entity, field_of_study_id)
        JOIN gendered USING (year, entity, field_of_study_id) JOIN levels ON id = field_of_study_id)
"""
)


def _all_metrics(g: Graph) -> DataFrame:
    """The three indicators share the located papers, the chosen topics and their descendants."""
    g = g.hold("paper_fos", "paper_countries", "filtered", "closure")
    rca = indicators.rca_by_sum(measuring.country_fact(g), "country", paper_thresh=PAPERS, year_thresh=YEAR)
    metrics = outputs.all_metrics(measuring.research(g), rca, measuring.gender(g), g.fields_of_study)
    return rounded(metrics, "shannon_diversity", "rca_sum", "female_share")


@query(_METRICS + "SELECT * FROM metrics")
def all_metrics(g: Graph) -> DataFrame:
    return _all_metrics(g)


@query(
    _METRICS
    + """
, credited AS (
    SELECT paper_id, arg_min(country, affiliation_id) AS country
    FROM author_affiliation JOIN places USING (affiliation_id) WHERE country <> '' GROUP BY paper_id)
, produced AS (
    SELECT field_of_study_id, country, year, count(*) AS paper_count, cast(sum(citations) AS bigint) AS total_citations
    FROM credited JOIN papers ON id = paper_id JOIN paper_fos USING (paper_id) GROUP BY ALL)
SELECT country, field_of_study_id, year, paper_count, total_citations, name, shannon_diversity, rca_sum, female_share
FROM produced JOIN metrics USING (field_of_study_id, country, year)"""
)
def country_topic_outputs(g: Graph) -> DataFrame:
    # First the metrics, which store the topics of the papers.
    metrics = materialise(_all_metrics(g))
    return outputs.country_topic_outputs(g.paper_attributes, g.paper_fos, g.affiliation_links, g.places, metrics)


@query(
    "SELECT country, paper_id FROM paper_country WHERE country IS NOT NULL"
)
def papers_by_country(g: Graph) -> DataFrame:
    return outputs.papers_by_country(measuring.paper_countries(g))


@query(
    "SELECT id AS field_of_study_id, name, paper_id FROM levels LEFT JOIN paper_fos ON field_of_study_id = id"
)
def papers_by_topic(g: Graph) -> DataFrame:
    """Every topic, so that the top level, which no paper carries directly, is kept empty."""
    every = g.fields_of_study.select(F.col("id").alias("field_of_study_id"))
    return outputs.papers_by_topic(g.paper_fos, every, g.fields_of_study)


@query(
    f"SELECT year, id AS paper_id FROM papers WHERE year > '{YEAR}'"
)
def papers_by_year(g: Graph) -> DataFrame:
    return outputs.papers_by_year(g.paper_attributes, YEAR)


@query(
    f"""SELECT 'country' AS list, country AS key, count(*) AS count FROM paper_country WHERE country IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'topic', name, count(paper_id) FROM levels LEFT JOIN paper_fos ON field_of_study_id = id GROUP BY id, name
    UNION ALL SELECT 'year', year, count(*) FROM papers WHERE year > '{YEAR}' GROUP BY 2"""
)
def paper_list_counts(g: Graph) -> DataFrame:
    """The length of every paper list."""
    def counted(label: str, rows: DataFrame, key: str, *keys: str) -> DataFrame:
        return outputs.list_counts(rows, *keys).select(F.lit(label).alias("list"), F.col(key).alias("key"), "count")

    return (
        counted("country", papers_by_country(g), "country", "country")
        .union(counted("topic", papers_by_topic(g), "name", "field_of_study_id", "name"))
        .union(counted("year", papers_by_year(g), "year", "year"))
    )


_TOPICS_BY_PAPER = """
, tagged AS (
    SELECT paper_id AS id, name FROM paper_fos JOIN filtered USING (field_of_study_id)
    JOIN levels ON levels.id = field_of_study_id)
"""


@query(
    _TOPICS_BY_PAPER
    + "SELECT id, string_agg(name, ',' ORDER BY encode(name)) AS field_of_study FROM tagged GROUP BY id"
)
def topics_by_paper(g: Graph) -> DataFrame:
    lists = outputs.topics_by_paper(g.paper_fos, g.filtered, g.fields_of_study)
    return lists.withColumn("field_of_study", F.array_join("field_of_study", ","))


@query(
    _TOPICS_BY_PAPER
    + _coordinates()
    + """SELECT c.id, c.citations, p.year, name AS field_of_study, country, x, y, z
    FROM coordinates c JOIN papers p USING (id) JOIN tagged USING (id) JOIN paper_country ON paper_id = p.id
    WHERE country IS NOT NULL"""
)
def flat_export(g: Graph) -> DataFrame:
    documents = _projectable(g)
    projected = vectors.project(documents, vectors.fit_projection(documents))
    export = outputs.flat_export(
        projected,
        g.paper_attributes,
        outputs.paper_topic_names(g.paper_fos, g.filtered, g.fields_of_study),
        outputs.papers_by_country(measuring.paper_countries(g)),
    )
    return _unsigned(export, "id", "citations", "year", "field_of_study", "country")


@query(
    """, topic_lists AS (
        SELECT paper_id, string_agg(concat(name, '|', cast(id AS varchar)), ';' ORDER BY encode(name), id) AS topics
        FROM paper_fos JOIN levels ON id = field_of_study_id GROUP BY paper_id)
    , author_lists AS (
        SELECT paper_id, string_agg(concat(author_id, '|', name, '|', affiliation), ';'
            ORDER BY author_id, encode(name), encode(affiliation)) AS authors
        FROM (
            SELECT paper_id, author_id, coalesce(name, '') AS name, coalesce(affiliation, '') AS affiliation
            FROM author_affiliation JOIN authors ON authors.id = author_id
                LEFT JOIN affiliation ON affiliation.id = affiliation_id)
        GROUP BY paper_id)
    SELECT id, cast(year AS integer) AS year, date AS publication_date, original_title, abstract, citations, topics, authors
    FROM papers JOIN topic_lists t ON t.paper_id = id LEFT JOIN author_lists a ON a.paper_id = id WHERE abstract IS NOT NULL"""
)
def search_documents(g: Graph) -> DataFrame:
    authors = outputs.search_authors(g.author_affiliation, g.authors, g.affiliation)
    documents = outputs.search_documents(g.papers, g.paper_fos, g.fields_of_study, authors)
    joined = lambda column, *fields: F.array_join(
        F.transform(column, lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields])), ";"
    )
    return documents.select(
        *[c for c in documents.columns if c not in ("fields_of_study", "authors")],
        joined("fields_of_study", "name", "id").alias("topics"),
        F.when(F.size("authors") > 0, joined("authors", "author_id", "name", "affiliation")).alias("authors"),
    )


@query(
    """SELECT paper_id AS id, author_id, coalesce(name, '') AS name, coalesce(affiliation, '') AS affiliation
    FROM author_affiliation JOIN authors ON authors.id = author_id
        LEFT JOIN affiliation ON affiliation.id = affiliation_id"""
)
def search_authors(g: Graph) -> DataFrame:
    return outputs.search_authors(g.author_affiliation, g.authors, g.affiliation)
