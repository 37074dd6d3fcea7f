"""The monthly run, step by step: landed files -> graph -> topics -> indicators -> front-end tables.

Each step reads stored tables and writes stored tables, so steps can be repeated or scheduled on their
own.  A repeated step appends nothing that is stored already.  What a step stages is removed when it ends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.ml.feature import PCAModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph import config, schemas
from citegraph.operators import enrich, indicators, normalise, outputs, topics, vectors
from citegraph.session import materialise, staging
from citegraph.sources import country_indicators, records
from citegraph.sources.store import Store


def step(run: Callable) -> Callable:
    """A step: by its end its results are stored tables or files, and nothing staged is left."""

    @wraps(run)
    def staged(store: Store, *args, **options):
        with staging(store.spark):
            return run(store, *args, **options)

    return staged


def create_tables(store: Store) -> None:
    """Empty tables for everything that is not there yet."""
    for name in schemas.TABLES:
        store.create_empty(name)


# --- graph --------------------------------------------------------------------------------------------
@step
def add_records(store: Store, path: str, with_doi: bool = False, multi_line: bool = False) -> None:
    """Parse landed records that are not stored yet and append them to the graph tables.

    The papers are appended last: if the run breaks off before, the next one takes the same records up
    again, and every table leaves out the papers it already has.
    """
    landed = records.read_records(store.spark, path, with_doi, multi_line)
    fresh = materialise(normalise.rows_to_append(landed, store.read("papers"), "Id", "id"))
    for name, parse in {
        "paper_journal": normalise.journals,
        "paper_conferences": normalise.conferences,
        "paper_authors": normalise.paper_authors,
        "paper_fields_of_study": normalise.paper_fields_of_study,
        "author_affiliation": normalise.author_affiliation,
    }.items():
        store.append(normalise.not_yet_stored(parse(fresh), store.read(name), "paper_id"), name)
    for name, parse in {
        "authors": normalise.authors,
        "fields_of_study": normalise.fields_of_study,
        "affiliation": normalise.affiliations,
        "papers": normalise.papers,
    }.items():
        store.append(normalise.not_yet_stored(parse(fresh), store.read(name), "id"), name)


@step
def add_topics(store: Store, path: str) -> None:
    """Level and links of the topics that are not described yet."""
    landed = records.read_topics(store.spark, path)
    ours, stored = store.read("fields_of_study"), store.read("field_of_study_metadata")
    links = normalise.topic_hierarchy(landed, ours, stored)
    store.append(
        normalise.not_yet_stored(links, store.read("field_of_study_hierarchy"), "id"),
        "field_of_study_hierarchy",
    )
    store.append(normalise.topic_metadata(landed, ours, stored), "field_of_study_metadata")


# --- enrichment ---------------------------------------------------------------------------------------
@step
def add_places(store: Store, path: str) -> None:
    places = enrich.geocoded_places(records.read_place_details(store.spark, path))
    store.append(
        normalise.not_yet_stored(places, store.read("geocoded_places"), "affiliation_id"), "geocoded_places"
    )


@step
def names_to_infer(store: Store, batch_size: int = config.NAME_BATCH_SIZE) -> DataFrame:
    """Batches of author names without a gender, to be sent to the name service; they stay staged for ``add_genders``."""
    authors = normalise.not_yet_stored(store.read("authors"), store.read("author_gender"), "id")
    return materialise(enrich.name_batches(authors, batch_size), outlive=True)


@step
def add_genders(store: Store, path: str, names: DataFrame) -> None:
    responses = records.read_gender_responses(store.spark, path)
    store.append(enrich.author_gender(responses, names, store.read("author_gender")), "author_gender")


@step
def flag_institutions_and_journals(store: Store) -> None:
    store.append(
        enrich.affiliation_type(store.read("affiliation"), store.read("affiliation_type")), "affiliation_type"
    )
    store.refresh(enrich.open_access_journals(store.read("paper_journal")), "open_access_journals")


@step
def load_country_indicators(store: Store, paths: dict[str, str], **options: str) -> None:
    """``paths`` maps a table name (wb_gdp, ...) to its landed files."""
    for name, path in paths.items():
        raw = country_indicators.read_indicator_files(store.spark, path, **options)
        store.refresh(country_indicators.load_indicator(raw), name)


@step
def describe_countries(store: Store, path: str) -> None:
    """Match country names and add the country details landed at ``path``."""
    store.refresh(enrich.country_association(store.read("geocoded_places")), "country_association")
    responses = records.read_country_details(store.spark, path)
    store.refresh(enrich.country_details(responses, store.read("country_association")), "country_details")


# --- topics -------------------------------------------------------------------------------------------
@step
def select_topics(
    store: Store,
    levels: Sequence[int] = config.TOPIC_LEVELS,
    percentiles: Sequence[float] = config.TOPIC_PERCENTILES,
) -> None:
    """Update topic frequencies, pick the frequent topics and store their yearly totals."""
    metadata = topics.topic_frequency(
        store.read("paper_fields_of_study"), store.read("field_of_study_metadata")
    )
    store.update(metadata, "field_of_study_metadata")
    chosen = topics.filter_topics(store.read("field_of_study_metadata"), levels, percentiles)
    closure = materialise(topics.topic_closure(store.read("field_of_study_hierarchy"), chosen))
    totals = topics.yearly_topic_totals(store.read("papers"), store.read("paper_fields_of_study"), closure)
    store.refresh(totals, "filtered_field_of_study")


def selected_topics(store: Store) -> DataFrame:
    """field_of_study_id of the topics chosen by ``select_topics``."""
    return materialise(store.read("filtered_field_of_study").select("field_of_study_id").distinct())


def stored_closure(store: Store) -> DataFrame:
    """(field_of_study_id, descendant) from the stored yearly totals, which repeat it for each year."""
    stored = store.read("filtered_field_of_study")
    return materialise(
        stored.groupBy("field_of_study_id")
        .agg(F.any_value("all_children").alias("children"))
        .select("field_of_study_id", F.explode("children").alias("descendant"))
    )


def paper_countries(store: Store) -> DataFrame:
    """Distinct (paper_id, country), the base of every country indicator."""
    return materialise(
        indicators.paper_entities(store.read("geocoded_places"), store.read("author_affiliation"))
    )


# --- indicators ---------------------------------------------------------------------------------------
@step
def measure(
    store: Store,
    year_thresh: str = config.METRIC_YEAR,
    paper_thresh: int = config.MIN_PAPERS,
    fos_thresh: int = config.MIN_TOPICS,
    gender_thresh: float = config.GENDER_PROBABILITY,
    collaboration_year: str = config.COLLABORATION_YEAR,
) -> None:
    """Specialisation, research and gender diversity, collaboration."""
    papers, paper_fos = store.read("papers"), store.read("paper_fields_of_study")
    chosen, closure, countries = selected_topics(store), stored_closure(store), paper_countries(store)
    # One set of cells over the closure serves both indicators that compare countries on topics.
    covered = indicators.base_fact(
        countries, papers, paper_fos, indicators.closure_topics(closure), F.col("year") >= year_thresh
    )
    cells = materialise(indicators.topic_cells(covered, "country"))
    own = cells.join(chosen, "field_of_study_id", "left_semi")
    store.refresh(indicators.rca_of_cells(own, paper_thresh, year_thresh), "rca_country")
    store.refresh(
        indicators.research_diversity_of_cells(cells, closure, fos_thresh, year_thresh),
        "research_diversity_country",
    )
    links = store.read("author_affiliation")
    affiliations = indicators.paper_entities(store.read("geocoded_places"), links, "affiliation_id")
    fact = indicators.base_fact(affiliations, papers, paper_fos, chosen, F.col("year") > year_thresh)
    store.refresh(
        indicators.rca_by_sum(fact, "affiliation_id", paper_thresh=paper_thresh, year_thresh=year_thresh),
        "rca_affiliation",
    )
    share = indicators.paper_female_share(links, store.read("author_gender"), gender_thresh)
    store.refresh(
        indicators.gender_diversity(countries, papers, paper_fos, share, chosen, paper_thresh),
        "gender_diversity_country",
    )
    store.refresh(
        indicators.country_collaboration(countries, papers, collaboration_year), "country_collaboration"
    )


# --- vectors ------------------------------------------------------------------------------------------
@step
def add_document_vectors(
    store: Store, encode_fn: Callable[[list[str]], Sequence], batch_size: int = config.ENCODER_BATCH_SIZE
) -> None:
    """Encode the abstracts that have no vector yet."""
    stored = store.read("high_dim_doc_vectors")
    fresh = vectors.encode_documents(store.read("papers"), encode_fn, stored, batch_size)
    store.append(fresh, "high_dim_doc_vectors")


@step
def replace_document_vectors(
    store: Store,
    max_features: int | None = None,
    k: int = config.SVD_COMPONENTS,
    stop_words: Sequence[str] | None = None,
    model_path: str | None = None,
) -> vectors.TextVectorModel:
    """TF-IDF and SVD vectors of all abstracts; the model is kept at ``model_path``."""
    embedded, model = vectors.tfidf_svd_vectors(store.read("papers"), max_features, k, stop_words)
    store.refresh(embedded, "high_dim_doc_vectors")
    if model_path is not None:
        model.save(model_path)
        return vectors.TextVectorModel.load(store.spark, model_path)
    return vectors.TextVectorModel(materialise(model.terms, outlive=True), model.k)


@step
def project_documents(
    store: Store, model_path: str, refit: bool = False, exclude: Sequence[int] = ()
) -> None:
    """Three-dimensional coordinates: fit on all vectors, or only add new ones with the stored model."""
    papers, high = store.read("papers"), store.read("high_dim_doc_vectors")
    if refit:
        documents = vectors.projectable(high, papers, exclude)
        model = vectors.fit_projection(documents)
        model.write().overwrite().save(model_path)
        store.refresh(vectors.project(documents, model), "doc_vectors")
    else:
        documents = vectors.projectable(high, papers, exclude, stored=store.read("doc_vectors"))
        store.append(vectors.project(documents, PCAModel.load(model_path)), "doc_vectors")


@step
def compare_countries(
    store: Store,
    year: str = config.COLLABORATION_YEAR,
    k: int = config.NEIGHBOURS,
    thresh: int = config.SIMILARITY_MIN_PAPERS,
) -> None:
    means = vectors.country_vectors(
        paper_countries(store),
        store.read("papers"),
        store.read("paper_fields_of_study"),
        store.read("high_dim_doc_vectors"),
        stored_closure(store),
        thresh,
        year,
    )
    store.refresh(vectors.country_similarity(means, k, year), "country_similarity")


# --- output -------------------------------------------------------------------------------------------
@step
def present(store: Store, year_thresh: str = config.PAPER_YEAR) -> None:
    """The front-end tables."""
    papers, paper_fos = store.read("papers"), store.read("paper_fields_of_study")
    places, links = store.read("geocoded_places"), store.read("author_affiliation")
    fos, chosen = store.read("fields_of_study"), selected_topics(store)
    store.refresh(
        outputs.all_metrics(
            store.read("research_diversity_country"),
            store.read("rca_country"),
            store.read("gender_diversity_country"),
            fos,
        ),
        "viz_metrics_by_country",
    )
    metrics = store.read("viz_metrics_by_country")
    store.refresh(
        outputs.country_topic_outputs(papers, paper_fos, links, places, metrics), "viz_metrics_and_outputs"
    )
    lists = {
        "viz_paper_country": (outputs.papers_by_country(paper_countries(store)), ["country"]),
        "viz_paper_topics": (outputs.papers_by_topic(paper_fos, chosen, fos), ["field_of_study_id", "name"]),
        "viz_paper_year": (outputs.papers_by_year(papers, year_thresh), ["year"]),
    }
    for name, (rows, keys) in lists.items():
        store.refresh(rows, name)
        store.refresh(outputs.list_counts(store.read(name), *keys), f"{name}_count")
    store.refresh(outputs.topics_by_paper(paper_fos, chosen, fos), "viz_topics_agg")


@step
def export(store: Store, flat_path: str, search_path: str, authors_path: str) -> None:
    """The flat file of the particle view, the documents of the search index and their authors."""
    flat = outputs.flat_export(
        store.read("doc_vectors"),
        store.read("papers"),
        outputs.paper_topic_names(store.read("paper_fields_of_study"), selected_topics(store), store.read("fields_of_study")),
        store.read("viz_paper_country"),
    )
    outputs.write_flat_export(flat, flat_path)
    people = outputs.search_authors(store.read("author_affiliation"), store.read("authors"), store.read("affiliation"))
    documents = outputs.search_documents(
        store.read("papers"), store.read("paper_fields_of_study"), store.read("fields_of_study"), people
    )
    outputs.write_search_documents(documents, search_path)
    outputs.write_search_documents(people, authors_path)
