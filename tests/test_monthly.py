"""The whole run over files landed from the smallest driver tables."""

import pytest
from pyspark.sql import functions as F

from citegraph.operators import indicators
from citegraph.plans import monthly
from citegraph.queries.graph import Graph
from citegraph.sources import records
from citegraph.sources.store import Store
from conftest import as_set
from test_staging import staged

FOLDER = "/root/testdata/sf0.001"


def encode(texts):
    return [[float(len(t)), float(t.count(" ")), float(t.count("e")), 1.0, float(t.count("a"))] for t in texts]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("monthly")
    graph = Graph(spark, FOLDER)
    records.write_records(graph.raw, str(root / "raw"))
    children = graph.edges.groupBy(F.col("parent").alias("Id")).agg(
        F.collect_list(F.struct(F.col("child").alias("FId"))).alias("FC")
    )
    graph.metadata.select(F.col("id").alias("Id"), F.col("level").alias("FL")).join(children, "Id", "left").write.json(
        str(root / "topics"))
    graph.places.select("affiliation_id", F.struct(
        F.array(F.struct(F.col("country").alias("long_name"), F.array(F.lit("country")).alias("types"))).alias(
            "address_components"),
        F.concat(F.lit("p"), "affiliation_id").alias("place_id"),
    ).alias("result")).write.json(str(root / "places"))
    store = Store(spark, str(root / "store"))
    before = staged(spark)
    monthly.create_tables(store)
    monthly.add_records(store, str(root / "raw"))
    monthly.add_topics(store, str(root / "topics"))
    monthly.add_places(store, str(root / "places"))
    names = monthly.names_to_infer(store, 50)
    names.select(
        F.struct(F.col("proc_name").alias("full_name")).alias("input"),
        F.struct(F.lit(5).alias("samples")).alias("details"),
        F.lit(True).alias("result_found"),
        F.lit("x").alias("first_name"),
        F.lit(0.9).alias("probability"),
        F.when(F.char_length("proc_name") % 2 == 0, "female").otherwise("male").alias("gender"),
    ).distinct().write.json(str(root / "gender"))
    monthly.add_genders(store, str(root / "gender"), names)
    monthly.flag_institutions_and_journals(store)
    monthly.select_topics(store)
    monthly.measure(store, "1996", 10, 10, collaboration_year="1996")
    monthly.add_document_vectors(store, encode, 64)
    model = str(root / "projection")
    monthly.project_documents(store, model, refit=True, exclude=())
    monthly.compare_countries(store, "1996", k=3)
    monthly.present(store, "1996")
    monthly.export(store, str(root / "flat"), str(root / "search"), str(root / "people"))
    # Of all that the steps have staged only the names for the service are left.
    assert len(staged(spark) - before) == 1
    return spark, root, store, graph, model


def test_graph_survives_the_round_trip(run):
    _, _, store, graph, _ = run
    columns = ["id", "year", "date", "citations", "original_title"]
    assert as_set(store.read("papers").select(*columns)) == as_set(graph.paper_attributes.select(*columns))
    texts = graph.papers.select("id", F.replace("abstract", F.lit("\x00"), F.lit("")).alias("abstract"))
    assert as_set(store.read("papers").select("id", "abstract")) == as_set(texts)
    links = ["paper_id", "field_of_study_id"]
    assert as_set(store.read("paper_fields_of_study").select(*links)) == as_set(graph.paper_fos.select(*links))


def test_a_second_run_appends_nothing(run):
    spark, root, store, _, model = run
    names = ["papers", "authors", "affiliation", "fields_of_study", "author_affiliation", "paper_authors",
             "paper_fields_of_study", "field_of_study_metadata", "field_of_study_hierarchy", "geocoded_places",
             "high_dim_doc_vectors", "doc_vectors", "affiliation_type"]
    before = {name: store.read(name).count() for name in names}
    assert all(before.values())
    again = Store(spark, store.root)
    monthly.add_records(again, str(root / "raw"))
    monthly.add_topics(again, str(root / "topics"))
    monthly.add_places(again, str(root / "places"))
    monthly.flag_institutions_and_journals(again)
    monthly.add_document_vectors(again, encode)
    monthly.project_documents(again, model, exclude=())
    again = Store(spark, store.root)
    assert {name: again.read(name).count() for name in names} == before


def test_indicator_tables(run):
    _, _, store, _, _ = run
    rca = store.read("rca_country")
    assert rca.count() and rca.filter("rca_sum < 0 or rca_sum > 6 or entity is null").count() == 0
    share = store.read("gender_diversity_country")
    assert share.count() and share.filter("female_share < 0 or female_share > 1").count() == 0
    diversity = store.read("research_diversity_country")
    assert diversity.count() and diversity.filter("simpson_e_diversity <= 0 or simpson_e_diversity > 1.000001").count() == 0
    papers = store.read("papers").count()
    pairs = store.read("country_collaboration")
    assert pairs.count() and pairs.filter(f"country_a >= country_b or weight > {papers}").count() == 0
    similar = store.read("country_similarity")
    assert similar.count() and similar.filter("country_a = country_b or closeness < 0").count() == 0


def test_shared_cells_equal_the_single_operators(run):
    _, _, store, _, _ = run
    pairs, closure = monthly.paper_countries(store), monthly.stored_closure(store)
    papers, links = store.read("papers"), store.read("paper_fields_of_study")
    fact = indicators.base_fact(pairs, papers, links, monthly.selected_topics(store))
    rca = indicators.rca_by_sum(fact, "country", year_thresh="1996")
    same = ["entity", "year", "field_of_study_id"]
    assert as_set(rca.select(*same)) == as_set(store.read("rca_country").select(*same))
    diversity = indicators.research_diversity(pairs, papers, links, closure, 10, "1996")
    assert as_set(diversity.select(*same)) == as_set(store.read("research_diversity_country").select(*same))


def test_countries_and_country_indicators(run):
    spark, root, store, _, _ = run
    (root / "gdp.csv").write_text("country,year,value\nIndia,2015,1.5\nIndia,2001,2.5\n")
    monthly.load_country_indicators(store, {"wb_gdp": str(root / "gdp.csv")})
    assert as_set(store.read("wb_gdp").select("country", "year", "indicator")) == {("India", "2015", 1.5)}
    names = store.read("geocoded_places").filter("country <> ''").select("country").distinct()
    answer = F.struct(F.col("country").alias("name"), F.lit("XX").alias("alpha2Code"))
    names.select(F.col("country").alias("query_name"), F.array(answer, answer).alias("body")).write.json(
        str(root / "countries"))
    monthly.describe_countries(store, str(root / "countries"))
    assert store.read("country_details").count() == names.count() == store.read("country_association").count()


def test_front_end_tables(run):
    spark, root, store, _, _ = run
    for name in ("viz_metrics_by_country", "viz_metrics_and_outputs", "viz_paper_country", "viz_paper_topics",
                 "viz_paper_year", "viz_topics_agg", "filtered_field_of_study"):
        assert store.read(name).count(), name
    lengths = store.read("viz_paper_country").groupBy("country").count()
    assert as_set(lengths) == as_set(store.read("viz_paper_country_count").select("country", "count"))
    assert spark.read.parquet(str(root / "flat")).count()
    assert spark.read.json(str(root / "search")).count() == 197
    assert spark.read.json(str(root / "people")).count()


def test_replacing_the_vectors(run):
    spark, root, store, _, _ = run
    model = monthly.replace_document_vectors(store, 200, 5, model_path=str(root / "text model"))
    assert model.k == 5 and model.transform(store.read("papers").limit(3)).count() <= 3
    assert store.read("high_dim_doc_vectors").count() == store.read("papers").filter("abstract is not null").count()
