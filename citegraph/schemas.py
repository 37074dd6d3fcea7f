"""Schemas of the landed records and of every stored table."""

from __future__ import annotations



def ddl(text: str) -> str:
    """A schema as one DDL line, the form every Spark reader and ``createDataFrame`` accept."""
    return " ".join(text.split())


RAW_RECORD = ddl(
    """
    Id long, Ti string, Pt string, DN string, Y int, D string, CC int, prob double, logprob double,
    DOI string, PB string, BT string, RId array<long>,
    AA array<struct<DAuN: string, AuId: long, AfN: string, AfId: long, S: int>>,
    F array<struct<DFN: string, FId: long>>,
    J struct<JN: string, JId: long>,
    C struct<CN: string, CId: long>,
    IA struct<IndexLength: int, InvertedIndex: map<string, array<int>>>,
    S array<struct<Ty: int, U: string>>
    """
)

RAW_TOPIC = ddl(
    """
    Id long, DFN string, FL int, prob double, logprob double,
    FP array<struct<FId: long>>, FC array<struct<FId: long>>
    """
)

PLACE_RESPONSE = ddl(
    """
    affiliation_id long,
    result struct<
        address_components: array<struct<long_name: string, short_name: string, types: array<string>>>,
        formatted_address: string,
        geometry: struct<location: struct<lat: double, lng: double>>,
        name: string, place_id: string, types: array<string>, website: string>
    """
)

GENDER_RESPONSE = ddl(
    """
    input struct<full_name: string>, details struct<samples: int>, result_found boolean,
    first_name string, probability double, gender string
    """
)

COUNTRY_RESPONSE = ddl(
    """
    query_name string,
    body array<struct<name: string, alpha2Code: string, alpha3Code: string, capital: string,
                      region: string, subregion: string, population: long>>
    """
)

INDICATOR_FILE = ddl("country string, year string, value double")

TABLES: dict[str, str] = {
    name: ddl(text)
    for name, text in {
        "papers": """id long, prob double, title string, publication_type string, year string, date string,
            citations int, original_title string, `references` array<long>, doi string, publisher string,
            bibtex_doc_type string, abstract string, source string""",
        "paper_journal": "id long, journal_name string, paper_id long",
        "paper_conferences": "id long, conference_name string, paper_id long",
        "paper_authors": "paper_id long, author_id long, `order` int",
        "authors": "id long, name string",
        "affiliation": "id long, affiliation string",
        "author_affiliation": "affiliation_id long, author_id long, paper_id long",
        "fields_of_study": "id long, name string",
        "paper_fields_of_study": "paper_id long, field_of_study_id long",
        "geocoded_places": """id string, affiliation_id long, lat double, lng double, address string,
            name string, types array<string>, website string, postal_town string,
            administrative_area_level_2 string, administrative_area_level_1 string, country string""",
        "high_dim_doc_vectors": "id long, vector array<double>",
        "doc_vectors": "id long, vector_3d array<double>, citations int",
        "field_of_study_hierarchy": "id long, parent_id array<long>, child_id array<long>",
        "field_of_study_metadata": "id long, level int, frequency long",
        "rca_country": "entity string, year string, rca_sum double, field_of_study_id long",
        "rca_affiliation": "entity long, year string, rca_sum double, field_of_study_id long",
        "author_gender": """id long, full_name string, first_name string, gender string, samples int,
            probability double""",
        "country_collaboration": "country_a string, country_b string, weight long, year string",
        "research_diversity_country": """shannon_diversity double, simpson_e_diversity double,
            simpson_diversity double, year string, entity string, field_of_study_id long""",
        "gender_diversity_country": "female_share double, year string, entity string, field_of_study_id long",
        "filtered_field_of_study": """field_of_study_id long, year string, all_children array<long>,
            paper_count long, total_citations long""",
        "country_similarity": """country_a string, country_b string, closeness double, year string,
            field_of_study_id long""",
        "viz_metrics_and_outputs": """country string, field_of_study_id long, year string, paper_count long,
            total_citations long, name string, shannon_diversity double, rca_sum double,
            female_share double""",
        "viz_metrics_by_country": """year string, country string, shannon_diversity double,
            field_of_study_id long, rca_sum double, female_share double, name string""",
        "viz_paper_country": "country string, paper_id long",
        "viz_paper_country_count": "country string, count long",
        "viz_paper_topics": "field_of_study_id long, name string, paper_id long",
        "viz_paper_topics_count": "field_of_study_id long, name string, count long",
        "viz_paper_year": "year string, paper_id long",
        "viz_paper_year_count": "year string, count long",
        "viz_topics_agg": "id long, field_of_study array<string>",
        "affiliation_type": "id long, non_industry int",
        "wb_gdp": "country string, indicator double, year string",
        "wb_rnd_expenditure": "country string, indicator double, year string",
        "wb_edu_expenditure": "country string, indicator double, year string",
        "wb_female_workforce": "country string, indicator double, year string",
        "country_association": "wb_country string, google_country string",
        "country_details": """alpha2Code string, alpha3Code string, name string, google_name string,
            wb_name string, region string, subregion string, population long, capital string""",
        "open_access_journals": "id long, open_access int",
    }.items()
}

# child table, child column, parent table, parent column
FOREIGN_KEYS = (
    ("paper_journal", "paper_id", "papers", "id"),
    ("paper_conferences", "paper_id", "papers", "id"),
    ("paper_authors", "paper_id", "papers", "id"),
    ("paper_authors", "author_id", "authors", "id"),
    ("author_affiliation", "affiliation_id", "affiliation", "id"),
    ("author_affiliation", "author_id", "authors", "id"),
    ("author_affiliation", "paper_id", "papers", "id"),
    ("paper_fields_of_study", "paper_id", "papers", "id"),
    ("paper_fields_of_study", "field_of_study_id", "fields_of_study", "id"),
    ("geocoded_places", "affiliation_id", "affiliation", "id"),
)
