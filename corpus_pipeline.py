"""From documents to piece ids: language, near duplicates, benchmark passages, personal data, pieces.

Each stage takes all that its predecessor kept, as written to Parquet, and all but the last return the columns of
``documents``.  Null and empty texts and repeated rows are treated as each operator states: texts without a letter go in
the first stage, of repeated rows one stays in the second.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm import contamination, languages, near, pieces, pii
from citegraph.llm.common import stage, table

#: A text none of whose languages has this share of its words is no prose in any of them.
LEAST_SCORE = 0.4


def _packed(docs: DataFrame) -> DataFrame:
    """The text beside all other columns in one, so that no name can clash and the text is there once."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text"))


def _unpacked(docs: DataFrame, **changed: Column) -> list[Column]:
    plain = {"text": F.col("text")} | changed
    return [plain.get(c, F.col("row")[c]).alias(c) for c in docs.columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts whose best language has too small a share of the words.

    The model learns from the rows that have a language; without any such row nothing but texts without a letter goes.
    """
    field = languages.learn(docs)
    if not field.languages:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = languages.identify(_packed(docs), field)
    kept = (F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.filter(kept).select(*_unpacked(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    return near.drop_near_duplicates(docs)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up at least a twentieth go."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or disguised, are replaced by their kind in brackets; ``n_chars`` follows the text."""
    found = pii.find_personal_data(_packed(docs))
    clean = found.withColumn("clean", pii.redacted(F.col("text"), F.col("pii")))
    length = F.when(F.size("pii") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return clean.select(*_unpacked(docs, text=F.col("clean"), n_chars=length))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and whether decoding them gives the text back.

    What is encoded is stored before it is decoded: in one plan each core would have two Python workers at once.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.decode(stage(pieces.encode(docs, model)), model)
    return both.select(
        "doc_id", "lang", "source", "n_chars", "piece_ids",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        "log_score",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", contamination_stage),
    ("personal_data", personal_data_stage),
    ("pieces", piece_stage),
]

# Neither the field of the first stage nor the segmentation of the last can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
