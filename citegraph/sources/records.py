"""Landed JSON: publication records, topics and service responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph import schemas
from citegraph.session import unshuffled


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON with a declared schema; absent keys become null.  ``multi_line`` reads one array per file."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def read_records(
    spark: SparkSession, path: str, with_doi: bool = False, multi_line: bool = False
) -> DataFrame:
    """Every landed publication record plus ``ordinal``, its place in listing order.

    ``ordinal`` is (file path, offset of the split in the file, row in the split): the same for every
    read of the same files, so "the last record wins" has one meaning.
    """
    records = read_json(spark, path, schemas.RAW_RECORD, multi_line).withColumn(
        "ordinal",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )
    return records.filter(F.col("DOI").isNotNull()) if with_doi else records


def write_records(records: DataFrame, path: str) -> None:
    """Land records as compressed JSON lines; null attributes are left out, as the service does.

    Their keys repeat in every record.  A compressed file is read by one task, and there are as many as tasks wrote.
    """
    with unshuffled(records.sparkSession):
        records.drop("ordinal").write.mode("overwrite").json(path, compression="gzip")


def read_topics(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_json(spark, path, schemas.RAW_TOPIC, multi_line)


def read_place_details(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_json(spark, path, schemas.PLACE_RESPONSE, multi_line)


def read_gender_responses(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_json(spark, path, schemas.GENDER_RESPONSE, multi_line)


def read_country_details(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_json(spark, path, schemas.COUNTRY_RESPONSE, multi_line)
