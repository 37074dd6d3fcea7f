"""Country indicators landed as (country, year, value) files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph import config, schemas


def read_indicator_files(spark: SparkSession, path: str, format: str = "csv", **options: str) -> DataFrame:
    if format == "csv":
        options = {"header": "true", **options}
    return spark.read.format(format).schema(schemas.INDICATOR_FILE).options(**options).load(path)


def load_indicator(
    raw: DataFrame,
    start_year: str = config.INDICATOR_START_YEAR,
    end_year: str = config.INDICATOR_END_YEAR,
    country: str | list[str] = "all",
    value_col: str = "value",
) -> DataFrame:
    """country, year, indicator for the years in [start, end]; ``"all"`` keeps every country."""
    chosen: Column = F.col("year").between(start_year, end_year)
    if country != "all":
        names = [country] if isinstance(country, str) else list(country)
        chosen = chosen & F.col("country").isin(names)
    return raw.filter(chosen).select("country", "year", F.col(value_col).alias("indicator"))


def country_names(*indicators: DataFrame) -> DataFrame:
    """Country names that occur in any of the indicator tables."""
    return reduce(DataFrame.unionByName, [df.select("country") for df in indicators]).distinct()
