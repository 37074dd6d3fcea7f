"""The stored tables of the publication graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph import schemas


def nan_text_to_null(df: DataFrame) -> DataFrame:
    """Older exports hold the text "NaN" where a value is missing; turn it into null."""
    columns = [
        F.nullif(F.col(f"`{name}`"), F.lit("NaN")).alias(name) if kind == "string" else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ]
    return df.select(columns)


def read_table(
    spark: SparkSession, path: str, name: str, format: str = "parquet", nan_text: bool = False, **options: str
) -> DataFrame:
    """One stored table with its declared schema, from Parquet, ORC, JSON or CSV files.

    ``nan_text`` is for exports that write "NaN" for a missing value.  Tables written by this package
    hold real nulls, so their filters stay plain columns and reach the file scan.
    """
    table = spark.read.format(format).schema(schemas.TABLES[name]).options(**options).load(path)
    return nan_text_to_null(table) if nan_text else table


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    name: str,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """One table of an existing relational database, read in ``partitions`` ranges of a numeric key."""
    return nan_text_to_null(
        spark.read.jdbc(
            url, name, column=partition_column, lowerBound=lower, upperBound=upper,
            numPartitions=partitions, properties=properties or {},
        )
    )


# Tables that are read by year are laid out by year, so a year filter skips whole folders.
PARTITION_COLUMNS = {"papers": ["year"]}


#: Marks a version of a table whose files are all there.
COMPLETE = "_COMPLETE"


@dataclass(frozen=True)
class Store:
    """Tables kept as files below one folder.

    A table lies in ``<name>`` until it is replaced for the first time.  A replacement is written to a folder
    ``<name>.v<number>`` of its own, which counts from the moment its mark is there; readers take the highest one that
    has it.  Nothing is renamed or overwritten, so wherever a run breaks off, the last complete version is what
    everybody reads, and running readers keep their files: only versions before the last one are removed.
    """

    spark: SparkSession
    root: str
    format: str = "parquet"

    def _place(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))

    def _files(self):
        return self._place().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        """The numbers of the complete versions, in order."""
        found = self._files().globStatus(self._place(f"{name}.v*", COMPLETE)) or []
        return sorted(int(status.getPath().getParent().getName().rpartition(".v")[2]) for status in found)

    def _folder(self, name: str, version: int) -> str:
        return f"{self.root.rstrip('/')}/{name}" + (f".v{version}" if version else "")

    def path(self, name: str) -> str:
        """The folder of the live version."""
        return self._folder(name, max(self._versions(name), default=0))

    def read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path(name), name, self.format)

    def append(self, df: DataFrame, name: str) -> None:
        self._write(self._shaped(df, name), name, self.path(name), "append")

    def refresh(self, df: DataFrame, name: str) -> None:
        """Replace the whole table, also by a result computed from that same table."""
        self._replace(name, lambda path: self._write(self._shaped(df, name), name, path, "overwrite"))

    # The name for a result that is computed from the table itself.
    update = refresh

    def create_empty(self, name: str) -> None:
        self._write(self.spark.createDataFrame([], schemas.TABLES[name]), name, self.path(name), "ignore")

    def save_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> None:
        """Save as a catalog table bucketed and sorted by ``key``: joins on it then need no shuffle."""
        self._replace(
            name,
            lambda path: self._shaped(df, name).write.mode("overwrite").format(self.format)
            .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name),
        )

    def _replace(self, name: str, write: Callable[[str], None]) -> None:
        last = max(self._versions(name), default=0)
        # A folder of this number without a mark is what a broken run has left; it is written over.
        write(self._folder(name, last + 1))
        files = self._files()
        files.create(self._place(f"{name}.v{last + 1}", COMPLETE)).close()
        for old in [v for v in (0, *self._versions(name)) if v < last]:
            files.delete(self._place(self._folder(name, old).rpartition("/")[2]), True)

    def _write(self, df: DataFrame, name: str, path: str, mode: str) -> None:
        df.write.mode(mode).format(self.format).partitionBy(*PARTITION_COLUMNS.get(name, [])).save(path)

    def _shaped(self, df: DataFrame, name: str) -> DataFrame:
        """Columns in declared order and type; an undeclared column is an error."""
        declared = self.spark.createDataFrame([], schemas.TABLES[name]).schema
        extra = set(df.columns) - set(declared.names)
        if extra:
            raise ValueError(f"{name} has no columns {sorted(extra)}")
        return df.select(
            [
                (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in declared.fields
            ]
        )


def foreign_key_violations(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent row."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")
