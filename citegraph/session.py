"""Session construction and the one place that decides where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Joins are left to Catalyst and AQE: a side is broadcast only when its measured size is below the
# threshold, and a skewed shuffle partition is split even if that costs an extra exchange.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Lists and vector means keep more than the default 128 groups per task before they sort.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000",
}


def get_session(app_name: str = "citegraph", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and staged files: ``spark.checkpoint.dir``.

    Only a session on one machine without the setting (tests) gets a temporary folder, which is removed when the process
    ends.  Anywhere else a machine-local folder would be lost with its executor, so the setting is required there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="citegraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


#: The folders staged inside each open ``staging`` block, innermost last.
_STAGED: ContextVar[tuple[list[str], ...]] = ContextVar("staged", default=())


def staged_path(spark: SparkSession, outlive: bool = False) -> str:
    """A new path in the shared folder, which an enclosing ``staging`` block removes unless it is to ``outlive`` it.

    One that outlives its block belongs to the block around that, if there is one.
    """
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    open_blocks = _STAGED.get()[: -1 if outlive else None]
    if open_blocks:
        open_blocks[-1].append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Removes at its end, also after an error, what was staged inside.

    A result that is read after the block has to be written by then: as a table, or by ``materialise(outlive=True)``.
    """
    paths: list[str] = []
    token = _STAGED.set((*_STAGED.get(), paths))
    try:
        yield
    finally:
        _STAGED.reset(token)
        for path in paths:
            remove_path(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """What a write inside has shuffled is removed when it is written, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def discard(*tables: DataFrame) -> None:
    """Removes the files of staged tables that nothing reads any more."""
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            remove_path(table.sparkSession, folder)


def materialise(df: DataFrame, outlive: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one costly result feeds several branches, or a table is rewritten from itself.  The files
    outlive a lost executor, and their real size lets Catalyst decide whether a join may broadcast them.  They are
    removed by the enclosing ``staging`` block; outside of any they stay until the application's folder is removed.
    """
    spark = df.sparkSession
    path = staged_path(spark, outlive)
    with unshuffled(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
