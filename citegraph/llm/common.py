"""What the operators of this subpackage share: reading tables, adding columns, staging, worker caches."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from re import Pattern

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def without(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """The columns of ``df`` that are not called like one of ``names``."""
    names = {n.lower() for n in names}
    return [quoted(c) for c in df.columns if c.lower() not in names]


def add_fields(df: DataFrame, struct: Column, fields: Iterable[str]) -> DataFrame:
    """``df`` with the fields of ``struct`` as columns; columns of the same names are replaced."""
    fields = list(fields)
    name = fresh(df, "added")
    return df.withColumn(name, struct).select(*without(df, fields), *[F.col(name)[f].alias(f) for f in fields])


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset (tests) a folder of its own is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="stage-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Remembered(dict):
    """A dictionary that computes missing values and holds at most about ``limit`` of them.

    When it is full the older half goes.  The limit bounds memory only: what is no longer held is computed again.
    """

    def __init__(self, compute: Callable, limit: int = 1_000_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            for old in list(self)[: self.limit // 2]:
                del self[old]
        value = self[key] = self.compute(key)
        return value


def text_pieces(data: bytes, separator: Pattern[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes, cut only where ``separator`` matches; joined they are ``data``."""
    start = 0
    while len(data) - start > size and (cut := separator.search(data, start + size)):
        yield data[start : cut.start()]
        start = cut.start()
    yield data[start:] if start else data


#: Rows of a table of keys that is sent to every executor (some 40 MB); beyond that it is shuffled.
SENT_KEYS = 500_000


def sent_if_small(keys: DataFrame) -> DataFrame:
    """A stored table of keys (a few numbers a row), marked to be sent to all executors if its row count allows that."""
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys


_BUILT: dict = {}


def once_per_worker(key, build: Callable):
    """The value of ``build()``, kept for later tasks of the same Python worker.

    Only the last two are held, so that what one operator has remembered makes room for the next one's.
    """
    if key not in _BUILT:
        while len(_BUILT) >= 2:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[key] = build()
    return _BUILT[key]


def give_back(*keys) -> None:
    """Return memory to the machine, where the next stage may need it: that of finished Arrow batches, and what earlier
    operators have built in this worker, except for ``keys``."""
    for key in [k for k in _BUILT if k not in keys]:
        del _BUILT[key]
    pa.default_memory_pool().release_unused()
    # The C library keeps what was freed unless it is asked for it; where there is no such call, nothing is lost.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)
