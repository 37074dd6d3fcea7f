"""Quality by compression: how much better a text compresses with a dictionary of good texts than with one of bad texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import add_fields, once_per_worker, quoted, table

#: A text is compressed in blocks of so many bytes, so that a dictionary means as much at its end as at its start.
BLOCK = 512
#: Added to a text's bytes when its difference is normalised: a text of few bytes tells little.
SMOOTHING = 64
#: Size of a dictionary, the parameters of its training, and the level of compression.
DICTIONARY, SEGMENT, MATCH, LEVEL = 1 << 18, 64, 8, 3
#: What the driver learns from, at most: texts of each label for the dictionaries and as many others for the
#: calibration, passages of SAMPLE_BLOCK bytes of each label.
TEXTS, PASSAGES, SAMPLE_BLOCK = 2_000, 6_000, 1024


@dataclass(frozen=True)
class Model:
    """A dictionary for each label (bad, good), and the logistic curve from difference to score.

    The curve has what holds without any evidence, the slope of the difference, and what a text without a difference
    loses the more, the longer it is.
    """

    dictionaries: tuple[bytes, bytes]
    prior: float = 0.0
    slope: float = 0.0
    weight: float = 0.0

    @property
    def key(self) -> str:
        return hashlib.sha256(b"/".join(self.dictionaries)).hexdigest()


def _blocks(data: bytes, size: int) -> Iterator[bytes]:
    for start in range(0, len(data), size):
        yield data[start : start + size]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if made:
        made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def _difference(model: Model, text: Column, session: SparkSession) -> Column:
    """Bytes with the dictionary of bad texts less bytes with that of good texts."""
    sent, key = session.sparkContext.broadcast(model.dictionaries), model.key

    @F.arrow_udf("long")
    def difference(texts: pa.Array) -> pa.Array:
        bad, good = once_per_worker(key, lambda: [_compressor(d).compress for d in sent.value])
        out = []
        for text_ in texts.cast(pa.binary()):
            out.append(sum([len(bad(b)) - len(good(b)) for b in _blocks(text_.as_py(), BLOCK)]))
        return pa.array(out, pa.int64())

    return difference(text)


def _features(difference: Column, text: Column) -> list[Column]:
    """The normalised difference, and the share of the text in what it is normalised by."""
    size = F.octet_length(text).cast("double")
    return [difference / (size + SMOOTHING), size / (size + SMOOTHING)]


# --- learning -----------------------------------------------------------------------------------------
def _train_dictionary(passages: list[bytes]) -> bytes:
    """A dictionary for passages of one label; their plain bytes if there are too few to train one; nothing for none."""
    try:
        return zstandard.train_dictionary(DICTIONARY, passages, k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:
        return b"".join(passages)[-DICTIONARY:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Intercept and slopes of a logistic regression, by Newton's method with a slight pull to zero."""
    columns = np.c_[np.ones(len(x)), x]
    w, pull = np.zeros(columns.shape[1]), np.full(columns.shape[1], 1e-3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(columns @ w, -30, 30)))
        gradient = columns.T @ (weight * (y - p)) - pull * w
        step = np.linalg.solve((columns * (weight * p * (1 - p))[:, None]).T @ columns + np.diag(pull), gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def _passages(texts: DataFrame) -> DataFrame:
    """(label, turn, passage): all passages of the texts, with a hash that puts them in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, label, text in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.column(2).cast(pa.binary())):
                found = list(_blocks(text.as_py(), SAMPLE_BLOCK))
                turns = [hashlib.md5(f"{name}/{i}/".encode() + b).hexdigest() for i, b in enumerate(found)]
                columns = [pa.array([label] * len(found), pa.int32()), pa.array(turns, pa.string()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["label", "turn", "passage"])

    return texts.select("id", "label", "text").mapInArrow(cut, "label int, turn string, passage binary")


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    texts: int = TEXTS, passages: int = PASSAGES,
) -> Model:
    """Dictionaries and calibration from the documents whose ``label`` is 0 (bad) or 1 (good).

    Of the labelled keys of each label the ``texts`` with the smallest hash make the dictionaries, and as many others the
    calibration: the logistic regression of the label on the difference, in which each label weighs as much as it has
    keys.  Of the first ones' passages (1,024 bytes, from everywhere in a text) the ``passages`` with the smallest hash
    are read.  So the driver holds a sample of bounded size however large the tables are.  Keys with both labels,
    null keys and other labels are left out; equal keys count once.  With one label missing every text scores alike.
    """
    session = docs.sparkSession
    known = (
        labels.select(quoted(key).cast("string").alias("id"), quoted(label).cast("int").alias("label"))
        .filter("id is not null and label in (0, 1)")
        .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
        .select("id", "label", F.md5("id").alias("turn"))
        .withColumn("side", F.when(F.col("turn").substr(32, 1).isin(*"0123456789ab"), F.lit("read")).otherwise(F.lit("judge")))
    )
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for value in (0, 1):
        for side in ("read", "judge"):
            part = known.filter((F.col("label") == value) & (F.col("side") == side)).orderBy("turn").limit(texts)
            chosen = part if chosen is None else chosen.union(part)
    # At most 4 x texts keys, whatever the size of the tables.
    found = docs.select(quoted(key).cast("string").alias("id"), F.coalesce(quoted(text), F.lit("")).alias("text")).join(
        F.broadcast(chosen), "id"
    )
    cut, dictionaries = _passages(found.filter("side = 'read'")), []
    for value in (0, 1):
        rows = cut.filter(F.col("label") == value).select("turn", "passage").orderBy("turn").limit(passages).collect()
        dictionaries.append(_train_dictionary([bytes(r.passage) for r in rows]))
    model = Model((dictionaries[0], dictionaries[1]))
    judged = (
        found.filter("side = 'judge'").withColumn("gain", _difference(model, F.col("text"), session))
        .select("id", "label", *[c.alias(n) for c, n in zip(_features(F.col("gain"), F.col("text")), ("x", "size"))])
        .groupBy("id").agg(F.min("label").alias("label"), F.avg("x").alias("x"), F.avg("size").alias("size"))
        .orderBy("id").collect()
    )
    x, y = np.array([(r.x, r.size) for r in judged]), np.array([float(r.label) for r in judged])
    share = {v: totals[v] / max(1, int((y == v).sum())) for v in totals}
    weight = np.array([share[int(v)] for v in y])
    return Model(model.dictionaries, *(_logistic(x, y, weight / weight.mean()) if len(y) else ()))


# --- scoring ------------------------------------------------------------------------------------------
def judge(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability, 0 to 1, that a text is good.

    The whole text is compressed, block by block, with the dictionary of good and with that of bad texts; the score is
    a logistic function of the difference of the two sizes for each byte, in which a short text weighs less.  Null and
    empty texts get the share of good texts; a column called ``into`` is replaced; all other columns and repeated rows
    stay, equal texts score alike; a table without rows stays one.
    """
    whole = F.coalesce(quoted(text).cast("string"), F.lit(""))
    difference, size = _features(_difference(model, whole, docs.sparkSession), whole)
    logit = F.lit(model.prior) + F.lit(model.slope) * difference + F.lit(model.weight) * size
    return add_fields(docs, F.struct((1 / (1 + F.exp(-logit))).alias(into)), [into])


LEAST_SCORE = 0.3


def op11_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from the documents whose key is not held out; the text alone decides a score."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    model = learn(docs, labels.filter(~held_out))
    scored = judge(docs, model).select("doc_id", held_out.alias("held_out"), F.round("score", 9).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))
