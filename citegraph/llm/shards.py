"""Sharding by rendezvous hashing, and gapless slots inside each shard; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegraph.llm.common import fresh, table

#: Hexadecimal digits of a digest that name a numbering range: 3 make 4,096 ranges per shard.
RANGE_DIGITS = 3


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard alone: the first 48 bits of a digest."""
    digest = F.md5(F.concat(key, F.lit(f"/{shard}")))
    bits = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def _score(key: Column, shard: int, weight: float) -> Column:
    """The highest score wins; shards win in proportion to their weights."""
    draw = _draw(key, shard)
    return draw if weight == 1.0 else F.pow(draw, F.lit(1.0 / weight))


def _winner(key: Column, weights: Sequence[float]) -> Column:
    scores = [F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("minus")) for i, w in enumerate(weights)]
    return F.array_max(F.array(*scores))


def assign_shards(
    docs: DataFrame, key: str, weights: Sequence[float], into: str = "shard", grown: str | None = None,
    grown_weight: float = 1.0,
) -> DataFrame:
    """``docs`` with the shard, 0 to ``len(weights)`` - 1, that scores highest for the record key.

    Key and weights alone decide, so no rows meet and nothing is shuffled.  Adding a shard moves rows only into it,
    removing one moves only its rows, changing a weight moves rows only to or from that shard.  A shard of weight w
    wins with probability w / total.  Rows with equal keys share a shard; a null key counts as a key of its own.
    ``grown`` names a column for the shard that one more shard of ``grown_weight`` would lead to.
    Columns of these names are replaced, all others stay.
    """
    if not weights or min(weights) <= 0 or not all(map(math.isfinite, weights)):
        raise ValueError("weights must be positive")
    text = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))
    best = fresh(docs, "best")
    with_best = docs.withColumn(best, _winner(text, weights))
    out = with_best.withColumn(into, -F.col(best)["minus"])
    if grown:
        more = F.struct(_score(text, len(weights), grown_weight).alias("score"), F.lit(-len(weights)).alias("minus"))
        out = out.withColumn(grown, -F.greatest(F.col(best), more)["minus"])
    return out.drop(best)


def number_slots(rows: DataFrame, shard: str, order: Sequence[str], into: str = "slot") -> DataFrame:
    """``rows`` with a gapless number from 0 inside each shard.

    A shard is cut into ranges by a digest of the ``order`` columns; slots follow the range, then these columns.
    Equal rows are counted first, so a record that makes up a third of the table is one row when the ranges are
    numbered; the number of its first slot is spread over its copies afterwards.  Only the sizes of the ranges, 4,096
    per shard, meet in one place.
    Only the ``shard`` and ``order`` columns are returned, with ``into``; equal rows get different numbers.
    """
    by = [shard, *dict.fromkeys(order)]
    part, copies, before, offset, size = (fresh(rows, n) for n in ("range", "copies", "before", "offset", "size"))
    unique = (
        rows.groupBy(*by).agg(F.count(F.lit(1)).alias(copies))
        .withColumn(part, F.substring(F.md5(F.concat_ws("/", *[F.col(c).cast("string") for c in order])), 1, RANGE_DIGITS))
    )
    inside = Window.partitionBy(shard, part).orderBy(*order)
    numbered = unique.withColumn(
        before, F.sum(copies).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(copies)
    )
    sizes = unique.groupBy(shard, part).agg(F.sum(copies).alias(size))
    ahead = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    offsets = sizes.select(shard, part, (F.sum(size).over(ahead) - F.col(size)).alias(offset))
    first = F.col(before) + F.col(offset)
    return (
        numbered.join(offsets, [shard, part])
        .select(*by, F.explode(F.sequence(first, first + F.col(copies) - 1)).alias(into))
    )


SHARDS = 24


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = assign_shards(docs, "doc_id", [1.0] * SHARDS, grown="grown_shard")
    slots = number_slots(placed, "shard", ["doc_id", "size", "text_crc32", "grown_shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# The checksum of RFC 1952 as a fold over bytes, since the other engine has no function for it.
_CRC = """
crc_table AS (
    SELECT list(v ORDER BY n) AS t FROM (
        SELECT n, list_reduce(list_prepend(n, range(8)),
            lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM (SELECT unnest(range(256)) AS n)))"""
ORACLE = f"""
WITH {_CRC},
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
bytes AS (
    SELECT doc_id, octet_length(encode(text)) + 8 AS size,
        list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS bigint)) AS b FROM docs),
summed AS (
    SELECT doc_id, CAST(size AS bigint) AS size, xor(4294967295, list_reduce(list_prepend(4294967295, b),
        lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS text_crc32 FROM bytes, crc_table),
drawn AS (
    SELECT *, coalesce('k' || CAST(doc_id AS varchar), 'null') AS key FROM summed),
scored AS (
    SELECT *, list_transform(range({SHARDS + 1}),
        lambda s: CAST('0x' || substr(md5(key || '/' || CAST(s AS varchar)), 1, 12) AS bigint)) AS d FROM drawn),
placed AS (
    SELECT doc_id, size, text_crc32, 'key' AS law,
        CAST(list_position(d[1:{SHARDS}], list_max(d[1:{SHARDS}])) - 1 AS integer) AS shard,
        CAST(list_position(d, list_max(d)) - 1 AS integer) AS grown_shard FROM scored)
SELECT *, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws('/', CAST(doc_id AS varchar),
    CAST(size AS varchar), CAST(text_crc32 AS varchar), CAST(grown_shard AS varchar))), 1, {RANGE_DIGITS}),
    doc_id, size, text_crc32, grown_shard) - 1 AS slot
FROM placed
"""
