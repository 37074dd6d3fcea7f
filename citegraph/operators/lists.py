"""Numbering of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegraph.session import materialise

def dense_index(df: DataFrame, order_by: list[str], name: str = "position") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of ``order_by`` (a unique key).

    Range partitions are sorted in parallel and materialised, so that a row keeps its place; the offset
    of each partition is then a running sum over one row per partition.
    """
    placed = materialise(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id holds the partition above bit 33 and the row in it below.
    placed = placed.withColumn("_partition", F.shiftright("_place", 33)).withColumn(
        "_row", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = placed.groupBy("_partition").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_partition", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    # One row per partition: the partition count bounds the broadcast.
    return placed.join(F.broadcast(offsets), "_partition").select(
        *df.columns, (F.col("_offset") + F.col("_row")).alias(name)
    )
