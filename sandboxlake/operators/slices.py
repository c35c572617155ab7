"""Ordered row numbers and neighbours without putting a group, or the whole table, into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sandboxlake.session import settle

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def range_slices(df: DataFrame, order: Sequence[str | Column], slices: int | None = None) -> DataFrame:
    """Add ``slice_no`` and ``slice_pos``: contiguous, sorted slices of ``df`` in the given order.

    Slices come from range partitioning, so a hot value of the leading column is split as long as
    the later columns tell its rows apart.  The slices are written out, because the boundaries are
    sampled and must not move between the consumers.  Their number follows the shuffle partitions
    of the session unless ``slices`` is given.
    """
    ranged = df.repartitionByRange(*order) if slices is None else df.repartitionByRange(slices, *order)
    numbered = (
        ranged
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("slice_no", F.shiftright("_id", _ROW_BITS))
        .withColumn("slice_pos", F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_id")
    )
    return settle(numbered)


def row_numbers(df: DataFrame, order: Sequence[str | Column], name: str = "row_no") -> DataFrame:
    """Number all rows 1, 2, 3, ... in the given order.

    Only one row per slice goes through the unpartitioned window; their number is the number of
    shuffle partitions, so that side is small by construction and is broadcast.
    """
    slices = range_slices(df, order)
    ahead = W.orderBy("slice_no").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        slices.groupBy("slice_no").agg((F.max("slice_pos") + 1).alias("_rows"))
        .select("slice_no", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"))
    )
    return (
        slices.join(F.broadcast(offsets), "slice_no")
        .withColumn(name, F.col("_ahead") + F.col("slice_pos") + 1)
        .drop("slice_no", "slice_pos", "_ahead")
    )


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the value of the row before, per key.  ``keys + order`` has to tell all rows apart.

    All rows are cut into slices in the order of key and place, whatever a key's size, so no task has to hold a key.  The
    first row of a slice looks at the last row of the closest slice before: one row per slice.
    """
    keys, order = list(keys), list(order)
    slices = range_slices(df, [*keys, *order])
    own = F.struct(*keys)
    last = slices.groupBy("slice_no").agg(F.max_by(F.struct(own.alias("k"), F.col(value).alias("v")), "slice_pos").alias("_last"))
    ahead = W.orderBy("slice_no")  # one row per slice
    carried = last.select("slice_no", F.lag("_last").over(ahead).alias("_carried"))
    here = W.partitionBy("slice_no").orderBy("slice_pos")
    marked = slices.withColumn("_prev", F.lag(F.struct(own.alias("k"), F.col(value).alias("v"))).over(here))
    joined = marked.join(F.broadcast(carried), "slice_no", "left")
    before = F.coalesce("_prev", "_carried")
    return joined.withColumn(name, F.when(before["k"].eqNullSafe(own), before["v"])).select(*df.columns, name)
