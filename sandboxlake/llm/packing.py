"""Best-fit packing of token sequences by matching of large items.

Items (documents, or the pieces of documents longer than a sequence) have whole sizes from 1 to the
capacity, so a packing is decided on the histogram of sizes: a table of at most ``capacity`` numbers,
however many items there are.  The plan says which ranks of a size go to which bins at which offset, as
runs; every item finds its place from its size and its rank among the items of that size.

Method: items above a third of the capacity come first, two to a bin at most: from the largest down, an
item takes the largest unmatched partner that fits beside it.  The smaller items follow from the largest
down, each into the fullest bin that still has room for it, and open a bin only if none has.

Defined results: a null text is an empty one and still has its end token; repeated rows are packed
each; ties among items of a size follow the order of the input; an empty table gives an empty result;
extra columns do no harm, as only the named ones are read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sandboxlake.llm import tokens
from sandboxlake.session import settle

CAPACITY = 1024
_PART_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


@dataclass
class Plan:
    """Runs (size, first rank, number of items, first bin, offset) and the number of bins."""

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    bins: int = 0


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan()
    rank = dict.fromkeys(histogram, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left: runs of bins (first, number)

    def put(size: int, many: int, first: int, offset: int) -> None:
        plan.runs.append((size, rank[size], many, first, offset))
        rank[size] += many

    def opened(many: int) -> int:
        plan.bins += many
        return plan.bins - many

    large = {s: n for s, n in histogram.items() if 3 * s > capacity and n}
    for size in sorted(large, reverse=True):
        while large[size]:
            partner = max((p for p in large if large[p] and p + size <= capacity and (p != size or large[p] > 1)), default=0)
            pairs = (large[size] // 2 if partner == size else min(large[size], large[partner])) if partner else large[size]
            first = opened(pairs)
            put(size, pairs, first, 0)
            large[size] -= pairs
            if partner:
                put(partner, pairs, first, size)
                large[partner] -= pairs
            gaps.setdefault(capacity - size - partner, []).append((first, pairs))
    for size in sorted((s for s in histogram if 3 * s <= capacity), reverse=True):
        left = histogram[size]
        while left:
            room = min((g for g, runs in gaps.items() if runs and g >= size), default=0)
            if room:
                first, many = gaps[room].pop()
            else:
                room = capacity
                many = -(-left // (capacity // size))
                first = opened(many)
            taken = min(left, many)
            if taken < many:
                gaps.setdefault(room, []).append((first + taken, many - taken))
            put(size, taken, first, capacity - room)
            gaps.setdefault(room - size, []).append((first, taken))
            left -= taken
    return plan


_PIECES = T.ArrayType(T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
]))


def _cut(length: int, capacity: int) -> list[int]:
    """Starts of the pieces; only the first can be shorter than the capacity."""
    return [0, *range(length % capacity or capacity, length, capacity)]


def _pieces(capacity: int, with_ids: bool):
    @F.arrow_udf(_PIECES)
    def pieces(column: pa.Array) -> pa.Array:
        rows, piece, start, length, crc, kept, sizes = [0], [], [], [], [], [], []
        for ids, bounds in tokens.encode_column(column):
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.append(ids[low:high], tokens.END_ID).astype("<u4")
                starts = _cut(len(own), capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(own)], strict=True)):
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own[a:b].tobytes()))
                    if with_ids:
                        kept.append(own[a:b])
                    sizes.append(b - a if with_ids else 0)
                rows.append(len(piece))
        values = pa.array(np.concatenate(kept).astype(np.int32) if kept else np.zeros(0, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)
        if not with_ids:
            lists = pa.nulls(len(piece), lists.type)
        names = ["piece", "start", "length", "ids_crc32", "ids"]
        arrays = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), lists]
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(arrays, names=names))

    return pieces


def _places(runs: list[tuple[int, int, int, int, int]], capacity: int):
    """(size, rank) to (sequence, offset) by a search among the runs, which are sorted by size and rank."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    size_starts = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def places(size: pa.Array, rank: pa.Array) -> pa.Array:
        size, rank = (np.asarray(c, np.int64) for c in (size, rank))
        run = np.empty(len(size), np.int64)
        for s in np.unique(size).tolist():
            low, high = size_starts[s], size_starts[s + 1]
            own = size == s
            run[own] = low + np.searchsorted(table[low:high, 1], rank[own], "right") - 1
        found = table[run]
        return pa.StructArray.from_arrays([pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], names=["sequence_id", "offset"])

    return places


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    Pieces are written out once, with their place in the input; ranks within a size are the rank within
    an input partition plus the number of such pieces in the partitions before it.
    """
    pieces = _pieces(capacity, with_ids)
    cut = docs.select(F.col(key).alias("_key"), F.explode(pieces(F.col(text).cast("string"))).alias("_p"))
    fields = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    items = settle(cut.select("_key", *[F.col("_p")[f].alias(f) for f in fields], F.monotonically_increasing_id().alias("_pos")))
    part = F.shiftright("_pos", _PART_BITS)
    by_part = items.groupBy(part.alias("_part"), "length").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    counts = settle(by_part.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    places = _places(plan_bins(histogram, capacity).runs, capacity)
    narrow = items.select("_key", *fields, "_pos", part.alias("_part"))
    local = W.partitionBy("_part", "length").orderBy("_pos")
    ranked = narrow.withColumn("_local", F.row_number().over(local) - 1).join(counts.drop("_n"), ["_part", "length"])
    placed = ranked.withColumn("_at", places("length", F.col("_before") + F.col("_local")))
    return placed.select(F.col("_key").alias(key), *fields, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., with_ids=True)``; each holds at most a capacity of ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
