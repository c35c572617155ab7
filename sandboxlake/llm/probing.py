"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking.

The nearest vectors are those of the largest inner product.  Every vector gets one more component that
brings it to the largest norm of the table, queries get a zero there; then the order by inner product is
the order by distance, which p-stable hashing is made for.

A table has a few hash functions floor((a . x + b) / w) with normal a.  A query visits its own bucket and
then perturbed ones, in the order of estimated success: going to a neighbouring cell costs the squared
distance to its border, and sets of such steps are taken by rising sum (a step and its opposite exclude
each other).  Candidates of all tables and probes are scored exactly in double precision, and the best
ones of each bucket are merged per query.  A row lies in one bucket per table, so a pair is found once per
table at most: the best k times tables rows of a query hold its k best, and everything beyond them is cut
before the shuffle.

The parameters are for vectors without cluster structure, whose nearest neighbours are hardly nearer than
other vectors: to find nine of ten, a query has to see most rows, so cells are wide and many are visited.
Clustered vectors do with narrower cells and fewer probes.  Buckets are cut into slices of bounded size, which all queries of a bucket
visit, so a bucket full of copies is spread out.  A query with too few candidates is compared with all rows,
in the same slices.

Defined results: vectors that are null or zero or hold a null or non-finite component take no part, nor do
rows without an id; all candidates come back where there are fewer than asked for; ties go to the smaller
id; rows with an id that repeats are rows of their own, as candidates and as queries (each has its ranks), and a query
leaves out its own row alone; vectors of a length other
than the most frequent one take no part; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sandboxlake.llm.running import small_batches
from sandboxlake.session import settle

TABLES = 2
FUNCTIONS = 4  # per table
WIDTH = 2.0  # of a cell, relative to the largest norm
PROBES = 40
ROWS_PER_SLICE = 4096
QUERIES_PER_SLICE = 2048
QUERIES_AT_ONCE = 32


@dataclass(frozen=True)
class Hashing:
    """The hash functions of all tables; the same for the same dimension, norm and seed."""

    dimension: int
    norm: float
    tables: int = TABLES
    functions: int = FUNCTIONS
    width: float = WIDTH
    seed: int = 0

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables, functions): positions on the axes, in cells."""
        rng = np.random.default_rng(self.seed)
        axes = rng.standard_normal((self.dimension + 1, self.tables * self.functions))
        cell = self.width * self.norm
        shifts = rng.random(self.tables * self.functions)
        return (vectors @ axes / cell + shifts).reshape(len(vectors), self.tables, self.functions)

    def stretched(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of one length, by one more component."""
        rest = np.sqrt(np.maximum(self.norm**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
        return np.column_stack((vectors, rest))

    def asked(self, vectors: np.ndarray) -> np.ndarray:
        """Queries, brought to the common length in their own direction."""
        lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.column_stack((vectors * (self.norm / lengths), np.zeros(len(vectors))))


def probe_sets(functions: int, probes: int) -> list[tuple[int, ...]]:
    """The first ``probes`` sets of steps by expected cost.

    Step j (from 0) crosses the border that is the j-th nearest of the 2 * functions borders; its expected
    squared distance is the same for every query, so the order is worked out once.  The opposite of step
    j is step 2 * functions - 1 - j.
    """
    m = functions
    cost = [((j + 1) * (j + 2) / (4 * (m + 1) * (m + 2))) if j < m else 1 - (2 * m - j) / (m + 1) + (2 * m - j) * (2 * m - j + 1) / (4 * (m + 1) * (m + 2)) for j in range(2 * m)]
    found: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(found) < probes:
        total, steps = heapq.heappop(heap)
        last = steps[-1]
        if not any(2 * m - 1 - s in steps for s in steps):
            found.append(steps)
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*steps[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*steps, last + 1)))
    return found


def _bucket_keys(cells: np.ndarray) -> np.ndarray:
    """One number for the cells (..., tables, functions) of each table."""
    keys = np.zeros(cells.shape[:-1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(cells.shape[-1]):
            keys = (keys ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
        tables = np.arange(cells.shape[-2], dtype=np.uint64)
        return ((keys + tables) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _lists(keys: np.ndarray) -> pa.Array:
    ends = np.arange(0, keys.size + 1, keys.shape[1] if keys.ndim > 1 else 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))


def _own_buckets(hashing: Hashing):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def buckets(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.int64()))
        cells = np.floor(hashing.scores(hashing.stretched(_matrix(column))))
        return _lists(_bucket_keys(cells))

    return buckets


def _probed_buckets(hashing: Hashing, probes: int):
    sets = probe_sets(hashing.functions, probes)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def buckets(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.int64()))
        scores = hashing.scores(hashing.asked(_matrix(column)))
        cells = np.floor(scores)
        low = scores - cells
        borders = np.concatenate((low, 1 - low), axis=-1)  # going down, then up
        order = np.argsort(borders, axis=-1)
        keys = []
        rows, tables = np.indices(order.shape[:2])
        for steps in sets:
            moved = cells.copy()
            for s in steps:
                which = order[..., s]
                up = which >= hashing.functions
                moved[rows, tables, which - hashing.functions * up] += np.where(up, 1, -1)
            keys.append(_bucket_keys(moved))
        return _lists(np.concatenate(keys, axis=1))

    return buckets


def _usable(vectors: DataFrame, is_query: Column, key: str, vector: str) -> DataFrame:
    """(id, v, asked) of the rows that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    plain = vectors.schema[vector].dataType.simpleString() in ("array<float>", "array<double>")
    numbers = F.col(vector) if plain else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), numbers.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


_FOUND = "query_row long, query_id long, vec_row long, vec_id long, score double"
_SCHEMA = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _best_of(k: int):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best rows of a slice for each of the queries that visit it."""
        if not len(left) or not len(right):
            return _SCHEMA.empty_table()
        ids, places = right["id"].to_numpy(), right["row"].to_numpy()
        order = np.lexsort((places, ids))
        ids, places, rows = ids[order], places[order], _matrix(right["v"].combine_chunks())[order]
        asked, own_places, vectors = left["id"].to_numpy(), left["row"].to_numpy(), _matrix(left["v"].combine_chunks())
        take, found = min(k, len(ids)), []
        for low in range(0, len(asked), QUERIES_AT_ONCE):
            own, own_id, q = (x[low : low + QUERIES_AT_ONCE] for x in (own_places, asked, vectors))
            scores = q @ rows.T
            scores[own[:, None] == places[None, :]] = -np.inf
            bar = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
            # a matrix product may add equal rows up differently; whoever could be among the best is added up
            # in one order, so that equal vectors tie
            slack = 1e-12 * np.linalg.norm(q, axis=1) * np.abs(rows).max() * rows.shape[1]
            at, which = np.nonzero((scores >= (bar - slack)[:, None]) & (scores > -np.inf))
            score = (q[at] * rows[which]).sum(axis=1)
            first = np.lexsort((which, -score, at))
            at, which, score = at[first], which[first], score[first]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < take
            at, which = at[keep], which[keep]
            found.append(pa.table([own[at], own_id[at], places[which], ids[which], score[keep]], schema=_SCHEMA))
        return pa.concat_tables(found)

    return best


def _within(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Best rows per (bucket, slice, block of queries), for frames (bucket, row, id, v); the buckets are cut to bounded groups."""
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_SLICE).cast("int").alias("slices"))
    asked = queries.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_SLICE).cast("int").alias("blocks"))
    cuts = settle(sizes.join(asked, "bucket"))
    here = rows.join(cuts, "bucket").withColumn("slice", F.pmod(F.xxhash64("row"), "slices"))
    there = queries.join(cuts, "bucket").withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    spread_rows = here.select("bucket", "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))).alias("block"), "row", "id", "v")
    spread_queries = there.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - F.lit(1).cast("long"))).alias("slice"), "block", "row", "id", "v")
    group = ["bucket", "slice", "block"]
    return spread_queries.groupBy(*group).cogroup(spread_rows.groupBy(*group)).applyInArrow(_best_of(k), _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query; Spark cuts each task's rows to k per query before it shuffles them."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20,
    tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, probes: int = PROBES, seed: int = 0,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row for which ``is_query`` holds."""
    small_batches(vectors.sparkSession)
    usable = settle(_usable(vectors, is_query, key, vector).withColumn("row", F.monotonically_increasing_id()))
    lengths = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = usable.filter(F.size("v") == lengths["d"])
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    norm = usable.agg(F.sqrt(F.max(squares))).first()[0]
    hashing = Hashing(lengths["d"], norm, tables, functions, width, seed)
    # columns of their own, as queries and rows come from one table and meet in a cogroup
    asked = usable.filter("asked").select(*[F.col(c).alias(c) for c in ("row", "id", "v")])
    rows = usable.select(F.explode(_own_buckets(hashing)("v")).alias("bucket"), "row", "id", "v")
    queries = asked.select(F.explode(F.array_distinct(_probed_buckets(hashing, probes)("v"))).alias("bucket"), "row", "id", "v")
    pair = ["query_row", "query_id", "vec_row", "vec_id"]
    found = _first(_within(queries, rows, k), k * tables).groupBy(*pair).agg(F.max("score").alias("score"))
    found = settle(found)

    few = found.groupBy("query_row").count().filter(F.col("count") >= k).select(F.col("query_row").alias("done"))
    rest = asked.join(few, F.col("row") == F.col("done"), "left_anti").select(F.lit(0).cast("long").alias("bucket"), "row", "id", "v")
    everything = usable.select(F.lit(0).cast("long").alias("bucket"), "row", "id", "v")
    merged = _first(found.unionByName(_within(rest, everything, k)), 2 * k).groupBy(*pair).agg(F.max("score").alias("score"))
    return _first(merged, k).select("query_id", "rank", "vec_id", "score")
