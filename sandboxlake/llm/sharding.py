"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are permuted inside their input partition and written out with their place in it.  How many rows of
each partition go to each shard is drawn without replacement: the matrix of counts has the distribution
that a uniform permutation of all rows would give it, and its column sums are the wanted sizes exactly.
Since a partition is permuted, its first rows go to the first shard, the next ones to the second and so
on.  After the exchange every shard is permuted again, in slices whose number follows the rows, so that no
task holds a whole shard.

The matrix is drawn by halving: all partitions together have the wanted sizes, the left half of the
partitions takes its share of every column by hypergeometric draws, the right half the rest, and so on
down to single partitions.  A draw inverts the distribution function outwards from the most likely value.
All of it is column expressions, over one row per partition.

Defined results: the numbers of rows of any two shards differ by one at most, also with fewer rows than
shards; nulls, empty and repeated rows are placed like any other; an empty table gives an empty result;
all columns are passed on, and the two that are added get underscores in front if their names are taken.
The same files, session settings and seed give the same shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sandboxlake.llm.columns import fresh, let
from sandboxlake.session import settle

ROWS_PER_SLICE = 50_000
_PART_BITS = 33  # monotonically_increasing_id keeps the partition above these bits
_DEVIATIONS = 9  # so many standard deviations, and EXTRA values, are looked at on either side
_EXTRA = 20


def _uniform(seed: int, *parts: Column) -> Column:
    """A number from 0 up to 1 that depends on the seed and the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def hypergeometric(u: Column, good: Column, bad: Column, draws: Column) -> Column:
    """How many good ones are among the draws, for a uniform ``u``.

    Weights relative to the most likely value follow from ratios of neighbouring probabilities.
    """
    total = good + bad

    def with_bounds(p: Column) -> Column:
        g, b, d = p["g"], p["b"], p["d"]
        low, high = F.greatest(F.lit(0).cast("long"), d - b), F.least(d, g)
        share = g.cast("double") / F.greatest(g + b, F.lit(1))
        spread = F.sqrt(F.greatest(d * share * (1 - share) * (g + b - d) / F.greatest(g + b - 1, F.lit(1)), F.lit(0.0)))
        reach = F.ceil(_DEVIATIONS * spread).cast("long") + _EXTRA
        top = F.floor((d + 1).cast("double") * (g + 1) / (g + b + 2)).cast("long")
        return let(
            F.struct(g.alias("g"), b.alias("b"), d.alias("d"), p["u"].alias("u"), F.least(F.greatest(top, low), high).alias("top"), low.alias("low"), high.alias("high"), reach.alias("reach")),
            with_weights,
        )

    def with_weights(p: Column) -> Column:
        g, b, d, top = p["g"], p["b"], p["d"], p["top"]

        def up(k: Column) -> Column:  # weight of k over weight of k - 1
            return (g - k + 1).cast("double") * (d - k + 1) / (k.cast("double") * (b - d + k))

        def down(k: Column) -> Column:  # weight of k over weight of k + 1
            return (k + 1).cast("double") * (b - d + k + 1) / ((g - k).cast("double") * (d - k))

        none = F.array().cast("array<bigint>")
        above = F.when(top < p["high"], F.sequence(top + 1, F.least(p["high"], top + p["reach"]))).otherwise(none)
        below = F.when(top > p["low"], F.sequence(top - 1, F.greatest(p["low"], top - p["reach"]), F.lit(-1).cast("long"))).otherwise(none)

        def total_of(values: Column, ratio) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
            return F.aggregate(values, start, lambda s, k: let(s["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))))["sum"]

        def walk(state: Column, values: Column, ratio) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), state["left"].alias("left"), state["hit"].alias("hit"))
            return F.aggregate(values, start, lambda s, k: let(s["w"] * ratio(k), lambda w: F.struct(
                w.alias("w"), (s["left"] - w).alias("left"),
                F.when(s["hit"].isNull() & (s["left"] < w), k).otherwise(s["hit"]).alias("hit"),
            )))

        weight = 1 + total_of(above, up) + total_of(below, down)
        left = p["u"] * weight - 1
        start = F.struct(left.alias("left"), F.when(left < 0, top).alias("hit"))
        return let(start, lambda s: let(walk(s, above, up), lambda t: F.coalesce(walk(t, below, down)["hit"], top)))

    return F.when(total <= 0, F.lit(0).cast("long")).otherwise(
        let(F.struct(good.alias("g"), bad.alias("b"), draws.alias("d"), u.alias("u")), with_bounds)
    )


def _share(sizes: Column, rows: Column, node: Column, seed: int) -> Column:
    """What a part with so many rows takes of each column of ``sizes``: one draw after the other."""
    start = F.struct(
        rows.alias("rows"), _sum(sizes).alias("all"),
        F.array().cast("array<bigint>").alias("out"),
    )

    def draw(s: Column, size: Column) -> Column:
        u = _uniform(seed, node, F.size(s["out"]))
        return let(hypergeometric(u, size, s["all"] - size, s["rows"]), lambda x: F.struct(
            (s["rows"] - x).alias("rows"), (s["all"] - size).alias("all"), F.concat(s["out"], F.array(x)).alias("out")
        ))

    return F.aggregate(sizes, start, draw)["out"]


def communication_matrix(counts: DataFrame, parts: int, shards: int, seed: int) -> DataFrame:
    """(part, takes): for each input partition how many of its rows each shard gets, from counts (part, n)."""
    whole = counts.agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    levels = max(parts - 1, 0).bit_length()
    every = F.sequence(F.lit(0).cast("long"), F.lit((1 << levels) - 1).cast("long"))
    even = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(F.col("rows") / shards).cast("long") + (s < F.col("rows") % shards).cast("long"))
    nodes = whole.select(
        F.lit(1).cast("long").alias("node"), F.transform(every, lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0).cast("long"))).alias("n"), even.alias("takes")
    )
    for level in range(levels):
        half = 1 << (levels - level - 1)
        left, right = F.slice("n", 1, half), F.slice("n", half + 1, half)
        rows = _sum(left)
        taken = nodes.withColumn("left", _share(F.col("takes"), rows, F.col("node"), seed))
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("n"), F.col("left").alias("takes")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("n"), F.zip_with("takes", "left", lambda a, b: a - b).alias("takes")),
        )
        nodes = taken.select(F.inline(children))
        if level % 4 == 3:
            nodes = nodes.repartition("node")  # the lower levels have most of the draws
    return nodes.select((F.col("node") - (1 << levels)).alias("part"), "takes").filter(_sum(F.col("takes")) > 0)


def shard(docs: DataFrame, shards: int, seed: int = 0, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (0, 1, ... without gaps in each shard)."""
    names = {name: fresh(name, docs.columns) for name in ("shard", "slot", "part", "at", "cut", "before", "of_part", "ends")}
    at, part, cut, before = (F.col(names[n]) for n in ("at", "part", "cut", "before"))
    entry = fresh("entry", docs.columns)
    permuted = (
        docs.withColumn(entry, F.monotonically_increasing_id())
        .sortWithinPartitions(F.xxhash64(F.lit(seed), F.col(entry)))
        .drop(entry)
        .withColumn(names["at"], F.monotonically_increasing_id())
    )
    kept = settle(permuted)
    placed = kept.withColumn(names["part"], F.shiftright(at, _PART_BITS)).withColumn(names["at"], at.bitwiseAND(F.lit((1 << _PART_BITS) - 1)))
    counts = settle(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")))
    size = counts.agg(F.coalesce(F.max("part"), F.lit(-1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    matrix = settle(
        communication_matrix(counts, size[0] + 1, shards, seed)
        .select(F.col("part").alias(names["of_part"]), F.transform("takes", lambda x, i: _sum(F.slice("takes", 1, i + 1))).alias(names["ends"]))
    )
    slices = -(-size[1] // (shards * rows_per_slice)) or 1

    def sent(rows: DataFrame) -> DataFrame:
        """Adds the shard, and the slice of it, from the place in the input partition."""
        number = F.size(F.filter(F.col(names["ends"]), lambda e: e <= at))
        again = F.pmod(F.xxhash64(F.lit(seed + 1), part, at), F.lit(slices))
        return rows.join(matrix, part == F.col(names["of_part"])).withColumn(names["shard"], number).withColumn(names["cut"], again).drop(names["of_part"], names["ends"])

    keys = [names["shard"], names["cut"]]
    sizes = sent(placed.select(names["part"], names["at"])).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(names["shard"]).orderBy(names["cut"]).rowsBetween(W.unboundedPreceding, -1)  # a row per slice
    offsets = settle(sizes.withColumn(names["before"], F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    inside = W.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed + 2), part, at), part, at)
    numbered = sent(placed).withColumn(names["slot"], F.row_number().over(inside) - 1)
    return numbered.join(offsets, keys).select(
        *[F.col(f"`{c}`") for c in docs.columns], names["shard"], (before + F.col(names["slot"])).cast("long").alias(names["slot"])
    )
