"""Mixing sources to target weights by repetition rates.

Sizes are summed per source; each source's target is its weight's share of all sizes, but at most
``most`` times its own size, the excess going to the other sources by weight.  The repetition rate of a
source is its target over its size.  A document is emitted floor(rate) times, and once more if a hash of
its id and the seed falls below the fraction.

Only one row per source takes part in the balancing, and only sums over those rows reach the driver.  In
the join, documents are on the side that runtime re-planning can split, as one source may hold a third.

Defined results: a null text has size 0; a null source is a source of its own, and null is the last in
order; a source whose documents are all empty has target 0 and is left out; repeated rows fall alike;
rates are the same for all rows of a source; an empty table gives an empty result; added columns get
underscores in front if their names are taken.  The same rows and seed give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sandboxlake.llm.columns import fresh
from sandboxlake.session import settle

MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
_DRAW = float(16**13)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number from 0 up to 1 by the hash of an id and the seed."""
    digits = F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(_DRAW)


def rotating_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, 1, 2, ... for sources (one row each) by code point, null last."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", (place % 3 + 1).cast("double").alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size) and (source, weight).

    A source is full when its share would exceed its limit; each round shares what is left among the
    others, until no further source is full.  A source that is full stays so, as shares only grow.
    """
    weighed = settle(sizes.join(weights.select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    limit = F.col("source_size") * F.lit(float(most))
    all_words = weighed.agg(F.sum("source_size")).first()[0] or 0
    share, full = 0.0, -1
    while True:
        # share: what a weight of 1 gets; sums of whole sizes are exact in any order
        is_full = F.col("weight") * F.lit(share) > limit
        now = weighed.agg(
            F.count_if(is_full), F.sum(F.when(is_full, F.col("source_size"))), F.sum(F.when(~is_full, F.col("weight")))
        ).first()
        if now[0] == full or not now[2]:
            break
        full, share = now[0], (all_words - most * (now[1] or 0)) / now[2]
    return weighed.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(share)).alias("target"))


def with_copies(docs: DataFrame, weights=rotating_weights, key: str = "doc_id", text: str = "text", source: str = "source", most: float = MOST_REPEATS, seed: int = 0) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with size, source_size, target and copies, and the names these columns got.

    ``weights`` makes (source, weight) from the distinct sources, or is such a frame.
    """
    names = {n: fresh(n, docs.columns) for n in ("size", "source_size", "target", "copies")}
    of = fresh("aim_source", [*docs.columns, *names.values()])
    sizes = settle(docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(n_words(F.col(f"`{text}`"))).alias("source_size")))
    table = weights if isinstance(weights, DataFrame) else weights(sizes.select("source"))
    aims = settle(targets(sizes, table, most)).select(
        F.col("source").alias(of), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"])
    )
    joined = docs.join(aims, F.col(f"`{source}`").eqNullSafe(F.col(of)), "left").drop(of)
    total = F.col(names["source_size"])
    rate = F.when(total > 0, F.col(names["target"]) / total).otherwise(F.lit(0.0))
    extra = (draw(F.col(f"`{key}`"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(names["size"], n_words(F.col(f"`{text}`"))).withColumn(names["copies"], F.floor(rate) + extra), names


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row as often as its source's rate and its draw say, with its columns."""
    counted, names = with_copies(docs, **options)
    copies = F.col(names["copies"])
    return counted.filter(copies > 0).withColumn(names["copies"], F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])
