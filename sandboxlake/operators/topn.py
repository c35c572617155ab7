"""First rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Up to this n Spark cuts each key to n rows before the shuffle (its window group limit).
_MAP_SIDE_LIMIT = 1000


def ranked_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each key in the given order, numbered from 1.

    ``order`` should tell the rows of a key apart.  For a small ``n`` the cut happens before the
    shuffle.  For a larger one a first pass cuts each part of a key to ``n`` rows; a key of m rows is spread over about
    sqrt(m / n) parts, so neither a part nor what is left of the key is more than about sqrt(m n) rows.
    """
    if n > _MAP_SIDE_LIMIT:
        counted = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.ceil(F.sqrt(F.count(F.lit(1)) / n)).alias("_parts"))
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        part = W.partitionBy(*keys, "_salt").orderBy(*order)
        columns = df.columns
        df = (
            df.join(counted, same).withColumn("_salt", F.pmod(F.xxhash64(*columns), F.col("_parts"))).select(*columns, "_salt")
            .repartition(*keys, "_salt")  # also when the rows already come partitioned by the key alone
            .withColumn("_rn", F.row_number().over(part))
            .filter(F.col("_rn") <= n)
            .drop("_salt", "_rn")
        )
    whole = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """``ranked_rows`` without the numbers."""
    return ranked_rows(df, keys, order, n, "_rank").drop("_rank")
