"""Time travel over commit-stamped tables and snapshot folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMMIT_COLUMNS = ("commit_version", "commit_ts", "op")


def as_of(
    log: DataFrame,
    keys: Sequence[str],
    *,
    version: int | None = None,
    timestamp: str | Column | None = None,
    keep_commit: bool = False,
) -> DataFrame:
    """Current row per key of a change log, at the latest state, a version, or a point in time.

    ``commit_version`` has to be unique per key.  The bound is a plain predicate and reaches the
    scan; the rank-1 cut runs before the shuffle, so a key with very many versions sends at most
    one row per map task.
    """
    if version is not None and timestamp is not None:
        raise ValueError("give a version or a timestamp, not both")
    if version is not None:
        log = log.filter(F.col("commit_version") <= F.lit(version))
    if timestamp is not None:
        bound = F.lit(timestamp).cast("timestamp").cast(log.schema["commit_ts"].dataType) if isinstance(timestamp, str) else timestamp
        log = log.filter(F.col("commit_ts") <= bound)
    newest = W.partitionBy(*keys).orderBy(F.col("commit_version").desc())
    rows = (
        log.withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") == 1)
        .filter(F.col("op") != "delete")
        .drop("_rn")
    )
    return rows if keep_commit else rows.drop(*COMMIT_COLUMNS)


def snapshot_as_of(snapshots: DataFrame, version: int, column: str = "v") -> DataFrame:
    """Rows of the newest snapshot folder ``v=<N>`` with N at or below ``version``.

    Finding N touches partition values only, and the rows come from that one folder.
    """
    picked = (
        snapshots.select(column).filter(F.col(column) <= version).agg(F.max(column).alias("n")).first()["n"]
    )
    return snapshots.filter(F.col(column) == F.lit(picked)).drop(column)


def overlay(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base rows with later changes laid over them: how a file-sharing clone reads once it was written to.

    ``changes`` is commit-stamped; keys have to be unique in ``base``.
    """
    latest = as_of(changes, keys, keep_commit=True)
    touched = changes.select(*keys).distinct()
    kept = base.join(touched, list(keys), "left_anti")
    return kept.unionByName(latest.select(*base.columns))
