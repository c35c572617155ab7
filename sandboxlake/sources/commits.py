"""Commit history of source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def earliest_commit(commits: DataFrame) -> DataFrame:
    """Oldest version and time still held, per table.  ``commits`` is (fqn, version, ts)."""
    return commits.groupBy("fqn").agg(
        F.min("version").alias("earliest_version"), F.min("ts").alias("earliest_ts")
    )


def retention_violations(requested: DataFrame, commits: DataFrame) -> DataFrame:
    """Requested revisions that are older than the oldest commit held.

    ``requested`` has fqn, rev_mode, rev_version, rev_ts.  A table without history is not reported.
    """
    too_old = (
        ((F.col("rev_mode") == "version") & (F.col("rev_version") < F.col("earliest_version")))
        | ((F.col("rev_mode") == "timestamp") & (F.col("rev_ts") < F.col("earliest_ts")))
    )
    return (
        requested.filter(F.col("rev_mode").isin("version", "timestamp"))
        .join(earliest_commit(commits), "fqn")
        .filter(too_old)
    )
