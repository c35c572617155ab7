"""From stream names to jobs and pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandboxlake.sources.inventory import match_counts


def resolve_streams(streams: DataFrame, inventory: DataFrame) -> DataFrame:
    """Add resolution, resource_type and resource_id to each (dr_id, name).

    Jobs are looked at first; pipelines only when no job has the name.  More than one match in the
    kind looked at makes the name ambiguous.
    """
    counts = match_counts(inventory)
    hits = F.when(F.col("jobs") > 0, F.col("jobs")).otherwise(F.coalesce(F.col("pipelines"), F.lit(0)))
    one = F.col("resolution") == "resolved"
    job = F.col("jobs") > 0
    return (
        streams.join(counts, "name", "left")
        .withColumn(
            "resolution",
            F.when(hits == 0, "unresolved").when(hits == 1, "resolved").otherwise("ambiguous"),
        )
        .select(
            *streams.columns,
            "resolution",
            F.when(one & job, "job").when(one, "pipeline").alias("resource_type"),
            F.when(one & job, F.col("job_id")).when(one, F.col("pipeline_id")).alias("resource_id"),
            F.when(one & job, F.col("task_keys")).alias("task_keys"),
        )
    )


def ambiguous_streams(inventory: DataFrame) -> DataFrame:
    """Names that stand for more than one thing of the kind that would be consulted."""
    return (
        match_counts(inventory)
        .filter((F.col("jobs") > 1) | ((F.col("jobs") == 0) & (F.col("pipelines") > 1)))
        .select("name", "jobs", "pipelines")
    )


def scannable_requests(resolved: DataFrame) -> DataFrame:
    """Requests whose streams all resolved; one open name stops the whole scan of a request."""
    return (
        resolved.groupBy("dr_id")
        .agg(F.bool_and(F.col("resolution") == "resolved").alias("ok"))
        .filter("ok")
        .select("dr_id")
    )
