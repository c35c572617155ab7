"""Inventory of jobs and pipelines, the things a stream name can stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandboxlake import fixed


def stream_inventory(jobs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """(kind, name, resource_id, task_keys) of both kinds."""
    keys = F.col("task_keys") if "task_keys" in jobs.columns else F.lit(None)
    return jobs.select(
        F.lit("job").alias("kind"), "name", "resource_id", keys.cast("array<string>").alias("task_keys")
    ).unionByName(
        pipelines.select(
            F.lit("pipeline").alias("kind"), "name", "resource_id", F.lit(None).cast("array<string>").alias("task_keys")
        )
    )


def match_counts(inventory: DataFrame) -> DataFrame:
    """Per name: number of jobs and pipelines, and the id of the one match where there is just one."""
    def only(kind: str, column: str):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    if "task_keys" not in inventory.columns:
        inventory = inventory.withColumn("task_keys", F.lit(None).cast("array<string>"))
    return inventory.groupBy("name").agg(
        F.count_if(F.col("kind") == "job").alias("jobs"),
        F.count_if(F.col("kind") == "pipeline").alias("pipelines"),
        only("job", "resource_id").alias("job_id"),
        only("pipeline", "resource_id").alias("pipeline_id"),
        only("job", "task_keys").alias("task_keys"),
    )


def search_streams(inventory: DataFrame, text: str, limit: int = fixed.STREAM_SEARCH_LIMIT) -> DataFrame:
    """Jobs with just this name, then pipelines that contain it; the first ``limit`` in all."""
    job = (F.col("kind") == "job") & (F.col("name") == text)
    pipeline = (F.col("kind") == "pipeline") & F.contains("name", F.lit(text))
    return (
        inventory.filter(job | pipeline)
        .select("kind", "name", "resource_id")
        .orderBy("kind", "name", "resource_id")
        .limit(limit)
    )
