"""Run results from outcome rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandboxlake import fixed


def run_status(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Final and audit status per request, with counters.  A run with no outcomes is a success."""
    counted = outcomes.groupBy("dr_id").agg(
        F.count_if(F.col("success")).alias("succeeded"), F.count_if(~F.col("success")).alias("failed")
    )
    zero = F.lit(0).cast("bigint")
    none_ok = (F.col("succeeded") == 0) & (F.col("failed") > 0)
    return (
        requests.select("dr_id").join(counted, "dr_id", "left")
        .select("dr_id", F.coalesce("succeeded", zero).alias("succeeded"), F.coalesce("failed", zero).alias("failed"))
        .withColumn("final_status", F.when(none_ok, fixed.FAILED).otherwise(fixed.ACTIVE))
        .withColumn(
            "audit_status",
            F.when(none_ok, fixed.FAILED)
            .when(F.col("failed") > 0, fixed.PARTIAL_SUCCESS)
            .otherwise(fixed.SUCCESS),
        )
    )


def cleanup_status(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Cleanup is done only when nothing failed; else the request stays in cleanup."""
    status = run_status(requests, outcomes)
    clean = F.col("failed") == 0
    return status.withColumn(
        "final_status", F.when(clean, fixed.CLEANED_UP).otherwise(fixed.CLEANUP_IN_PROGRESS)
    ).withColumn("audit_status", F.when(clean, fixed.SUCCESS).otherwise(fixed.PARTIAL_SUCCESS))


def failures(outcomes: DataFrame) -> DataFrame:
    """The failures of a run as rows of their own: (run_id, dr_id, target_environment, source_fqn, action, error)."""
    return outcomes.filter(~F.col("success")).select("run_id", "dr_id", "target_environment", "source_fqn", "action", "error")


def failed_objects(outcomes: DataFrame) -> DataFrame:
    """Names of failed objects as JSON, one row per request: (dr_id, error_message).

    It is one text, for one audit row; ``failures`` has the same names as rows.
    """
    names = F.array_sort(F.collect_list("source_fqn")).alias("failed_objects")
    return outcomes.filter(~F.col("success")).groupBy("dr_id").agg(F.to_json(F.struct(names)).alias("error_message"))


def run_counters(outcomes: DataFrame, actions: Sequence[str]) -> DataFrame:
    """Per request, how often each action went well, and how many outcomes failed or were skipped."""
    ok = F.col("success")
    return outcomes.groupBy("dr_id").agg(
        *[F.count_if(ok & (F.col("action") == a)).alias(f"{a}_ok") for a in actions],
        F.count_if(F.col("action") == "skip").alias("skipped"),
        F.count_if(~ok).alias("failed"),
    )
