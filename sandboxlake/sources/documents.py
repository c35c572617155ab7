"""Request documents, config forms and stored manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sandboxlake import schemas
from sandboxlake.functions.parsing import with_parsed


def read_request_documents(spark: SparkSession, path: str) -> DataFrame:
    """Request documents from JSON files, one per line; a broken line keeps its text as reject."""
    raw = spark.read.text(path).select(F.col("value").alias("document"))
    return parse_request_documents(raw)


def parse_request_documents(texts: DataFrame, column: str = "document") -> DataFrame:
    """Add ``doc`` (nested) and ``reject`` (the text, when it is not a request document)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = with_parsed(texts, "_p", {"doc": (column, schemas.REQUEST_DOCUMENT)}, options)
    broken = F.col("_p.doc._corrupt_record").isNotNull() | F.col("_p.doc.development_request").isNull()
    return parsed.select(*texts.columns, F.col("_p.doc").alias("doc"), F.when(broken, F.col(column)).alias("reject"))


def flat_requests(parsed: DataFrame) -> DataFrame:
    """One flat row per request document that parsed."""
    body = "doc.development_request"
    return parsed.filter(F.col("reject").isNull()).select(
        F.col("doc.version").alias("version"),
        F.col(f"{body}.dr_id").alias("dr_id"),
        F.col(f"{body}.description").alias("description"),
        F.col(f"{body}.streams.name").alias("streams"),
        F.col(f"{body}.additional_objects").alias("additional_objects"),
        F.col(f"{body}.environments.dev.enabled").alias("dev_enabled"),
        F.coalesce(F.col(f"{body}.environments.qa.enabled"), F.lit(False)).alias("qa_enabled"),
        F.col(f"{body}.data_revision.mode").alias("rev_mode"),
        F.col(f"{body}.data_revision.version").alias("rev_version"),
        F.col(f"{body}.data_revision.timestamp").alias("rev_timestamp"),
        F.col(f"{body}.access.developers").alias("developers"),
        F.col(f"{body}.access.qa_users").alias("qa_users"),
        F.col(f"{body}.lifecycle.expiration_date").alias("expiration_date"),
        F.coalesce(F.col(f"{body}.lifecycle.notification_days_before"), F.lit(7)).alias("notification_days_before"),
        F.col(f"{body}.lifecycle.notification_recipients").alias("notification_recipients"),
    )


def flat_forms(configs: DataFrame, column: str = "config_json", keep: Sequence[str] = ()) -> DataFrame:
    """One flat row per config form, in the shape of ``flat_requests``; a broken text has all fields NULL.

    Columns named in ``keep`` stay beside it.
    """
    form = "_p.form"
    return with_parsed(configs, "_p", {"form": (column, schemas.CONFIG_FORM)}).select(
        "dr_id",
        *keep,
        F.lit("1.0").alias("version"),
        F.col(f"{form}.description").alias("description"),
        F.col(f"{form}.streams").alias("streams"),
        F.col(f"{form}.additional_objects").alias("additional_objects"),
        F.col(f"{form}.target_catalog").alias("target_catalog"),
        F.lit(True).alias("dev_enabled"),
        F.coalesce(F.col(f"{form}.qa_enabled"), F.lit(False)).alias("qa_enabled"),
        F.coalesce(F.col(f"{form}.data_revision_mode"), F.lit("latest")).alias("rev_mode"),
        F.col(f"{form}.data_revision_version").alias("rev_version"),
        F.col(f"{form}.data_revision_timestamp").alias("rev_timestamp"),
        F.col(f"{form}.developers").alias("developers"),
        F.col(f"{form}.qa_users").alias("qa_users"),
        F.col(f"{form}.expiration_date").alias("expiration_date"),
        F.coalesce(F.col(f"{form}.notification_days_before"), F.lit(7)).alias("notification_days_before"),
        F.col(f"{form}.notification_recipients").alias("notification_recipients"),
    )


def manifest_objects(manifests: DataFrame, column: str = "manifest_json") -> DataFrame:
    """One row per object of the stored manifests that have an object list; others are left out."""
    parsed = with_parsed(manifests, "_p", {"m": (column, schemas.MANIFEST)})
    return parsed.select("dr_id", F.explode("_p.m.scan_result.objects").alias("o")).select("dr_id", "o.*")


def manifest_is_whole(column: str = "manifest_json"):
    """Whether a manifest text has ``scan_result.objects``, the one thing a stored manifest must have."""
    return F.get_json_object(column, "$.scan_result.objects").isNotNull()
