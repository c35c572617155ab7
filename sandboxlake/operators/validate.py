"""Checks on whole batches of requests; every row gets the list of what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sandboxlake import fixed
from sandboxlake.functions.checks import is_request_id

_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.][0-9]{3}([0-9]{3})?)?)?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"


def iso_date(text: Column) -> Column:
    """A date written YYYY-MM-DD; NULL for any other text and for days that do not exist."""
    return F.when(text.rlike(_DATE), text.try_cast("date"))


def is_iso_timestamp(text: Column) -> Column:
    """ISO 8601 date or date with time, with or without a zone; the date and the clock must exist."""
    day = iso_date(F.substr(text, F.lit(1), F.lit(10))).isNotNull()
    hour = F.coalesce(F.substr(text, F.lit(12), F.lit(2)).try_cast("int"), F.lit(0)) < 24
    minute = F.coalesce(F.substr(text, F.lit(15), F.lit(2)).try_cast("int"), F.lit(0)) < 60
    second = F.coalesce(F.substr(text, F.lit(18), F.lit(2)).try_cast("int"), F.lit(0)) < 60
    return F.coalesce(text.rlike(_TIME) & day & hour & minute & second, F.lit(False))


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def _none(names: Column) -> Column:
    return F.coalesce(F.size(names), F.lit(0)) <= 0


def _any(names: Column, test) -> Column:
    return F.coalesce(F.exists(names, test), F.lit(False))


def _three_parts(name: Column) -> Column:
    parts = F.split(name, r"\.")
    return F.coalesce((F.size(parts) == 3) & ~F.exists(parts, _blank), F.lit(False))


def request_errors(today: str, max_days: int = fixed.MAX_DURATION_DAYS) -> Column:
    """Error codes of a flat request row (see ``flat_requests``); an empty array when it is fine."""
    day = F.lit(today).cast("date")
    expires = iso_date(F.col("expiration_date"))
    mode = F.col("rev_mode")
    rules = [
        (~F.col("version").eqNullSafe(F.lit(fixed.DOCUMENT_VERSION)), "version: must be 1.0"),
        (~is_request_id(F.col("dr_id")), "dr_id: not a request id"),
        (_none(F.col("streams")), "streams: at least one is needed"),
        (_any(F.col("streams"), lambda s: F.coalesce(s, F.lit("")) == ""), "streams: a name is empty"),
        (_any(F.col("additional_objects"), lambda o: ~_three_parts(o)), "additional_objects: not a three-part name"),
        (~F.col("dev_enabled").eqNullSafe(F.lit(True)), "environments.dev: cannot be off"),
        (~F.coalesce(mode.isin("latest", "version", "timestamp"), F.lit(False)), "data_revision.mode: unknown"),
        ((mode == "version") & F.col("rev_version").isNull(), "data_revision.version: missing"),
        (F.col("rev_version") < 0, "data_revision.version: negative"),
        ((mode == "timestamp") & F.col("rev_timestamp").isNull(), "data_revision.timestamp: missing"),
        (F.col("rev_timestamp").isNotNull() & ~is_iso_timestamp(F.col("rev_timestamp")), "data_revision.timestamp: not ISO 8601"),
        (_none(F.col("developers")), "access.developers: at least one is needed"),
        (_any(F.col("developers"), _blank), "access.developers: a name is blank"),
        (F.col("qa_enabled") & _none(F.col("qa_users")), "access.qa_users: needed when qa is on"),
        (expires.isNull(), "lifecycle.expiration_date: not a date"),
        (expires <= day, "lifecycle.expiration_date: not in the future"),
        (F.date_diff(expires, day) > max_days, "lifecycle.expiration_date: too far ahead"),
        (F.col("notification_days_before") < 0, "lifecycle.notification_days_before: negative"),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for broken, code in rules]))


def validate_requests(requests: DataFrame, today: str, max_days: int = fixed.MAX_DURATION_DAYS) -> DataFrame:
    """Add ``errors`` and ``config_status`` (valid or invalid)."""
    checked = requests.withColumn("errors", request_errors(today, max_days))
    return checked.withColumn(
        "config_status",
        F.when(F.size("errors") == 0, fixed.CONFIG_VALID).otherwise(fixed.CONFIG_INVALID),
    )
