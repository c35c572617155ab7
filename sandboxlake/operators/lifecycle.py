"""Questions about requests over their life: open, expired, to be noticed, status cards, audit history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sandboxlake import fixed
from sandboxlake.functions.checks import is_principal
from sandboxlake.functions.parsing import with_parsed
from sandboxlake.operators.topn import ranked_rows


def open_requests(requests: DataFrame) -> DataFrame:
    """Requests that count in collision checks and listings."""
    return requests.filter(F.col("status").isin(*fixed.OPEN_STATUSES))


def expired_requests(
    requests: DataFrame, today: str, expiring: Sequence[str] = (fixed.ACTIVE,)
) -> DataFrame:
    """Requests to clean up: past their date while active, or left in the middle of a cleanup."""
    due = (F.col("expiration_date") <= F.lit(today).cast("date")) & F.col("status").isin(*expiring)
    return requests.filter(due | (F.col("status") == fixed.CLEANUP_IN_PROGRESS))


def requests_to_notify(
    requests: DataFrame, today: str, days: int | Column = fixed.NOTICE_DAYS
) -> DataFrame:
    """Active requests inside the notice window that were not noticed yet.  ``days`` may be a column."""
    lead = F.lit(days) if isinstance(days, int) else days
    return requests.filter(
        (F.date_sub("expiration_date", lead) <= F.lit(today).cast("date"))
        & F.col("notification_sent_at").isNull()
        & (F.col("status") == fixed.ACTIVE)
    )


def visible_to(requests: DataFrame, user: str, is_admin: bool) -> DataFrame:
    """What one user may list: an admin everything, others what they created."""
    return requests if is_admin else requests.filter(F.col("created_by") == user)


def visible_requests(requests: DataFrame, viewers: DataFrame) -> DataFrame:
    """What all viewers may list, as (viewer, scope, dr_id).

    An admin has one row of scope ``all``, which stands for every request; others have a row of scope ``own`` for each
    request they created.  ``viewers`` is (viewer, is_admin); who is listed as both is an admin.
    """
    listed = viewers.groupBy("viewer").agg(F.bool_or(F.coalesce("is_admin", F.lit(False))).alias("_admin"))
    admins = listed.filter("_admin").select("viewer", F.lit("all").alias("scope"), F.lit(None).cast(requests.schema["dr_id"].dataType).alias("dr_id"))
    owners = listed.filter("NOT _admin").select("viewer")
    own = requests.join(owners, requests.created_by == owners.viewer).select("viewer", F.lit("own").alias("scope"), "dr_id")
    return own.unionByName(admins)


def may_list(requests: DataFrame, visible: DataFrame, viewer: str) -> DataFrame:
    """The requests that a viewer's rows of ``visible_requests`` stand for."""
    mine = visible.filter(F.col("viewer") == viewer)
    own = mine.filter("scope = 'own'").select(F.col("dr_id").alias("_own")).distinct()
    everything = mine.filter("scope = 'all'").select(F.lit(True).alias("_all")).limit(1)
    flagged = requests.join(own, requests.dr_id == F.col("_own"), "left").join(F.broadcast(everything), F.lit(True), "left")
    return flagged.filter(F.col("_own").isNotNull() | F.coalesce("_all", F.lit(False))).select(*requests.columns)


def refresh_targets(objects: DataFrame, mode: str, selected: DataFrame | None = None) -> DataFrame:
    """Objects a refresh has to copy again.

    ``selected`` is (source_fqn) or (dr_id, source_fqn); a selective refresh without one does nothing.
    """
    kept = objects.filter(F.col("status").isNotNull() & (F.col("status") != fixed.DROPPED))
    if mode == "full":
        return kept
    if mode == "incremental":
        return kept.filter(F.col("clone_strategy").isin(*fixed.COPYING_STRATEGIES))
    if mode == "selective":
        if selected is None:
            return kept.limit(0)
        keys = [c for c in ("dr_id", "source_fqn") if c in selected.columns]
        return kept.join(selected.select(*keys).distinct(), keys, "left_semi")
    raise ValueError(f"unknown refresh mode {mode!r}")


def with_eligibility(requests: DataFrame, today: str) -> DataFrame:
    """Add ``reason``: why a request may not be refreshed or modified; NULL when it may."""
    return requests.withColumn(
        "reason",
        F.when(~F.coalesce(F.col("status").isin(*fixed.LIVE_STATUSES), F.lit(False)), "not_active")
        .when(F.col("expiration_date") < F.lit(today).cast("date"), "expired"),
    )


def modifiable_requests(requests: DataFrame) -> DataFrame:
    """Requests that may be modified; an expired one may still be extended."""
    return requests.filter(F.col("status").isin(*fixed.LIVE_STATUSES))


def collisions(requests: DataFrame, manifests: DataFrame, force: bool = False) -> DataFrame:
    """Manifests that must not be provisioned as they are: the request is live and a review is due."""
    if force:
        return manifests.limit(0)
    live = requests.filter(F.col("status").isin(*fixed.LIVE_STATUSES)).select("dr_id")
    return manifests.filter("review_required").join(live, "dr_id", "left_semi")


def object_counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("dr_id").agg(F.count(F.lit(1)).alias("total_objects"))


def with_object_counts(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """Requests with the number of their objects, 0 when there are none."""
    return requests.join(object_counts(objects), "dr_id", "left").withColumn(
        "total_objects", F.coalesce("total_objects", F.lit(0).cast("bigint"))
    )


def status_breakdown(objects: DataFrame) -> DataFrame:
    """Objects per request and status; a missing status counts as UNKNOWN."""
    return (
        objects.groupBy("dr_id", F.coalesce("status", F.lit("UNKNOWN")).alias("object_status"))
        .agg(F.count(F.lit(1)).alias("objects"))
    )


def status_counts(objects: DataFrame) -> DataFrame:
    """The same as one map per request; the keys are the four object statuses and UNKNOWN."""
    return (
        status_breakdown(objects).groupBy("dr_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("object_status", "objects")))).alias("object_breakdown"))
    )


def recent_audit(audit: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` audit rows of every request, ranked; ties go by log id."""
    return ranked_rows(audit, ["dr_id"], [F.col("performed_at").desc(), F.col("log_id")], n)


def audit_of_request(audit: DataFrame, dr_id: str, n: int) -> DataFrame:
    return audit.filter(F.col("dr_id") == dr_id).orderBy(F.col("performed_at").desc(), "log_id").limit(n)


def audit_by_action(audit: DataFrame, action: str) -> DataFrame:
    """All audit rows of one action, newest first."""
    return audit.filter(F.col("action") == action).orderBy(F.col("performed_at").desc(), "log_id")


def audit_stays(now: str, days: int = fixed.AUDIT_RETENTION_DAYS) -> Column:
    """Whether an audit row survives a purge; one without a time does."""
    oldest = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    return F.coalesce(F.col("performed_at") >= oldest, F.lit(True))


def audit_kept(audit: DataFrame, now: str, days: int = fixed.AUDIT_RETENTION_DAYS) -> DataFrame:
    """Audit rows that survive a purge."""
    return audit.filter(audit_stays(now, days))


def configs_newest_first(configs: DataFrame) -> DataFrame:
    return configs.orderBy(F.col("created_at").desc(), "dr_id")


def request_status(
    requests: DataFrame, objects: DataFrame, audit: DataFrame, audits: int = fixed.STATUS_CARD_AUDITS
) -> DataFrame:
    """Status cards: request columns, object counts per status, and the newest audit rows as text.

    Both sides are one row per request before they meet the requests; the audit text has at most
    ``audits`` entries.
    """
    def of(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    known = (fixed.PROVISIONED, fixed.REFRESH_PENDING, fixed.FAILED, fixed.DROPPED)
    counts = objects.groupBy("dr_id").agg(
        F.count(F.lit(1)).alias("total_objects"),
        *[of(s).alias(s.lower()) for s in known],
        F.count_if(F.col("status").isNull()).alias("unknown"),
    )
    line = F.concat_ws(" ", "action", "status", F.col("performed_at").cast("string"))
    recent = (
        recent_audit(audit, audits).select("dr_id", "rank", line.alias("line"))
        .groupBy("dr_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda e: e["line"]), "; ").alias("recent_audit"))
    )
    zero = F.lit(0).cast("bigint")
    numbers = ["total_objects", *[s.lower() for s in known], "unknown"]
    return requests.join(counts, "dr_id", "left").join(recent, "dr_id", "left").select(
        *requests.columns,
        *[F.coalesce(n, zero).alias(n) for n in numbers],
        F.coalesce("recent_audit", F.lit("")).alias("recent_audit"),
    )


def recipients(requests: DataFrame, config: str = "config_json") -> DataFrame:
    """Who gets the notice: listed recipients, else developers, else the creator; unsafe names are dropped.

    A list that is there but holds only unsafe names stays empty.
    """
    lists = "struct<lifecycle: struct<notification_recipients: array<string>>, access: struct<developers: array<string>>>"
    doc = f"development_request {lists}, lifecycle struct<notification_recipients: array<string>>, access struct<developers: array<string>>"

    def field(path: str) -> Column:
        wrapped = F.col("_p.doc.development_request").isNotNull()
        return F.when(wrapped, F.col(f"_p.doc.development_request.{path}")).otherwise(F.col(f"_p.doc.{path}"))

    def safe(names: Column) -> Column:
        return F.filter(names, is_principal)

    listed, developers = field("lifecycle.notification_recipients"), field("access.developers")
    return (
        with_parsed(requests, "_p", {"doc": (config, doc)})
        .withColumn(
            "recipients",
            F.when(F.size(listed) > 0, safe(listed))
            .when(F.size(developers) > 0, safe(developers))
            .otherwise(safe(F.array("created_by"))),
        )
        .drop("_p")
    )


def notice_facts(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """Requests with the recipients and the object count that a notice is about."""
    return recipients(with_object_counts(requests, objects))


def notices(requests: DataFrame, objects: DataFrame, today: str, days: int = fixed.NOTICE_DAYS) -> DataFrame:
    """Notice texts for all requests in the notice window, with recipients and object counts."""
    due = notice_facts(requests_to_notify(requests, today, days), objects)
    until = F.col("expiration_date").cast("string")
    body = F.concat(
        F.lit("Request "), "dr_id", F.lit(" expires soon.\n\n  Description: "), F.coalesce("description", F.lit("")),
        F.lit("\n  Expires on: "), until, F.lit("\n  Objects: "), F.col("total_objects").cast("string"),
        F.lit("\n\nSet a later expiration date to keep it; otherwise its objects, schemas and grants are removed.\n"),
    )
    return due.select(
        "dr_id", F.coalesce("description", F.lit("")).alias("description"), "expiration_date", "total_objects", "recipients",
        F.concat(F.lit("Request "), "dr_id", F.lit(" expires on "), until).alias("subject"), body.alias("body"),
    )
