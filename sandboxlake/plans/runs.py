"""Runs over many requests at once: provision, refresh, modify, clean up, notify.

A run plans with joins over the state tables, carries out the catalog tasks, and appends what
became of them.  One failing object never stops the others; it ends up as an outcome row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sandboxlake import fixed, schemas
from sandboxlake.functions.checks import is_principal
from sandboxlake.operators import lifecycle, outcomes as results
from sandboxlake.operators.principals import grantable, unknown_principals
from sandboxlake.operators.updates import compare_and_set, set_columns
from sandboxlake.plans import copy_plan as plans
from sandboxlake.plans.clone import (
    Sandbox, clone_all, create_schemas, drop_object, drop_schema, refresh_all, run_tasks,
)
from sandboxlake.plans.scan import stream_additions
from sandboxlake.session import settle
from sandboxlake.sources.commits import retention_violations
from sandboxlake.sources.state import StateTables

OBJECT_KEY = ["dr_id", "source_fqn", "target_environment"]


@dataclass
class Run:
    """What a run leaves behind: a status row per request, outcome rows, and plans for others to carry out."""

    status: DataFrame
    outcomes: DataFrame
    grants: DataFrame | None = None
    revokes: DataFrame | None = None
    warnings: DataFrame | None = None
    rejected: DataFrame | None = None
    unknown: DataFrame | None = None


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def _audit(
    rows: DataFrame, action: str, now: str, detail: Column, status: Column | str = fixed.SUCCESS,
    error: Column | None = None, by: str = "SYSTEM",
) -> DataFrame:
    return rows.select(
        F.lit(None).cast("string").alias("log_id"), "dr_id", F.lit(action).alias("action"),
        F.to_json(detail).alias("action_detail"), F.lit(by).alias("performed_by"), _at(now).alias("performed_at"),
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
        (error if error is not None else F.lit(None).cast("string")).alias("error_message"),
    )


def _with_failures(status: DataFrame, done: DataFrame) -> DataFrame:
    """Status rows, one per request, with the JSON list of its failed objects; the outcome rows say the same by run."""
    return status.join(results.failed_objects(done), "dr_id", "left")


def _stamp_requests(state: StateTables, ids: DataFrame, values: dict[str, Column], now: str) -> None:
    changed = set_columns(state.current("requests"), ids.select("dr_id").distinct(), ["dr_id"], values, only_changed=True)
    state.append("requests", changed, now)


def _move_requests(
    state: StateTables, changes: DataFrame, now: str
) -> None:
    """Compare-and-set of request statuses; ``changes`` is (dr_id, current_status, new_status)."""
    batch = changes.withColumn("seq", F.lit(0)).withColumn("at", _at(now))
    moved = compare_and_set(
        state.current("requests"), batch, ["dr_id"], fixed.REQUEST_MOVES, {"last_modified_at": "at"}, only_changed=True
    )
    state.append("requests", moved, now)


def _copied(objects: DataFrame, done: DataFrame, now: str) -> DataFrame:
    """Object rows after a copy: provisioned and stamped when it went well, failed otherwise."""
    changes = done.select(*OBJECT_KEY, F.when(F.col("success"), fixed.PROVISIONED).otherwise(fixed.FAILED).alias("status"))
    fine = F.col("new_status") == fixed.PROVISIONED
    return set_columns(
        objects, changes, OBJECT_KEY,
        {
            "status": F.col("new_status"),
            "provisioned_at": F.coalesce("provisioned_at", F.when(fine, _at(now))),
            "last_refreshed_at": F.when(fine, _at(now)).otherwise(F.col("last_refreshed_at")),
        },
        only_changed=True,
    )


def _over_stored(plan: DataFrame, owned: DataFrame) -> DataFrame:
    """Plan rows with what their stored rows know: when they were provisioned, and whether the target is there to be replaced."""
    before = owned.select(
        *OBJECT_KEY, F.col("provisioned_at").alias("_provisioned"), F.col("last_refreshed_at").alias("_refreshed"),
        F.col("target_fqn").alias("_target"), (F.col("status") != fixed.DROPPED).alias("_there"),
    )
    joined = plan.join(before, OBJECT_KEY, "left")
    kept = F.coalesce(F.col("_there") & (F.col("_target") == F.col("target_fqn")), F.lit(False))
    stamps = {"provisioned_at": F.when(kept, F.col("_provisioned")), "last_refreshed_at": F.when(kept, F.col("_refreshed"))}
    return joined.select(*[stamps.get(c, F.col(c)).alias(c) for c in plan.columns], kept.alias("replaces"))


def provision(
    sandbox: Sandbox,
    state: StateTables,
    requests: DataFrame,
    objects: DataFrame,
    headers: DataFrame,
    now: str,
    *,
    force: bool = False,
    known: DataFrame | None = None,
    commits: DataFrame | None = None,
) -> Run:
    """Provision all requests from their manifests.

    ``requests`` is one flat row per request, ``objects`` and ``headers`` are manifest rows (see
    ``copy_plan`` and ``manifest_headers``).  A live request with a review due is rejected unless
    ``force`` is given.  ``known`` (principal) limits the grants, ``commits`` (fqn, version, ts)
    lets revisions older than the history be reported.

    A request that was provisioned before keeps its history, and targets that its object rows name are replaced: the
    new copy is made beside the old one, which stays if that fails.  Object rows are stored before anything is copied,
    so a run that broke off is taken up by provisioning again.
    """
    stored = settle(state.current("requests"))
    rejected = lifecycle.collisions(stored, headers, force).select("dr_id")
    go = settle(requests.join(rejected, "dr_id", "left_anti"))
    owned = settle(state.of_requests("objects", go))
    plan = settle(_over_stored(plans.copy_plan(objects, go), owned))

    history = ("created_at", "created_by", "last_refreshed_at", "notification_sent_at")
    before = stored.select("dr_id", *[F.col(c).alias(f"_{c}") for c in history], F.col("expiration_date").alias("_until"))
    created_by = F.coalesce(F.get("developers", F.lit(0)), F.lit("SYSTEM"))
    same_end = F.col("_until").eqNullSafe(F.col("expiration_date"))
    state.append(
        "requests",
        go.join(before, "dr_id", "left").select(
            "dr_id", "description", "config_json", F.lit(fixed.PROVISIONING).alias("status"), F.coalesce("_created_at", _at(now)).alias("created_at"),
            F.coalesce("_created_by", created_by).alias("created_by"), "expiration_date", F.col("_last_refreshed_at").alias("last_refreshed_at"),
            _at(now).alias("last_modified_at"), F.when(same_end, F.col("_notification_sent_at")).alias("notification_sent_at"),
        ),
        now,
    )
    state.append_audit(_audit(go, "PROVISION", now, F.struct(F.lit("start").alias("phase"))))
    warnings = None
    if commits is not None:
        wanted = plan.select(
            "dr_id", F.col("source_fqn").alias("fqn"), F.col("clone_revision_mode").alias("rev_mode"),
            F.when(F.col("clone_revision_mode") == "version", F.col("clone_revision_value").try_cast("bigint")).alias("rev_version"),
            F.when(F.col("clone_revision_mode") == "timestamp", F.col("clone_revision_value").try_cast("timestamp").cast("timestamp_ntz")).alias("rev_ts"),
        ).distinct()
        warnings = retention_violations(wanted, commits)

    targets = settle(plans.target_schemas(objects, go))
    made = create_schemas(sandbox, targets)
    if force:
        stale = owned.join(plan.select(*OBJECT_KEY), OBJECT_KEY, "left_anti")
        state.append("objects", stale, now, "delete")
    state.append("objects", plan, now)
    done = clone_all(sandbox, plan)
    state.append("objects", _copied(plan.drop("replaces"), done, now), now)

    grants = plans.grant_plan(targets, go)
    unknown = None
    if known is not None:
        unknown = unknown_principals(grants, known)
        grants = grantable(grants, known)
    access = plans.access_rows(go, _at(now))
    if force:
        key = schemas.STATE_KEYS["access"]
        gone = state.of_requests("access", go).join(access.select(*key), key, "left_anti")
        state.append("access", gone, now, "delete")
    state.append("access", access, now)

    status = settle(results.run_status(go, done))
    _move_requests(
        state,
        status.select("dr_id", F.lit(fixed.PROVISIONING).alias("current_status"), F.col("final_status").alias("new_status")),
        now,
    )
    schema_counts = made.groupBy("dr_id").agg(F.count_if("success").alias("schemas_created"))
    grant_counts = grants.groupBy("dr_id").agg(F.count(F.lit(1)).alias("grants"))
    finished = status.join(schema_counts, "dr_id", "left").join(grant_counts, "dr_id", "left")
    detail = F.struct(
        F.lit("complete").alias("phase"), F.col("succeeded").alias("objects_succeeded"), F.col("failed").alias("objects_failed"),
        F.coalesce("schemas_created", F.lit(0)).alias("schemas_created"), F.coalesce("grants", F.lit(0)).alias("grants_applied"),
    )
    state.append_audit(
        _audit(_with_failures(finished, done), "PROVISION", now, detail, F.col("audit_status"), F.col("error_message"))
    )
    return Run(status, made.unionByName(done), grants=grants, warnings=warnings, rejected=rejected, unknown=unknown)


def refresh(
    sandbox: Sandbox,
    state: StateTables,
    wanted: DataFrame,
    mode: str,
    now: str,
    *,
    selected: DataFrame | None = None,
    revision: tuple[str, str | None] | None = None,
    commits: DataFrame | None = None,
) -> Run:
    """Copy the objects of the wanted requests (dr_id) again.

    Requests that are not live, or expired, come back as rejected with a reason.  The result of an
    object is stamped whatever status it had.  A full refresh makes the new copy beside the old one; where that fails, the
    old one stays and its row says FAILED.  Another refresh that fails leaves the row as it was.
    """
    checked = lifecycle.with_eligibility(state.of_requests("requests", wanted), now[:10])
    rejected = checked.filter(F.col("reason").isNotNull()).select("dr_id", "reason")
    go = settle(checked.filter(F.col("reason").isNull()).select("dr_id"))
    stored = settle(lifecycle.refresh_targets(state.of_requests("objects", go), mode, selected))
    rev_mode, rev_value = revision or ("latest", None)
    targets = stored.withColumn("clone_revision_mode", F.lit(rev_mode)).withColumn(
        "clone_revision_value", F.lit(rev_value).cast("string")
    )
    warnings = None
    if commits is not None and rev_mode != "latest":
        asked = targets.select(
            "dr_id", F.col("source_fqn").alias("fqn"), F.lit(rev_mode).alias("rev_mode"),
            F.lit(rev_value if rev_mode == "version" else None).cast("bigint").alias("rev_version"),
            F.lit(rev_value if rev_mode == "timestamp" else None).cast("timestamp").cast("timestamp_ntz").alias("rev_ts"),
        ).distinct()
        warnings = retention_violations(asked, commits)

    done = refresh_all(sandbox, targets, mode == "full")
    # a good one is provisioned and stamped and keeps its own revision
    state.append("objects", _copied(stored, done if mode == "full" else done.filter("success"), now), now)
    _stamp_requests(state, done, {"last_refreshed_at": _at(now)}, now)
    status = settle(results.run_status(go, done))
    detail = F.struct(
        F.lit(mode).alias("mode"), F.col("succeeded").alias("objects_refreshed"), F.col("failed").alias("objects_failed")
    )
    state.append_audit(
        _audit(_with_failures(status, done), "REFRESH", now, detail, F.col("audit_status"), F.col("error_message"))
    )
    return Run(status, done, warnings=warnings, rejected=rejected)


def _modifiable(state: StateTables, changes: DataFrame) -> DataFrame:
    live = lifecycle.modifiable_requests(state.current("requests")).select("dr_id")
    return changes.join(live, "dr_id", "left_semi")


def add_objects(
    sandbox: Sandbox, state: StateTables, additions: DataFrame, now: str, revision: tuple[str, str | None] | None = None
) -> DataFrame:
    """Copy further objects (dr_id, fqn, object_type, access_mode, clone_strategy, estimated_size_gb) to dev.

    Only those that went well get a row, as PROVISIONED.  Returns the outcomes.
    """
    rev_mode, rev_value = revision or ("latest", None)
    settings = additions.select("dr_id").distinct().select(
        "dr_id", F.lit(False).alias("qa_enabled"), F.lit(None).cast("string").alias("target_catalog"),
        F.lit(rev_mode).alias("rev_mode"),
        F.lit(rev_value if rev_mode == "version" else None).cast("bigint").alias("rev_version"),
        F.lit(rev_value if rev_mode == "timestamp" else None).cast("string").alias("rev_timestamp"),
    )
    plan = settle(plans.copy_plan(additions, settings))
    misnamed = additions.join(
        plan.select("dr_id", F.col("source_fqn").alias("fqn")), ["dr_id", "fqn"], "left_anti"
    ).select(
        F.lit(sandbox.run_id).alias("run_id"), F.lit(-1).cast("bigint").alias("task_no"), "dr_id",
        F.lit("dev").alias("target_environment"), F.col("fqn").alias("source_fqn"), F.lit(None).cast("string").alias("target_fqn"),
        F.lit(None).cast("string").alias("strategy"), F.lit("clone").alias("action"), F.lit(False).alias("success"),
        F.lit("not a three-part name").alias("error"),
    )
    create_schemas(
        sandbox,
        plan.select("dr_id", "target_environment", F.substring_index("target_fqn", ".", 2).alias("schema_fqn")).distinct(),
    )
    done = clone_all(sandbox, plan)
    state.append("objects", _copied(plan, done.filter("success"), now), now)
    return done.unionByName(misnamed)


def remove_objects(sandbox: Sandbox, state: StateTables, removals: DataFrame, now: str) -> DataFrame:
    """Drop objects (dr_id, source_fqn) and mark them; already dropped ones are left alone."""
    objects = state.of_requests("objects", removals)
    doomed = settle(plans.removal_plan(objects, removals))
    done = run_tasks(sandbox, doomed, lambda row: drop_object(sandbox, row.target_fqn), "drop")
    _mark_dropped(state, done.filter("success"), now)
    return done


def _mark_dropped(state: StateTables, dropped: DataFrame, now: str) -> None:
    changed = set_columns(
        state.current("objects"), dropped.select(*OBJECT_KEY), OBJECT_KEY, {"status": F.lit(fixed.DROPPED)}, only_changed=True
    )
    state.append("objects", changed, now)


def change_users(state: StateTables, changes: DataFrame, now: str) -> DataFrame:
    """Statements for user changes (dr_id, environment, action, principal), and the access rows that follow.

    Unsafe names never become a statement or a row.
    """
    named = changes.filter(is_principal(F.col("principal")))
    schemas_ = settle(plans.env_schemas(state.of_requests("objects", changes)))  # for both kinds of changes, and the statements
    with_schema = schemas_.select("dr_id", F.col("target_environment").alias("environment")).distinct()
    rows = named.join(with_schema, ["dr_id", "environment"], "left_semi").select(
        "dr_id", F.col("principal").alias("user_email"), "environment",
        F.lit(fixed.READ_WRITE).alias("access_level"), _at(now).alias("granted_at"), "action",
    )
    statements = plans.user_grant_plan(schemas_, named)
    state.append("access", rows.filter("action = 'grant'").drop("action").distinct(), now)
    state.append("access", rows.filter("action = 'revoke'").drop("action").distinct(), now, "delete")
    return statements


def modify(
    sandbox: Sandbox,
    state: StateTables,
    now: str,
    *,
    additions: DataFrame | None = None,
    removals: DataFrame | None = None,
    users: DataFrame | None = None,
    expirations: DataFrame | None = None,
    streams: DataFrame | None = None,
    lineage: DataFrame | None = None,
    inventory: DataFrame | None = None,
    revision: tuple[str, str | None] | None = None,
    by: str = "SYSTEM",
) -> Run:
    """Modify live requests: add objects, remove objects, change users, extend, add streams.

    Each kind of change is one action per request, and they succeed or fail on their own; the status
    row says whether all, some or none did.  ``expirations`` is (dr_id, expiration_date); ``streams``
    is (dr_id, name) and needs ``lineage`` and ``inventory``.
    """
    actions, statements, done = [], None, []

    def action(rows: DataFrame, name: str, ok: Column) -> None:
        actions.append(rows.groupBy("dr_id").agg(ok.alias("success")).select("dr_id", F.lit(name).alias("action"), "success"))

    if additions is not None:
        done.append(add_objects(sandbox, state, settle(_modifiable(state, additions)), now, revision))
        action(done[-1], "add_objects", F.bool_or("success"))
    if removals is not None:
        asked = settle(_modifiable(state, removals))
        done.append(remove_objects(sandbox, state, asked, now))
        tried = asked.select("dr_id").distinct().join(done[-1].select("dr_id", "success"), "dr_id", "left")
        action(tried, "remove_objects", F.coalesce(F.bool_or("success"), F.lit(True)))
    if users is not None:
        asked = settle(_modifiable(state, users))
        statements = settle(change_users(state, asked, now))
        for name, kind in (("add_users", "grant"), ("remove_users", "revoke")):
            action(asked.filter(F.col("action") == kind), name, F.bool_and(is_principal(F.col("principal"))))
    if expirations is not None:
        asked = settle(_modifiable(state, expirations))
        due = F.col("expiration_date") >= F.lit(now[:10]).cast("date")
        changed = set_columns(
            state.current("requests"), asked.filter(due), ["dr_id"],
            {"expiration_date": F.col("new_expiration_date"), "last_modified_at": _at(now)}, only_changed=True,
        )
        state.append("requests", changed, now)
        action(asked, "change_expiration", F.bool_and(F.coalesce(due, F.lit(False))))
    if streams is not None:
        asked = settle(_modifiable(state, streams))
        more, found = stream_additions(lineage, asked, inventory, state.of_requests("objects", asked))
        none = F.lit(None)
        fresh = settle(more.withColumn("clone_strategy", none.cast("string")).withColumn("estimated_size_gb", none.cast("double")))
        done.append(add_objects(sandbox, state, fresh, now, revision))
        copied = done[-1].groupBy("dr_id").agg(F.bool_or("success").alias("copied"))
        tried = found.join(copied, "dr_id", "left")  # nothing new to copy is fine
        action(tried, "add_streams", F.bool_and(F.col("resolved") & F.coalesce("copied", F.lit(True))))
    if not actions:
        raise ValueError("nothing to modify")

    together = actions[0]
    for more in actions[1:]:
        together = together.unionByName(more)
    together = settle(together)
    touched = together.select("dr_id").distinct()
    _stamp_requests(state, touched, {"last_modified_at": _at(now)}, now)
    status = settle(results.run_status(touched, together))
    # At most six actions per request, so the list in its audit row is short.
    lists = together.groupBy("dr_id").agg(
        F.array_sort(F.collect_list(F.struct("action", "success"))).alias("actions"),
        F.array_sort(F.collect_list(F.when(~F.col("success"), F.col("action")))).alias("_bad"),
    )
    detailed = status.join(lists, "dr_id")
    state.append_audit(
        _audit(
            detailed, "MODIFY", now, F.struct("actions"), F.col("audit_status"),
            F.when(F.size("_bad") > 0, F.to_json(F.struct(F.col("_bad").alias("failed_actions")))), by,
        )
    )
    outcomes = done[0] if done else sandbox.spark.createDataFrame([], schemas.OUTCOMES)
    for more in done[1:]:
        outcomes = outcomes.unionByName(more)
    adds = statements.filter("action = 'grant'") if statements is not None else None
    gone = statements.filter("action = 'revoke'") if statements is not None else None
    return Run(status, outcomes, grants=adds, revokes=gone)


def clean_up(sandbox: Sandbox, state: StateTables, doomed: DataFrame, now: str) -> Run:
    """Take down requests (dr_id): revokes, views, tables, schemas, final status.

    Which requests are due is ``expired_requests``.  A request whose status does not allow a
    cleanup is rejected; one with any failure stays in cleanup and is picked up again.
    """
    stored = state.of_requests("requests", doomed)
    start = stored.select(
        "dr_id", F.col("status").alias("current_status"), F.lit(fixed.CLEANUP_IN_PROGRESS).alias("new_status")
    )
    allowed = [cur for cur, new in fixed.REQUEST_MOVES if new == fixed.CLEANUP_IN_PROGRESS]
    go = settle(stored.filter(F.col("status").isin(*allowed)).select("dr_id"))
    rejected = stored.filter(~F.col("status").isin(*allowed)).select("dr_id", F.col("status").alias("reason"))
    _move_requests(state, settle(start), now)
    state.append_audit(_audit(go, "CLEANUP", now, F.struct(F.lit("start").alias("phase"))))

    objects = settle(state.of_requests("objects", go))
    revokes = plans.revoke_plan(objects, state.of_requests("access", go))
    plan = plans.drop_plan(objects)
    done = settle(_skipped(sandbox, plan))
    for rank in (0, 1):  # views first
        rows = plan.filter((F.col("action") == "drop") & (F.col("drop_rank") == rank)).drop("action")
        done = done.unionByName(run_tasks(sandbox, rows, lambda row: drop_object(sandbox, row.target_fqn), "drop"))
    schemas_ = objects.select("dr_id", F.substring_index("target_fqn", ".", 2).alias("target_fqn")).distinct()
    done = done.unionByName(run_tasks(sandbox, schemas_, lambda row: drop_schema(sandbox, row.target_fqn), "drop_schema"))

    _mark_dropped(state, done.filter("success AND action = 'drop'"), now)
    status = settle(results.cleanup_status(go, done))
    _move_requests(
        state,
        status.select("dr_id", F.lit(fixed.CLEANUP_IN_PROGRESS).alias("current_status"), F.col("final_status").alias("new_status")),
        now,
    )
    counters = results.run_counters(done, ["drop", "drop_schema"])
    revoked = revokes.groupBy("dr_id").agg(F.count(F.lit(1)).alias("revokes"))
    detailed = _with_failures(
        status.join(counters.drop("failed"), "dr_id", "left").join(revoked, "dr_id", "left"), done
    )
    zero = F.lit(0).cast("bigint")
    detail = F.struct(
        F.lit("complete").alias("phase"), F.coalesce("drop_ok", zero).alias("objects_dropped"),
        F.coalesce("skipped", zero).alias("objects_skipped"), F.coalesce("revokes", zero).alias("revokes_planned"),
        F.coalesce("drop_schema_ok", zero).alias("schemas_dropped"),
    )
    state.append_audit(_audit(detailed, "CLEANUP", now, detail, F.col("audit_status"), F.col("error_message")))
    return Run(status, done, revokes=revokes, rejected=rejected)


def _skipped(sandbox: Sandbox, plan: DataFrame) -> DataFrame:
    """Outcome rows of what a drop plan leaves alone; there is no task to carry out."""
    known = {
        "run_id": F.lit(sandbox.run_id), "task_no": F.lit(None), "strategy": F.col("clone_strategy"), "action": F.lit("skip"),
        "success": F.lit(True), "error": F.lit(None),
    }
    return plan.filter("action = 'skip'").select(
        *[known.get(c, F.col(c)).cast(kind).alias(c) for c, kind in schemas.fields(schemas.OUTCOMES)]
    )


def clean_up_expired(sandbox: Sandbox, state: StateTables, now: str) -> Run:
    """The daily cleanup: every request that is due, and those left over from an earlier one."""
    return clean_up(sandbox, state, lifecycle.expired_requests(state.current("requests"), now[:10]).select("dr_id"), now)


LEASE_MINUTES = 60


def notify(state: StateTables, now: str, days: int = fixed.NOTICE_DAYS, lease_minutes: int = LEASE_MINUTES) -> DataFrame:
    """Notices that are due, leased to the caller, who sends them and reports back with ``confirm_notices``.

    Nothing is stamped yet.  A notice that is not confirmed comes due again when its lease has run out, one that
    failed at once.
    """
    outbox = state.current("notices").select("dr_id", F.col("attempts").alias("_attempts"), F.col("leased_until").alias("_leased"))
    free = F.col("_leased").isNull() | (F.col("_leased") <= _at(now))
    in_time = lifecycle.requests_to_notify(state.current("requests"), now[:10], days)
    # objects are looked up for the requests that are due only
    asked = settle(in_time.join(outbox, "dr_id", "left").filter(free).drop("_leased"))
    texts = lifecycle.notices(asked.drop("_attempts"), state.of_requests("objects", asked), now[:10], days)
    due = settle(texts.join(asked.select("dr_id", "_attempts"), "dr_id"))
    until = _at(now) + F.expr(f"INTERVAL {int(lease_minutes)} MINUTES")
    state.append(
        "notices",
        due.select(
            "dr_id", "expiration_date", F.lit("LEASED").alias("status"), (F.coalesce("_attempts", F.lit(0)) + 1).alias("attempts"),
            until.alias("leased_until"),
        ),
        now,
    )
    return due.drop("_attempts")


def confirm_notices(state: StateTables, sent: DataFrame, now: str) -> DataFrame:
    """Report on leased notices: ``sent`` is (dr_id, success, error), one row per request.

    Requests whose notice went out are stamped and audited; the others come due again.  A report on a notice that is not
    leased (any more) changes nothing.  Returns the outbox rows as they are now.
    """
    leased = state.current("notices").filter("status = 'LEASED'")
    reports = sent.select("dr_id", F.col("success").alias("_ok"), F.col("error").alias("_error"))
    told = settle(leased.join(reports, "dr_id"))
    fine = F.coalesce("_ok", F.lit(False))
    after = settle(told.select(
        "dr_id", "expiration_date", F.when(fine, "SENT").otherwise("FAILED").alias("status"), "attempts",
        F.lit(None).cast("timestamp_ntz").alias("leased_until"), F.when(fine, _at(now)).alias("sent_at"), F.when(~fine, F.col("_error")).alias("error"),
    ))
    went = settle(after.filter("status = 'SENT'"))
    # the stamp goes first: it alone keeps a notice from coming due again
    _stamp_requests(state, went, {"notification_sent_at": _at(now)}, now)
    state.append("notices", after, now)
    texts = lifecycle.notice_facts(state.of_requests("requests", went), state.of_requests("objects", went))
    detail = F.struct(
        "recipients", F.col("total_objects").alias("object_count"), F.col("expiration_date").cast("string").alias("expiration_date")
    )
    state.append_audit(_audit(texts, "NOTIFY", now, detail))
    return after
