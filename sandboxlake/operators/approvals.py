"""Edits that wait for an approval, and what approving them does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sandboxlake import fixed, schemas
from sandboxlake.functions.parsing import with_parsed
from sandboxlake.operators.principals import names_added, names_removed
from sandboxlake.operators.updates import changed_rows, set_columns
from sandboxlake.session import settle

CHANGE = "struct<field:string,before:string,after:string>"


def _list_change(label: str, before: Column, after: Column) -> Column:
    none = F.array().cast("array<string>")
    b, a = F.array_sort(F.coalesce(before, none)), F.array_sort(F.coalesce(after, none))
    return F.when(b != a, F.struct(F.lit(label).alias("field"), F.to_json(b).alias("before"), F.to_json(a).alias("after")))


def _text_change(label: str, before: Column, after: Column) -> Column:
    b, a = F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))
    return F.when(
        ~b.eqNullSafe(a), F.struct(F.lit(label).alias("field"), before.alias("before"), after.alias("after"))
    )


def config_changes(old: str, new: str) -> Column:
    """Changed fields between two config forms (struct columns), as an array of field, before, after.

    Lists are compared sorted and an empty list equals none; an empty text equals none.
    """
    def both(field: str) -> tuple[Column, Column]:
        return F.col(f"{old}.{field}"), F.col(f"{new}.{field}")

    return F.array_compact(
        F.array(
            _list_change("access.developers", *both("developers")),
            _list_change("access.qa_users", *both("qa_users")),
            _list_change("additional_objects", *both("additional_objects")),
            _text_change("description", *both("description")),
            _text_change("lifecycle.expiration_date", *both("expiration_date")),
        )
    )


def has_sensitive_change(changes: Column) -> Column:
    return F.exists(changes, lambda c: c["field"].isin(*fixed.SENSITIVE_FIELDS))


def compare_configs(edits: DataFrame, old: str = "old_json", new: str = "new_json") -> DataFrame:
    """Add ``changes`` and ``sensitive`` to rows that hold two config texts."""
    form = schemas.CONFIG_FORM
    return (
        with_parsed(edits, "_form", {"old": (old, form), "new": (new, form)})
        .withColumn("changes", config_changes("_form.old", "_form.new"))
        .withColumn("sensitive", has_sensitive_change(F.col("changes")))
        .drop("_form")
    )


def change_rows(edits: DataFrame) -> DataFrame:
    """The same as rows: (dr_id, field, before, after), one per changed field."""
    # The outer form, because the plain one would work out all changes once more to skip empty lists.
    rows = compare_configs(edits).select("dr_id", F.inline_outer("changes"))
    return rows.filter(F.col("field").isNotNull())


def edits_to_stage(edits: DataFrame) -> DataFrame:
    """Edits that need an approval: a sensitive field of a provisioned config changed."""
    return compare_configs(edits).filter(
        F.col("sensitive") & (F.col("config_status") == fixed.CONFIG_PROVISIONED)
    )


def staged_audit_rows(edits: DataFrame, now: Column, edit_id: Column | None = None, log_id: Column | None = None) -> DataFrame:
    """Audit rows that stage the edits.  Without given ids, fresh random ones are used."""
    short = F.concat(F.lit("pe-"), F.substr(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(1), F.lit(12)))
    detail = F.struct(
        (edit_id if edit_id is not None else short).alias("pending_edit_id"),
        "changes",
        F.col("new_json").alias("proposed_config_json"),
        F.col("created_by").alias("original_created_by"),
    )
    return edits.select(
        (log_id if log_id is not None else F.uuid()).alias("log_id"),
        "dr_id",
        F.lit(fixed.EDIT_PENDING).alias("action"),
        F.to_json(detail).alias("action_detail"),
        F.col("requester").alias("performed_by"),
        now.alias("performed_at"),
        F.lit("PENDING").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )


def edit_key() -> Column:
    """Id of the staged edit an audit row is about."""
    return F.get_json_object("action_detail", "$.pending_edit_id")


def pending_edits(audit: DataFrame, key: Column | None = None) -> DataFrame:
    """Staged edits that were neither approved nor rejected, with ``pending_edit_id``."""
    key = edit_key() if key is None else key
    keyed = audit.withColumn("pending_edit_id", key)
    settled = (
        keyed.filter(F.col("action").isin(fixed.EDIT_APPROVED, fixed.EDIT_REJECTED))
        .select("pending_edit_id").distinct()
    )
    return (
        keyed.filter((F.col("action") == fixed.EDIT_PENDING) & F.col("pending_edit_id").isNotNull())
        .join(settled, "pending_edit_id", "left_anti")
    )


def find_pending(audit: DataFrame, pending_edit_id: str, key: Column | None = None) -> DataFrame:
    """One pending edit by id; the id filter comes before the anti join on both sides."""
    key = edit_key() if key is None else key
    return pending_edits(audit.filter(key == pending_edit_id), key)


def decision_rows(decided: DataFrame, now: Column, by: str) -> DataFrame:
    """Audit rows for decided edits: (dr_id, pending_edit_id, decision, changes, reason)."""
    approved = F.col("decision") == "approve"
    detail = F.when(approved, F.to_json(F.struct("pending_edit_id", "changes"))).otherwise(
        F.to_json(F.struct("pending_edit_id", F.coalesce("reason", F.lit("")).alias("reason")))
    )
    return decided.select(
        "dr_id",
        F.when(approved, fixed.EDIT_APPROVED).otherwise(fixed.EDIT_REJECTED).alias("action"),
        detail.alias("action_detail"),
        F.lit(by).alias("performed_by"),
        now.alias("performed_at"),
        F.when(approved, fixed.SUCCESS).otherwise("REJECTED").alias("status"),
    )


def pending_provisions(configs: DataFrame) -> DataFrame:
    """Scanned configs that wait to be provisioned, with the totals of their manifests.

    A manifest may or may not have the outer ``scan_result``; an unreadable one counts as empty.
    """
    scanned = configs.filter(F.col("status") == fixed.CONFIG_SCANNED)
    both = {"outer": ("manifest_json", schemas.MANIFEST), "body": ("manifest_json", schemas.SCAN_RESULT)}
    none = F.lit(0).cast("bigint")
    return (
        with_parsed(scanned, "_m", both)
        .withColumn("_s", F.coalesce("_m.outer.scan_result", "_m.body"))
        .select(
            "dr_id", "description", F.col("created_by").alias("requested_by"), "scanned_at",
            F.coalesce("_s.total_objects", none).alias("total_objects"),
            F.coalesce(F.size("_s.schemas_required"), F.lit(0)).cast("bigint").alias("total_schemas"),
            F.coalesce("_s.review_required", F.lit(False)).alias("review_required"),
            F.coalesce(F.array_size("_s.non_prod_additional_objects"), F.lit(0)).cast("bigint").alias("non_prod_objects"),
        )
    )


def drifted(edits: DataFrame, configs: DataFrame) -> DataFrame:
    """Edits whose config has another owner than when they were staged."""
    owners = configs.select("dr_id", F.col("created_by").alias("current_created_by"))
    return edits.join(owners, "dr_id").filter(
        F.col("original_created_by").isNotNull()
        & ~F.col("original_created_by").eqNullSafe(F.col("current_created_by"))
    )


def approve(configs: DataFrame, approved: DataFrame, now: Column, only_changed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Apply approved edits: the new configs, and the user changes they bring.

    ``approved`` is (dr_id, proposed_config_json, original_created_by), one row per request.  Edits
    without a proposal and edits whose config changed hands are left out.  The second result is
    (dr_id, environment, action, principal).

    With ``only_changed`` just the configs that changed come back, ready to be appended to a log; both results are then read
    off the edits and their configs, which are joined once and settled.
    """
    form = schemas.CONFIG_FORM
    usable = approved.filter(F.col("proposed_config_json").isNotNull()).join(
        configs.select("dr_id", F.struct(*configs.columns).alias("_config")), "dr_id"
    )
    owner = F.col("_config.created_by")
    usable = usable.filter(F.col("original_created_by").isNull() | F.col("original_created_by").eqNullSafe(owner))
    parsed = with_parsed(
        usable.withColumn("_old_json", F.col("_config.config_json")), "_form",
        {"old": ("_old_json", form), "new": ("proposed_config_json", form)},
    )
    edited = parsed.select(
        "dr_id", F.col("proposed_config_json").alias("new_config_json"), F.col("_form.new.expiration_date").alias("new_expiration_date"),
        F.col("_form.new.description").alias("new_description"), _user_changes("_form.old", "_form.new").alias("_users"),
        *(["_config"] if only_changed else []),
    )
    if only_changed:
        edited = settle(edited)
    kept = F.col("_config.expiration_date" if only_changed else "expiration_date")
    values = {
        "config_json": F.col("new_config_json"),
        "validation_errors": F.lit("[]"),
        "expiration_date": F.coalesce("new_expiration_date", kept),
        "description": F.col("new_description"),
        "updated_at": now,
    }
    users = edited.select("dr_id", F.inline_outer("_users")).filter(F.col("principal").isNotNull())
    if only_changed:
        return changed_rows(edited, "_config", values), users
    news = {c: c.removeprefix("new_") for c in edited.columns}
    return set_columns(configs, edited.drop("_users").withColumnsRenamed(news), ["dr_id"], values), users


def user_changes(edits: DataFrame, old: str, new: str) -> DataFrame:
    """(dr_id, environment, action, principal) for every user an edit adds or removes."""
    return edits.select("dr_id", F.inline_outer(_user_changes(old, new))).filter(F.col("principal").isNotNull())


def _user_changes(old: str, new: str) -> Column:
    def rows(env: str, action: str, names: Column) -> Column:
        return F.transform(
            names, lambda n: F.struct(F.lit(env).alias("environment"), F.lit(action).alias("action"), n.alias("principal"))
        )

    parts = []
    for env, field in (("dev", "developers"), ("qa", "qa_users")):
        before, after = F.col(f"{old}.{field}"), F.col(f"{new}.{field}")
        parts += [rows(env, "grant", names_added(before, after)), rows(env, "revoke", names_removed(before, after))]
    return F.concat(*parts)
