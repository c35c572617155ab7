"""Edits of stored configs: submitted, staged for approval, decided."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandboxlake import fixed, schemas
from sandboxlake.functions.parsing import with_parsed
from sandboxlake.operators import approvals
from sandboxlake.operators.updates import changed_rows
from sandboxlake.operators.validate import validate_requests
from sandboxlake.plans.runs import change_users
from sandboxlake.session import settle
from sandboxlake.sources.documents import flat_forms
from sandboxlake.sources.state import StateTables


@dataclass
class Decided:
    """Outcome per decision (pending_edit_id, dr_id, decision, outcome), and the statements that follow."""

    outcomes: DataFrame
    statements: DataFrame


def submit_edits(state: StateTables, edits: DataFrame, now: str) -> DataFrame:
    """Take new config texts (dr_id, new_json, requester), one per request.

    A sensitive change to a provisioned config is staged for approval; any other one is validated
    and stored at once.  Returns (dr_id, outcome): pending_review or applied.
    """
    # The stored rows stay with the edits, so what becomes of them is told without another look at the configs.
    configs = state.current("configs")
    stored = configs.select("dr_id", F.struct(*configs.columns).alias("config"))
    joined = edits.join(stored, "dr_id").withColumn("old_json", F.col("config.config_json"))
    compared = settle(approvals.compare_configs(joined).drop("old_json"))
    to_stage = F.col("sensitive") & (F.col("config.status") == fixed.CONFIG_PROVISIONED)
    held = F.coalesce(to_stage, F.lit(False))
    at = F.lit(now).cast("timestamp_ntz")
    state.append_audit(approvals.staged_audit_rows(compared.filter(held).withColumn("created_by", F.col("config.created_by")), at))

    forms = flat_forms(compared.filter(~held).select("dr_id", "config", "new_json"), "new_json", ["config", "new_json"])
    kept = (F.col("config.status") == fixed.CONFIG_PROVISIONED) & (F.col("config_status") == fixed.CONFIG_VALID)
    changed = changed_rows(
        validate_requests(forms, now[:10]), "config",
        {
            "config_json": F.col("new_json"),
            "status": F.when(kept, fixed.CONFIG_PROVISIONED).otherwise(F.col("config_status")),
            "validation_errors": F.to_json("errors"),
            "description": F.col("description"),
            "expiration_date": F.col("expiration_date"),
            "updated_at": F.lit(now),
        },
    )
    state.append("configs", changed, now)
    return compared.select("dr_id", F.when(held, "pending_review").otherwise("applied").alias("outcome"))


def decide_edits(state: StateTables, decisions: DataFrame, now: str, by: str) -> Decided:
    """Approve or reject staged edits: (pending_edit_id, decision, reason), decision approve or reject.

    An edit whose config changed hands since is not applied and stays pending.  Of several approved
    edits of one config the latest is what remains.
    """
    decisions = settle(decisions)
    pending = approvals.pending_edits(state.edit_rows(decisions), F.col("edit_key"))
    detailed = with_parsed(pending.select("dr_id", "pending_edit_id", "performed_at", "action_detail"), "_p", {"d": ("action_detail", schemas.PENDING_EDIT)})
    asked = decisions.join(
        detailed.select(
            "pending_edit_id", "dr_id", "performed_at", F.col("_p.d.changes").alias("changes"),
            F.col("_p.d.proposed_config_json").alias("proposed_config_json"),
            F.col("_p.d.original_created_by").alias("original_created_by"),
        ),
        "pending_edit_id", "left",
    )
    configs = state.current("configs")
    owners = configs.select("dr_id", F.col("created_by").alias("_owner"), F.lit(True).alias("_known"))
    moved = F.col("original_created_by").isNotNull() & ~F.col("original_created_by").eqNullSafe(F.col("_owner"))
    judged = settle(
        asked.join(owners, "dr_id", "left").withColumn(
            "outcome",
            F.when(F.col("dr_id").isNull(), "not_found")
            .when(F.col("decision") == "reject", "rejected")
            .when(F.col("_known").isNull(), "config_gone")
            .when(F.col("proposed_config_json").isNull(), "no_proposal")
            .when(moved, "owner_changed")
            .otherwise("approved"),
        )
    )
    at = F.lit(now).cast("timestamp_ntz")
    approved = judged.filter("outcome = 'approved'").groupBy("dr_id").agg(
        F.max_by(
            F.struct("proposed_config_json", "original_created_by"), F.struct("performed_at", "pending_edit_id")
        ).alias("e")
    ).select("dr_id", "e.*")
    # Both are settled with the configs as they were, before the configs move on.
    changed, users = approvals.approve(configs, approved, F.lit(now), only_changed=True)
    state.append("configs", changed, now)
    statements = settle(change_users(state, users, now))
    state.append_audit(approvals.decision_rows(judged.filter("outcome IN ('approved', 'rejected')"), at, by))
    return Decided(judged.select("pending_edit_id", "dr_id", "decision", "outcome"), statements)
