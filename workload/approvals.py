"""Queries: config edits, their approval, and the user changes they bring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandboxlake.operators import approvals, principals
from sandboxlake.plans import copy_plan as plans
from sandboxlake.plans import edits as plans_edits
from workload.fixtures import NOW
from workload.registry import Tables, query
from workload.state import new_state

_KEY = "CASE WHEN json_valid(action_detail) THEN json_extract_string(action_detail, '$.pending_edit_id') END"
_PENDING = f"""SELECT *, {_KEY} AS pending_edit_id FROM fx_audit
    WHERE action = 'CONFIG_EDIT_PENDING' AND {_KEY} IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM (SELECT {_KEY} AS k FROM fx_audit WHERE action IN ('CONFIG_EDIT_APPROVED', 'CONFIG_EDIT_REJECTED')) r WHERE r.k = {_KEY})"""


@query("pending_edits", _PENDING)
def pending_edits(t: Tables) -> DataFrame:
    return approvals.pending_edits(t.view("fx_audit"))


@query("pending_lookup", f"SELECT * FROM ({_PENDING}) WHERE pending_edit_id = 'pe-11-2'")
def _(t: Tables) -> DataFrame:
    return approvals.find_pending(t.view("fx_audit"), "pe-11-2")


_TEXT = "json_extract_string({}, '$.{}')"


def _users(column: str, field: str) -> str:
    return f"coalesce(CAST(json_extract({column}, '$.{field}') AS VARCHAR[]), [])"


def _as_json(items: str) -> str:
    return f"CASE WHEN len({items}) = 0 THEN '[]' ELSE '[\"' || array_to_string({items}, '\",\"') || '\"]' END"


_PARTS = f"""
p AS (
  SELECT *, list_sort({_users('old_json', 'developers')}) AS od, list_sort({_users('new_json', 'developers')}) AS nd,
         list_sort({_users('old_json', 'qa_users')}) AS oq, list_sort({_users('new_json', 'qa_users')}) AS nq,
         {_TEXT.format('old_json', 'description')} AS ot, {_TEXT.format('new_json', 'description')} AS nt FROM fx_edits),
c AS (
  SELECT dr_id, 'access.developers' AS field, {_as_json('od')} AS before, {_as_json('nd')} AS after FROM p WHERE od <> nd
  UNION ALL SELECT dr_id, 'access.qa_users', {_as_json('oq')}, {_as_json('nq')} FROM p WHERE oq <> nq
  UNION ALL SELECT dr_id, 'description', ot, nt FROM p WHERE nullif(ot, '') IS DISTINCT FROM nullif(nt, ''))"""


@query("config_diff", f"WITH {_PARTS} SELECT * FROM c")
def _(t: Tables) -> DataFrame:
    return approvals.change_rows(t.view("fx_edits"))


@query("sensitive_edits", f"WITH {_PARTS} SELECT dr_id, config_status FROM fx_edits WHERE config_status = 'provisioned' AND dr_id IN (SELECT dr_id FROM c WHERE field <> 'description')")
def _(t: Tables) -> DataFrame:
    return approvals.edits_to_stage(t.view("fx_edits")).select("dr_id", "config_status")


@query(
    "stage_edits",
    f"""WITH {_PARTS} SELECT 'log-' || e.dr_id AS log_id, e.dr_id, 'CONFIG_EDIT_PENDING' AS action, requester AS performed_by, TIMESTAMP '{NOW}' AS performed_at,
      'PENDING' AS status, 'pe-' || e.dr_id AS pending_edit_id, n AS changes, new_json AS proposed, created_by AS owner
    FROM fx_edits e JOIN (SELECT dr_id, count(*) AS n, bool_or(field <> 'description') AS sensitive FROM c GROUP BY dr_id) k ON e.dr_id = k.dr_id
    WHERE sensitive AND config_status = 'provisioned'""",
)
def _(t: Tables) -> DataFrame:
    rows = approvals.staged_audit_rows(
        approvals.edits_to_stage(t.view("fx_edits")), F.lit(NOW).cast("timestamp_ntz"),
        edit_id=F.concat(F.lit("pe-"), "dr_id"), log_id=F.concat(F.lit("log-"), "dr_id"),
    )
    detail = F.from_json("action_detail", approvals.schemas.PENDING_EDIT)
    return rows.withColumn("d", detail).select(
        "log_id", "dr_id", "action", "performed_by", "performed_at", "status", "d.pending_edit_id",
        F.size("d.changes").cast("bigint").alias("changes"), F.col("d.proposed_config_json").alias("proposed"),
        F.col("d.original_created_by").alias("owner"),
    )


_OLD, _NEW = "string_split(old_users, ',')", "string_split(new_users, ',')"


def _except(a: str, b: str) -> str:
    return f"list_sort(list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x))))"


@query("user_deltas", f"SELECT dr_id, array_to_string({_except(_NEW, _OLD)}, ',') AS added, array_to_string({_except(_OLD, _NEW)}, ',') AS removed FROM fx_user_edits")
def _(t: Tables) -> DataFrame:
    old, new = F.split("old_users", ","), F.split("new_users", ",")
    return t.view("fx_user_edits").select(
        "dr_id", F.array_join(principals.names_added(old, new), ",").alias("added"),
        F.array_join(principals.names_removed(old, new), ",").alias("removed"),
    )


@query(
    "edit_user_lists",
    f"""SELECT dr_id, array_to_string(list_sort(list_distinct(list_concat(list_filter({_OLD}, lambda x: x <> 'user3@co.com'), {_NEW}))), ',') AS users FROM fx_user_edits""",
)
def _(t: Tables) -> DataFrame:
    edited = principals.edited_list(F.split("old_users", ","), F.split("new_users", ","), F.array(F.lit("user3@co.com")))
    return t.view("fx_user_edits").select("dr_id", F.array_join(edited, ",").alias("users"))


@query("approval_drift", """SELECT e.dr_id, e.original_created_by, c.created_by AS current_created_by FROM fx_edits e JOIN fx_configs c USING (dr_id)
    WHERE e.original_created_by IS NOT NULL AND e.original_created_by <> c.created_by""")
def _(t: Tables) -> DataFrame:
    edits = t.view("fx_edits").select("dr_id", "original_created_by")
    return approvals.drifted(edits, t.view("fx_configs"))


def _approved(t: Tables) -> DataFrame:
    return t.view("fx_edits").select("dr_id", F.col("new_json").alias("proposed_config_json"), "original_created_by")


@query(
    "apply_approvals",
    f"""SELECT c.dr_id, CASE WHEN ok THEN new_json ELSE config_json END AS config_json, c.status,
      CASE WHEN ok THEN '[]' ELSE c.validation_errors END AS validation_errors, c.created_at, c.created_by,
      CASE WHEN ok THEN '{NOW}' ELSE c.updated_at END AS updated_at, c.expiration_date,
      CASE WHEN ok THEN {_TEXT.format('new_json', 'description')} ELSE c.description END AS description, c.manifest_json, c.scanned_at
    FROM (SELECT *, original_created_by IS NULL OR original_created_by = created_by AS ok FROM fx_edits) e JOIN fx_configs c ON e.dr_id = c.dr_id""",
)
def _(t: Tables) -> DataFrame:
    return approvals.approve(t.view("fx_configs"), _approved(t), F.lit(NOW))[0]


_CHANGES = f"""WITH {_PARTS},
k AS (SELECT * FROM p WHERE original_created_by IS NULL OR original_created_by = created_by),
ch AS (
  SELECT dr_id, 'dev' AS environment, 'grant' AS action, unnest({_except('nd', 'od')}) AS principal FROM k
  UNION ALL SELECT dr_id, 'dev', 'revoke', unnest({_except('od', 'nd')}) FROM k
  UNION ALL SELECT dr_id, 'qa', 'grant', unnest({_except('nq', 'oq')}) FROM k
  UNION ALL SELECT dr_id, 'qa', 'revoke', unnest({_except('oq', 'nq')}) FROM k)"""


@query("approved_user_changes", _CHANGES + " SELECT * FROM ch")
def _(t: Tables) -> DataFrame:
    return approvals.approve(t.view("fx_configs"), _approved(t), F.lit(NOW))[1]


@query(
    "approved_grant_plan",
    _CHANGES + """, s AS (SELECT DISTINCT dr_id, target_environment, regexp_extract(target_fqn, '^([^.]*[.][^.]*)', 1) AS schema_fqn
      FROM fx_objects WHERE status IS NULL OR status <> 'DROPPED')
    SELECT s.*, action, principal, unnest(CASE WHEN action = 'grant'
        THEN ['GRANT USAGE ON SCHEMA ' || schema_fqn || ' TO `' || principal || '`', 'GRANT SELECT, MODIFY ON SCHEMA ' || schema_fqn || ' TO `' || principal || '`']
        ELSE ['REVOKE ALL PRIVILEGES ON SCHEMA ' || schema_fqn || ' FROM `' || principal || '`'] END) AS statement
    FROM s JOIN ch ON s.dr_id = ch.dr_id AND s.target_environment = ch.environment""",
)
def _(t: Tables) -> DataFrame:
    changes = approvals.approve(t.view("fx_configs"), _approved(t), F.lit(NOW))[1]
    return plans.user_grant_plan(plans.env_schemas(t.view("fx_objects")), changes)


def _stored(t: Tables):
    """State tables that hold all configs and all objects."""
    state = new_state(t)
    state.append("configs", t.view("fx_configs"), NOW)
    state.append("objects", t.view("fx_objects"), NOW)
    return state


_DAY = "CAST(c.expiration_date AS DATE)"


@query(
    "submit_edits",
    f"""WITH {_PARTS},
    k AS (SELECT dr_id, bool_or(field <> 'description') AS sensitive FROM c GROUP BY dr_id),
    s AS (SELECT e.dr_id, c.status, e.new_json, c.expiration_date, coalesce(sensitive, false) AND c.status = 'provisioned' AS held,
            {_DAY} > DATE '1998-06-15' AND {_DAY} - DATE '1998-06-15' <= 90 AS in_time
          FROM fx_edits e JOIN fx_configs c USING (dr_id) LEFT JOIN k USING (dr_id))
    SELECT dr_id, CASE WHEN held THEN 'pending_review' ELSE 'applied' END AS outcome,
           CASE WHEN held THEN status WHEN NOT in_time THEN 'invalid' WHEN status = 'provisioned' THEN 'provisioned' ELSE 'valid' END AS status,
           CASE WHEN held THEN 1 ELSE 0 END AS staged FROM s""",
)
def submit(t: Tables) -> DataFrame:
    state = _stored(t)
    edits = t.view("fx_edits").select("dr_id", "new_json", "requester")
    outcome = plans_edits.submit_edits(state, edits, NOW)
    staged = state.current("audit").filter("action = 'CONFIG_EDIT_PENDING'").groupBy("dr_id").agg(F.count(F.lit(1)).cast("int").alias("staged"))
    return outcome.join(state.current("configs").select("dr_id", "status"), "dr_id").join(staged, "dr_id", "left").select(
        "dr_id", "outcome", "status", F.coalesce("staged", F.lit(0)).alias("staged")
    )


@query(
    "decide_edits",
    f"""WITH {_PARTS},
    k AS (SELECT dr_id, bool_or(field <> 'description') AS sensitive FROM c GROUP BY dr_id),
    s AS (SELECT e.*, len(e.dr_id) % 2 = 0 AS rejected FROM fx_edits e JOIN fx_configs c USING (dr_id) JOIN k USING (dr_id) WHERE sensitive AND c.status = 'provisioned')
    SELECT dr_id, CASE WHEN rejected THEN 'rejected' ELSE 'approved' END AS outcome, NOT rejected AS changed,
           CASE WHEN rejected THEN 'CONFIG_EDIT_REJECTED' ELSE 'CONFIG_EDIT_APPROVED' END AS action FROM s""",
)
def _(t: Tables) -> DataFrame:
    state = _stored(t)
    edits = t.view("fx_edits").select("dr_id", "new_json", "requester")
    plans_edits.submit_edits(state, edits, NOW)
    pending = approvals.pending_edits(state.current("audit"))
    reject = F.length("dr_id") % 2 == 0
    decided = plans_edits.decide_edits(
        state, pending.select("pending_edit_id", F.when(reject, "reject").otherwise("approve").alias("decision"), F.lit("no").alias("reason")),
        "1998-06-15 13:00:00", "admin@co.com",
    )
    audit = state.current("audit").filter("action IN ('CONFIG_EDIT_APPROVED', 'CONFIG_EDIT_REJECTED')")
    audit = audit.select(approvals.edit_key().alias("pending_edit_id"), "action")
    now_json = state.current("configs").select("dr_id", F.col("config_json").alias("now_json"))
    wanted = edits.select("dr_id", "new_json")
    return (
        decided.outcomes.join(audit, "pending_edit_id").join(now_json, "dr_id").join(wanted, "dr_id")
        .select("dr_id", "outcome", (F.col("now_json") == F.col("new_json")).alias("changed"), "action")
    )
