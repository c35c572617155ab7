"""Queries: open, expired and expiring requests, notices, status cards, audit history, run results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandboxlake import fixed
from sandboxlake.operators import lifecycle, outcomes
from sandboxlake.plans import runs
from workload.fixtures import NOW, TODAY
from workload.registry import Tables, query
from workload.state import new_state

_OPEN = "('PENDING_REVIEW', 'PROVISIONING', 'ACTIVE', 'EXPIRING_SOON')"
_LIVE = "('ACTIVE', 'EXPIRING_SOON')"


@query("active_requests", f"SELECT * FROM fx_requests WHERE status IN {_OPEN}")
def _(t: Tables) -> DataFrame:
    return lifecycle.open_requests(t.view("fx_requests"))


@query("expired_requests", f"SELECT * FROM fx_requests WHERE (expiration_date <= DATE '{TODAY}' AND status = 'ACTIVE') OR status = 'CLEANUP_IN_PROGRESS'")
def _(t: Tables) -> DataFrame:
    return lifecycle.expired_requests(t.view("fx_requests"), TODAY)


_DUE = f"SELECT * FROM fx_requests WHERE expiration_date - INTERVAL 7 DAY <= DATE '{TODAY}' AND notification_sent_at IS NULL AND status = 'ACTIVE'"


@query("requests_to_notify", _DUE)
def _(t: Tables) -> DataFrame:
    return lifecycle.requests_to_notify(t.view("fx_requests"), TODAY)


@query(
    "visible_requests",
    """SELECT r.created_by AS viewer, 'own' AS scope, r.dr_id FROM fx_requests r
    WHERE r.created_by IN (SELECT concat('user', c_custkey, '@co.com') FROM customer WHERE c_mktsegment <> 'BUILDING')
    UNION ALL SELECT concat('user', c_custkey, '@co.com'), 'all', NULL FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def _(t: Tables) -> DataFrame:
    viewers = t.base("customer").select(
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@co.com")).alias("viewer"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_admin"),
    )
    return lifecycle.visible_requests(t.view("fx_requests"), viewers)


@query("visible_to_user", "SELECT * FROM fx_requests WHERE created_by = 'user77@co.com'")
def _(t: Tables) -> DataFrame:
    return lifecycle.visible_to(t.view("fx_requests"), "user77@co.com", is_admin=False)


_KEPT = "SELECT * FROM fx_objects WHERE status IS NOT NULL AND status <> 'DROPPED'"


@query("refresh_targets_full", _KEPT)
def _(t: Tables) -> DataFrame:
    return lifecycle.refresh_targets(t.view("fx_objects"), "full")


@query("refresh_targets_incremental", f"{_KEPT} AND clone_strategy IN ('shallow_clone', 'deep_clone')")
def _(t: Tables) -> DataFrame:
    return lifecycle.refresh_targets(t.view("fx_objects"), "incremental")


@query("refresh_targets_selective", f"{_KEPT} AND source_fqn IN (SELECT source_table_full_name FROM fx_edges)")
def _(t: Tables) -> DataFrame:
    chosen = t.view("fx_edges").select(F.col("source_table_full_name").alias("source_fqn"))
    return lifecycle.refresh_targets(t.view("fx_objects"), "selective", chosen)


@query(
    "refresh_eligible",
    f"""SELECT dr_id, CASE WHEN status NOT IN {_LIVE} THEN 'not_active' WHEN expiration_date < DATE '{TODAY}' THEN 'expired' END AS reason
    FROM fx_requests""",
)
def _(t: Tables) -> DataFrame:
    return lifecycle.with_eligibility(t.view("fx_requests"), TODAY).select("dr_id", "reason")


@query(
    "collisions",
    f"""SELECT dr_id, total_objects, review_required FROM (
      SELECT dr_id, count(*) AS total_objects, count(*) > 3 AS review_required FROM fx_objects GROUP BY dr_id)
    WHERE review_required AND dr_id IN (SELECT dr_id FROM fx_requests WHERE status IN {_LIVE})""",
)
def _(t: Tables) -> DataFrame:
    headers = lifecycle.object_counts(t.view("fx_objects")).withColumn("review_required", F.col("total_objects") > 3)
    return lifecycle.collisions(t.view("fx_requests"), headers)


@query(
    "requests_with_counts",
    """SELECT r.*, coalesce(n, 0) AS total_objects FROM fx_requests r
    LEFT JOIN (SELECT dr_id, count(*) AS n FROM fx_objects GROUP BY dr_id) o USING (dr_id)""",
)
def _(t: Tables) -> DataFrame:
    return lifecycle.with_object_counts(t.view("fx_requests"), t.view("fx_objects"))


_RECIPIENTS = r"""
WITH docs AS (
  SELECT concat('DR-', doc_no) AS dr_id, CASE WHEN json_valid(document) THEN document END AS document FROM fx_documents),
lists AS (
  SELECT r.*, CAST(json_extract(document, '$.development_request.lifecycle.notification_recipients') AS VARCHAR[]) AS listed,
         CAST(json_extract(document, '$.development_request.access.developers') AS VARCHAR[]) AS devs
  FROM fx_requests r JOIN docs d USING (dr_id)),
picked AS (
  SELECT *, list_filter(CASE WHEN len(listed) > 0 THEN listed WHEN len(devs) > 0 THEN devs ELSE [created_by] END,
                        lambda x: regexp_full_match(x, '[a-zA-Z0-9_.@\-]+')) AS names FROM lists)"""


def _documented(t: Tables) -> DataFrame:
    docs = t.view("fx_documents").select(
        F.concat(F.lit("DR-"), F.col("doc_no").cast("string")).alias("dr_id"), F.col("document").alias("config_json")
    )
    return t.view("fx_requests").join(docs, "dr_id")


@query("recipients", _RECIPIENTS + " SELECT dr_id, array_to_string(names, ',') AS recipients FROM picked")
def _(t: Tables) -> DataFrame:
    rows = lifecycle.recipients(_documented(t))
    return rows.select("dr_id", F.array_join("recipients", ",").alias("recipients"))


@query(
    "notifications",
    _RECIPIENTS + f""" SELECT p.dr_id, description, expiration_date, coalesce(n, 0) AS total_objects, array_to_string(names, ',') AS recipients,
      concat('Request ', p.dr_id, ' expires on ', expiration_date) AS subject, true AS body_complete
    FROM picked p LEFT JOIN (SELECT dr_id, count(*) AS n FROM fx_objects GROUP BY dr_id) o ON p.dr_id = o.dr_id
    WHERE p.dr_id IN (SELECT dr_id FROM ({_DUE}))""",
)
def _(t: Tables) -> DataFrame:
    rows = lifecycle.notices(_documented(t), t.view("fx_objects"), TODAY)
    whole = F.contains("body", F.concat(F.lit("Objects: "), F.col("total_objects").cast("string"))) & F.contains("body", "dr_id")
    return rows.withColumn("recipients", F.array_join("recipients", ",")).withColumn("body_complete", whole).drop("body")


@query("status_breakdown", "SELECT dr_id, coalesce(status, 'UNKNOWN') AS object_status, count(*) AS objects FROM fx_objects GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return lifecycle.status_breakdown(t.view("fx_objects"))


_RANKED = "SELECT *, row_number() OVER (PARTITION BY dr_id ORDER BY performed_at DESC, log_id) AS rank FROM fx_audit"


@query("audit_recent", f"SELECT * EXCLUDE (rank), CAST(rank AS INTEGER) AS rank FROM ({_RANKED}) WHERE rank <= 5")
def audit_recent(t: Tables) -> DataFrame:
    return lifecycle.recent_audit(t.view("fx_audit"), 5)


@query("audit_of_request", "SELECT * FROM fx_audit WHERE dr_id = 'DR-7' ORDER BY performed_at DESC, log_id LIMIT 500")
def _(t: Tables) -> DataFrame:
    return lifecycle.audit_of_request(t.view("fx_audit"), "DR-7", fixed.AUDIT_LIST_LIMIT)


@query("audit_by_action", "SELECT * FROM fx_audit WHERE action = 'REFRESH' ORDER BY performed_at DESC, log_id")
def _(t: Tables) -> DataFrame:
    return lifecycle.audit_by_action(t.view("fx_audit"), "REFRESH")


@query("configs_listing", "SELECT * FROM fx_configs ORDER BY created_at DESC, dr_id")
def _(t: Tables) -> DataFrame:
    return lifecycle.configs_newest_first(t.view("fx_configs"))


@query(
    "request_status",
    f"""WITH a AS (SELECT dr_id, string_agg(concat_ws(' ', action, status, CAST(performed_at AS VARCHAR)), '; ' ORDER BY rank) AS recent_audit
      FROM ({_RANKED}) WHERE rank <= 5 GROUP BY dr_id),
    o AS (SELECT dr_id, count(*) AS total_objects, count(*) FILTER (WHERE status = 'PROVISIONED') AS provisioned,
            count(*) FILTER (WHERE status = 'REFRESH_PENDING') AS refresh_pending, count(*) FILTER (WHERE status = 'FAILED') AS failed,
            count(*) FILTER (WHERE status = 'DROPPED') AS dropped, count(*) FILTER (WHERE status IS NULL) AS unknown FROM fx_objects GROUP BY dr_id)
    SELECT r.*, coalesce(total_objects, 0) AS total_objects, coalesce(provisioned, 0) AS provisioned, coalesce(refresh_pending, 0) AS refresh_pending,
           coalesce(failed, 0) AS failed, coalesce(dropped, 0) AS dropped, coalesce(unknown, 0) AS unknown, coalesce(recent_audit, '') AS recent_audit
    FROM fx_requests r LEFT JOIN o USING (dr_id) LEFT JOIN a USING (dr_id)""",
)
def request_status(t: Tables) -> DataFrame:
    return lifecycle.request_status(t.view("fx_requests"), t.view("fx_objects"), t.view("fx_audit"))


# ---- run results -------------------------------------------------------------------------------

_COUNTED = """SELECT r.dr_id, coalesce(ok, 0) AS succeeded, coalesce(bad, 0) AS failed FROM fx_requests r
  LEFT JOIN (SELECT dr_id, count(*) FILTER (WHERE success) AS ok, count(*) FILTER (WHERE NOT success) AS bad FROM fx_outcomes GROUP BY dr_id) o USING (dr_id)"""


@query(
    "run_status",
    f"""SELECT *, CASE WHEN succeeded = 0 AND failed > 0 THEN 'FAILED' ELSE 'ACTIVE' END AS final_status,
      CASE WHEN succeeded = 0 AND failed > 0 THEN 'FAILED' WHEN failed > 0 THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS audit_status
    FROM ({_COUNTED})""",
)
def _(t: Tables) -> DataFrame:
    return outcomes.run_status(t.view("fx_requests"), t.view("fx_outcomes"))


@query(
    "cleanup_status",
    f"""SELECT *, CASE WHEN failed = 0 THEN 'CLEANED_UP' ELSE 'CLEANUP_IN_PROGRESS' END AS final_status,
      CASE WHEN failed = 0 THEN 'SUCCESS' ELSE 'PARTIAL_SUCCESS' END AS audit_status FROM ({_COUNTED})""",
)
def _(t: Tables) -> DataFrame:
    return outcomes.cleanup_status(t.view("fx_requests"), t.view("fx_outcomes"))


@query(
    "failed_objects",
    """SELECT dr_id, concat('{"failed_objects":["', string_agg(source_fqn, '","' ORDER BY source_fqn), '"]}') AS error_message
    FROM fx_outcomes WHERE NOT success GROUP BY dr_id""",
)
def _(t: Tables) -> DataFrame:
    return outcomes.failed_objects(t.view("fx_outcomes"))


@query(
    "run_counters",
    """SELECT dr_id, count(*) FILTER (WHERE success AND action = 'clone') AS clone_ok, count(*) FILTER (WHERE success AND action = 'drop') AS drop_ok,
      count(*) FILTER (WHERE action = 'skip') AS skipped, count(*) FILTER (WHERE NOT success) AS failed FROM fx_outcomes GROUP BY dr_id""",
)
def _(t: Tables) -> DataFrame:
    return outcomes.run_counters(t.view("fx_outcomes"), ["clone", "drop"])


@query(
    "notify_confirm",
    f"""WITH due AS ({_DUE}), failed AS (SELECT * FROM due WHERE CAST(dr_id[4:] AS BIGINT) % 2 = 0)
    SELECT 1 AS round, dr_id, CASE WHEN CAST(dr_id[4:] AS BIGINT) % 2 = 0 THEN 2 ELSE 1 END AS attempts, true AS stamped FROM due
    UNION ALL SELECT 2, dr_id, 2, true FROM failed""",
)
def _(t: Tables) -> DataFrame:
    """Notices of two calls: those that could not be sent come due again, and nothing does once all are confirmed."""
    state = new_state(t)
    state.append("requests", t.view("fx_requests"), NOW)
    state.append("objects", t.view("fx_objects"), NOW)
    failing = F.substring("dr_id", 4, 20).cast("bigint") % 2 == 0
    calls = []
    for number in (1, 2, 3):
        due = runs.notify(state, NOW).select("dr_id")
        calls.append(due.select(F.lit(number).alias("round"), "dr_id"))
        again = runs.notify(state, NOW).select("dr_id")  # leased
        sent = ~failing if number == 1 else F.lit(True)
        runs.confirm_notices(state, due.unionByName(again).select("dr_id", sent.alias("success"), F.when(~sent, "no answer").alias("error")), NOW)
    told = state.current("notices").select("dr_id", F.col("attempts").cast("int").alias("attempts"))
    stamped = state.current("requests").select("dr_id", F.col("notification_sent_at").isNotNull().alias("stamped"))
    return reduce(DataFrame.unionByName, calls).join(told, "dr_id").join(stamped, "dr_id").select("round", "dr_id", "attempts", "stamped")
