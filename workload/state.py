"""Queries: appends, updates and deletes on state tables, time travel."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandboxlake import fixed, schemas
from sandboxlake.operators import asof, lifecycle, updates
from sandboxlake.session import settle, shared_dir
from sandboxlake.sources import state
from workload.fixtures import NOW, TODAY
from workload.registry import Tables, query

REQUEST = "dr_id, description, status, created_at, created_by, expiration_date, notification_sent_at"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _legal(moves) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in moves) + ") AS legal(cur, nxt)"


def new_state(t: Tables) -> state.StateTables:
    """Fresh state tables in the shared folder."""
    tables = state.StateTables(t.spark, f"{shared_dir(t.spark)}/state-{uuid.uuid4().hex[:12]}")
    tables.create()
    return tables


# ---- appends -----------------------------------------------------------------------------------


@query("schema_evolve", """SELECT dr_id, config_json, status, validation_errors, created_at, created_by, updated_at, expiration_date, description,
    CASE WHEN status = 'scanned' THEN manifest_json END AS manifest_json, CASE WHEN status = 'scanned' THEN scanned_at END AS scanned_at FROM fx_configs""")
def _(t: Tables) -> DataFrame:
    configs = t.view("fx_configs")
    old = configs.filter("status <> 'scanned'").drop("manifest_json", "scanned_at")
    new = configs.filter("status = 'scanned'")
    return state.evolve(old, schemas.CONFIGS).unionByName(state.evolve(new, schemas.CONFIGS))


def _round_trip(t: Tables, name: str, view: str) -> DataFrame:
    tables, rows = new_state(t), t.view(view)
    tables.append(name, rows, NOW)
    return tables.current(name).select(*rows.columns)


@query("append_requests", f"SELECT {REQUEST} FROM fx_requests")
def _(t: Tables) -> DataFrame:
    return _round_trip(t, "requests", "fx_requests")


@query("append_objects", "SELECT * FROM fx_objects")
def _(t: Tables) -> DataFrame:
    return _round_trip(t, "objects", "fx_objects")


@query("append_access", "SELECT * FROM fx_access")
def _(t: Tables) -> DataFrame:
    return _round_trip(t, "access", "fx_access")


@query("append_configs", "SELECT * FROM fx_configs")
def _(t: Tables) -> DataFrame:
    return _round_trip(t, "configs", "fx_configs")


@query("audit_append", "SELECT dr_id, action, performed_at, status, CASE WHEN status = 'FAILED' THEN 'fresh' ELSE log_id END AS log_id FROM fx_audit")
def _(t: Tables) -> DataFrame:
    tables = new_state(t)
    rows = t.view("fx_audit").withColumn("log_id", F.when(F.col("status") != "FAILED", F.col("log_id")))
    tables.append_audit(rows)
    fresh = (F.length("log_id") == 36) & ~F.col("log_id").startswith("log-")
    return tables.current("audit").select(
        "dr_id", "action", "performed_at", "status", F.when(fresh, "fresh").otherwise(F.col("log_id")).alias("log_id")
    )


@query("objects_of_requests", "SELECT * FROM fx_objects WHERE dr_id IN (SELECT dr_id FROM fx_requests WHERE status = 'ACTIVE')")
def _(t: Tables) -> DataFrame:
    live = t.view("fx_requests").filter(F.col("status") == fixed.ACTIVE)
    return state.rows_of_requests(t.view("fx_objects"), live)


@query(
    "compact_state",
    """WITH now AS (SELECT * REPLACE (CASE WHEN status = 'REFRESH_PENDING' THEN 'PROVISIONED' WHEN status = 'FAILED' THEN 'REFRESH_PENDING' ELSE status END AS status)
      FROM fx_objects WHERE status IS DISTINCT FROM 'DROPPED')
    SELECT 'before' AS seen, dr_id, source_fqn, target_environment, CASE WHEN status = 'PROVISIONED' AND source_fqn IN
      (SELECT source_fqn FROM fx_objects o WHERE o.dr_id = now.dr_id AND o.target_environment = now.target_environment AND status = 'REFRESH_PENDING')
      THEN 'REFRESH_PENDING' ELSE status END AS status FROM now
    UNION ALL SELECT 'after', dr_id, source_fqn, target_environment, status FROM now
    UNION ALL SELECT 'lookup', dr_id, source_fqn, target_environment, status FROM now WHERE dr_id IN (SELECT dr_id FROM fx_requests WHERE status = 'ACTIVE')""",
)
def _(t: Tables) -> DataFrame:
    """Rows, changes and deletes made one generation; further changes on top of it; a lookup by request."""
    tables, objects = new_state(t), t.view("fx_objects")
    tables.append("objects", objects, NOW)
    tables.append("objects", objects.filter("status = 'FAILED'").withColumn("status", F.lit("REFRESH_PENDING")), NOW)
    tables.append("objects", objects.filter("status = 'DROPPED'"), NOW, "delete")
    tables.compact("objects")
    columns = ["dr_id", "source_fqn", "target_environment", "status"]
    before = settle(tables.current("objects").select(F.lit("before").alias("seen"), *columns))
    tables.append("objects", objects.filter("status = 'REFRESH_PENDING'").withColumn("status", F.lit("PROVISIONED")), NOW)
    tables.compact("objects")
    live = t.view("fx_requests").filter(F.col("status") == fixed.ACTIVE)
    after = tables.current("objects").select(F.lit("after").alias("seen"), *columns)
    return before.unionByName(after).unionByName(tables.of_requests("objects", live).select(F.lit("lookup").alias("seen"), *columns))


# ---- compare and set ---------------------------------------------------------------------------


def _cas(rows: str, moves: str, legal, key: list[str], stamp: str) -> str:
    keys = ", ".join(key)
    match = " AND ".join(f"s.{k} = w.{k}" for k in key)
    return f"""
WITH w AS (
  SELECT * FROM (
    SELECT m.*, row_number() OVER (PARTITION BY {keys}, current_status ORDER BY seq) AS rn
    FROM {moves} m JOIN {_legal(legal)} ON m.current_status = cur AND m.new_status = nxt) WHERE rn = 1)
SELECT s.* EXCLUDE (status), coalesce(w.new_status, s.status) AS status, w.at AS {stamp}
FROM {rows} s LEFT JOIN w ON {match} AND s.status = w.current_status"""


@query("cas_request_status", _cas("fx_requests", "fx_request_moves", fixed.REQUEST_MOVES, ["dr_id"], "last_modified_at"))
def cas_request_status(t: Tables) -> DataFrame:
    rows = t.view("fx_requests").withColumn("last_modified_at", F.lit(None).cast("timestamp_ntz"))
    return updates.compare_and_set(
        rows, t.view("fx_request_moves"), ["dr_id"], fixed.REQUEST_MOVES, {"last_modified_at": "at"}
    )


OBJECT_KEY = ["dr_id", "source_fqn", "target_environment"]


@query("cas_object_status", _cas("fx_objects", "fx_object_moves", fixed.OBJECT_MOVES, OBJECT_KEY, "last_refreshed_at"))
def _(t: Tables) -> DataFrame:
    rows = t.view("fx_objects").withColumn("last_refreshed_at", F.lit(None).cast("timestamp_ntz"))
    return updates.compare_and_set(
        rows, t.view("fx_object_moves"), OBJECT_KEY, fixed.OBJECT_MOVES, {"last_refreshed_at": "at"}
    )


@query("cas_outcomes", f"""
WITH l AS (SELECT m.*, cur IS NOT NULL AS ok FROM fx_request_moves m LEFT JOIN {_legal(fixed.REQUEST_MOVES)} ON m.current_status = cur AND m.new_status = nxt),
f AS (SELECT *, row_number() OVER (PARTITION BY dr_id, current_status, ok ORDER BY seq) AS rn FROM l)
SELECT f.dr_id, f.current_status, f.new_status, f.seq, f.at,
       CASE WHEN s.status IS NULL THEN 'not_found' WHEN NOT ok THEN 'illegal_move' WHEN s.status <> f.current_status THEN 'status_differs'
            WHEN rn = 1 THEN 'applied' ELSE 'superseded' END AS outcome
FROM f LEFT JOIN fx_requests s ON f.dr_id = s.dr_id""")
def _(t: Tables) -> DataFrame:
    return updates.compare_and_set_outcomes(
        t.view("fx_requests"), t.view("fx_request_moves"), ["dr_id"], fixed.REQUEST_MOVES
    )


@query("illegal_transitions", f"""
WITH p AS (SELECT k, seq, lag(status) OVER (PARTITION BY k ORDER BY seq) AS current_status, status AS new_status FROM fx_status_log)
SELECT p.* FROM p LEFT JOIN {_legal(fixed.REQUEST_MOVES)} ON current_status = cur AND new_status = nxt
WHERE current_status IS NOT NULL AND cur IS NULL""")
def illegal_transitions(t: Tables) -> DataFrame:
    from sandboxlake.operators.slices import with_previous

    pairs = with_previous(t.view("fx_status_log"), ["k"], ["seq"], "status", "current_status")
    pairs = pairs.filter("current_status IS NOT NULL").withColumnRenamed("status", "new_status")
    return updates.illegal_moves(pairs, fixed.REQUEST_MOVES)


# ---- stamps, plain updates, deletes ------------------------------------------------------------

_LAST = 'SELECT dr_id, arg_max("at", seq) AS last_at FROM fx_request_moves GROUP BY dr_id'


@query("stamp_notified", f"SELECT s.* EXCLUDE (notification_sent_at), coalesce(c.last_at, s.notification_sent_at) AS notification_sent_at FROM fx_requests s LEFT JOIN ({_LAST}) c USING (dr_id)")
def _(t: Tables) -> DataFrame:
    moves = t.view("fx_request_moves").select("dr_id", "at", "seq")
    return updates.stamp(t.view("fx_requests"), moves, ["dr_id"], "notification_sent_at")


@query("stamp_refreshed", f"SELECT s.*, c.last_at AS last_refreshed_at FROM fx_requests s LEFT JOIN ({_LAST}) c USING (dr_id)")
def _(t: Tables) -> DataFrame:
    rows = t.view("fx_requests").withColumn("last_refreshed_at", F.lit(None).cast("timestamp_ntz"))
    return updates.stamp(rows, t.view("fx_request_moves").select("dr_id", "at", "seq"), ["dr_id"], "last_refreshed_at")


@query("change_expiration", f"""
SELECT s.* EXCLUDE (expiration_date), CASE WHEN c.last_at >= TIMESTAMP '{TODAY}' THEN CAST(c.last_at AS DATE) ELSE s.expiration_date END AS expiration_date,
       CASE WHEN c.last_at >= TIMESTAMP '{TODAY}' THEN TIMESTAMP '{NOW}' END AS last_modified_at
FROM fx_requests s LEFT JOIN ({_LAST}) c USING (dr_id)""")
def _(t: Tables) -> DataFrame:
    rows = t.view("fx_requests").withColumn("last_modified_at", F.lit(None).cast("timestamp_ntz"))
    changes = t.view("fx_request_moves").select("dr_id", F.col("at").cast("date").alias("expiration_date"), "seq")
    return updates.change_expiration(rows, changes, TODAY, _now())


@query("update_configs", f"""
SELECT c.dr_id, e.new_json AS config_json, e.config_status AS status, '[]' AS validation_errors, c.created_at, c.created_by,
       '{NOW}' AS updated_at, c.expiration_date, c.description,
       CASE WHEN e.config_status = 'scanned' THEN '{{}}' ELSE c.manifest_json END AS manifest_json,
       CASE WHEN e.config_status = 'scanned' THEN '{NOW}' ELSE c.scanned_at END AS scanned_at
FROM fx_configs c JOIN fx_edits e USING (dr_id)""")
def _(t: Tables) -> DataFrame:
    edits = t.view("fx_edits").select("dr_id", F.col("new_json").alias("config_json"), F.col("config_status").alias("status"))
    now = F.lit(NOW)
    changed = updates.set_columns(
        t.view("fx_configs"), edits, ["dr_id"],
        {"config_json": F.col("new_config_json"), "status": F.col("new_status"), "validation_errors": F.lit("[]"), "updated_at": now},
    )
    scanned = edits.filter(F.col("status") == fixed.CONFIG_SCANNED).select("dr_id", F.lit("{}").alias("manifest_json"))
    return updates.set_columns(
        changed, scanned, ["dr_id"], {"manifest_json": F.col("new_manifest_json"), "scanned_at": now, "updated_at": now}
    )


_GONE = "SELECT dr_id FROM fx_requests WHERE status = 'CLEANED_UP'"


@query("delete_by_request", f"SELECT * FROM fx_objects WHERE dr_id NOT IN ({_GONE})")
def _(t: Tables) -> DataFrame:
    gone = t.view("fx_requests").filter(F.col("status") == fixed.CLEANED_UP)
    return updates.delete_matching(t.view("fx_objects"), gone, ["dr_id"])


@query("delete_access_by_request", f"SELECT * FROM fx_access WHERE dr_id NOT IN ({_GONE})")
def _(t: Tables) -> DataFrame:
    gone = t.view("fx_requests").filter(F.col("status") == fixed.CLEANED_UP)
    return updates.delete_matching(t.view("fx_access"), gone, ["dr_id"])


@query("delete_configs_guarded", "SELECT * FROM fx_configs WHERE status = 'provisioned' OR dr_id NOT IN (SELECT dr_id FROM fx_request_moves)")
def _(t: Tables) -> DataFrame:
    return updates.delete_configs(t.view("fx_configs"), t.view("fx_request_moves"))


@query("audit_purge", "SELECT * FROM fx_audit WHERE performed_at >= TIMESTAMP '2025-01-15 12:00:00' - INTERVAL 365 DAY")
def _(t: Tables) -> DataFrame:
    return lifecycle.audit_kept(t.view("fx_audit"), "2025-01-15 12:00:00")


@query("audit_purge_stored", "SELECT log_id, dr_id, performed_at FROM fx_audit WHERE performed_at >= TIMESTAMP '2025-01-15 12:00:00' - INTERVAL 365 DAY")
def _(t: Tables) -> DataFrame:
    tables = new_state(t)
    tables.append_audit(t.view("fx_audit"))
    tables.purge_audit("2025-01-15 12:00:00")
    return tables.current("audit").select("log_id", "dr_id", "performed_at")


# ---- time travel -------------------------------------------------------------------------------


def _as_of_sql(where: str) -> str:
    return f"""SELECT k, payload FROM (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY commit_version DESC) AS rn FROM fx_commits {where})
    WHERE rn = 1 AND op <> 'delete'"""


def middle_version(t: Tables) -> int:
    return t.base("events").agg(F.max("event_id").alias("m")).first()["m"] // 2


@query("as_of_latest", _as_of_sql(""))
def _(t: Tables) -> DataFrame:
    return asof.as_of(t.view("fx_commits"), ["k"])


@query("as_of_version", _as_of_sql("WHERE commit_version <= (SELECT max(event_id) // 2 FROM events)"))
def _(t: Tables) -> DataFrame:
    return asof.as_of(t.view("fx_commits"), ["k"], version=middle_version(t))


@query("as_of_timestamp", _as_of_sql("WHERE commit_ts <= TIMESTAMP '2024-01-16 07:30:00'"))
def _(t: Tables) -> DataFrame:
    return asof.as_of(t.view("fx_commits"), ["k"], timestamp="2024-01-16 07:30:00")
