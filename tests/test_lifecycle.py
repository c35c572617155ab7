"""Lifecycle questions, run results, config edits and request checks on small tables."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sandboxlake.operators import approvals, lifecycle, outcomes, principals, validate
from sandboxlake.plans import runs
from sandboxlake.sources import documents
from sandboxlake.sources.state import StateTables

REQUEST = "dr_id string, status string, expiration_date date, notification_sent_at timestamp_ntz, created_by string"


@pytest.fixture
def requests(frame):
    return frame(
        REQUEST,
        ("1", "ACTIVE", date(2026, 1, 10), None, "a"), ("2", "ACTIVE", date(2026, 1, 17), None, "a"), ("3", "ACTIVE", date(2026, 1, 18), None, "b"),
        ("4", "EXPIRING_SOON", date(2026, 1, 1), None, "b"), ("5", "CLEANUP_IN_PROGRESS", date(2026, 9, 9), None, "b"),
        ("6", "ACTIVE", date(2026, 1, 12), datetime(2026, 1, 5), "c"), ("7", "PENDING_REVIEW", date(2026, 1, 1), None, "c"),
    )


def ids(df):
    return [r[0] for r in rows(df, "dr_id")]


def test_filters(requests, frame):
    today = "2026-01-10"
    assert ids(lifecycle.open_requests(requests)) == ["1", "2", "3", "4", "6", "7"]
    assert ids(lifecycle.expired_requests(requests, today)) == ["1", "5"]
    assert ids(lifecycle.expired_requests(requests, today, ("ACTIVE", "EXPIRING_SOON"))) == ["1", "4", "5"]
    assert ids(lifecycle.requests_to_notify(requests, today)) == ["1", "2"]
    assert ids(lifecycle.requests_to_notify(requests, today, F.lit(8))) == ["1", "2", "3"]
    assert ids(lifecycle.visible_to(requests, "c", False)) == ["6", "7"] and ids(lifecycle.visible_to(requests, "c", True)) == list("1234567")
    viewers = frame("viewer string, is_admin boolean", ("a", False), ("b", True), ("a", False))
    visible = lifecycle.visible_requests(requests, viewers)
    assert rows(visible) == [("a", "own", "1"), ("a", "own", "2"), ("b", "all", None)]
    assert [len(ids(lifecycle.may_list(requests, visible, v))) for v in ("a", "b", "nobody")] == [2, 7, 0]
    assert rows(lifecycle.with_eligibility(requests, today), "dr_id", "reason") == [
        ("1", None), ("2", None), ("3", None), ("4", "expired"), ("5", "not_active"), ("6", None), ("7", "not_active"),
    ]


def test_refresh_targets(frame):
    objects = frame(
        "dr_id string, source_fqn string, clone_strategy string, status string",
        ("1", "a", "view", "PROVISIONED"), ("1", "b", "deep_clone", "FAILED"), ("1", "c", "shallow_clone", "DROPPED"), ("1", "d", "shallow_clone", None), ("2", "b", "schema_only", "PROVISIONED"),
    )
    pick = lambda *a: [r[0] for r in rows(lifecycle.refresh_targets(objects, *a), "source_fqn")]
    assert pick("full") == ["a", "b", "b"] and pick("incremental") == ["b"] and pick("selective") == []
    assert pick("selective", frame("source_fqn string", ("b",), ("c",))) == ["b", "b"]
    assert pick("selective", frame("dr_id string, source_fqn string", ("2", "b"))) == ["b"]
    with pytest.raises(ValueError):
        pick("other")


def test_collisions(requests, frame):
    headers = frame("dr_id string, review_required boolean", ("1", True), ("2", False), ("7", True), ("new", True))
    assert ids(lifecycle.collisions(requests, headers)) == ["1"]
    assert ids(lifecycle.collisions(requests, headers, force=True)) == []


def test_counts_and_cards(requests, frame):
    objects = frame("dr_id string, status string", ("1", "PROVISIONED"), ("1", None), ("1", "PROVISIONED"), ("2", "FAILED"))
    audit = frame("log_id string, dr_id string, action string, status string, performed_at timestamp_ntz", ("x", "1", "NOTIFY", "SUCCESS", datetime(2026, 1, 1)), ("y", "1", "REFRESH", "FAILED", datetime(2026, 1, 2)))
    assert rows(lifecycle.status_breakdown(objects)) == [("1", "PROVISIONED", 2), ("1", "UNKNOWN", 1), ("2", "FAILED", 1)]
    assert lifecycle.status_counts(objects).filter("dr_id = '1'").first()["object_breakdown"] == {"PROVISIONED": 2, "UNKNOWN": 1}
    cards = lifecycle.request_status(requests.select("dr_id"), objects, audit, 1)
    assert rows(cards.filter("dr_id < '4'"), "dr_id", "total_objects", "provisioned", "unknown", "recent_audit") == [
        ("1", 3, 2, 1, "REFRESH FAILED 2026-01-02 00:00:00"), ("2", 1, 0, 0, ""), ("3", 0, 0, 0, ""),
    ]


@pytest.mark.parametrize(
    "config, want",
    [
        ({"development_request": {"lifecycle": {"notification_recipients": ["n@x.co", "b d"]}, "access": {"developers": ["d"]}}}, ["n@x.co"]),
        ({"development_request": {"lifecycle": {"notification_recipients": []}, "access": {"developers": ["d", "e f"]}}}, ["d"]),
        ({"access": {"developers": ["d"]}}, ["d"]),
        ({"lifecycle": {"notification_recipients": ["b d"]}}, []),
        ({}, ["me@x.co"]),
        ("broken", ["me@x.co"]),
        (None, ["me@x.co"]),
    ],
)
def test_recipients(frame, config, want):
    text = config if config is None or isinstance(config, str) else json.dumps(config)
    got = lifecycle.recipients(frame("created_by string, config_json string", ("me@x.co", text)))
    assert got.first()["recipients"] == want


def test_unsafe_creator_gets_nothing(frame):
    assert lifecycle.recipients(frame("created_by string, config_json string", ("not safe", None))).first()["recipients"] == []


@pytest.mark.parametrize("ok, bad, want", [(0, 0, ("ACTIVE", "SUCCESS")), (2, 0, ("ACTIVE", "SUCCESS")), (1, 1, ("ACTIVE", "PARTIAL_SUCCESS")), (0, 3, ("FAILED", "FAILED"))])
def test_run_status(frame, ok, bad, want):
    done = frame("dr_id string, success boolean", *([("1", True)] * ok + [("1", False)] * bad))
    assert rows(outcomes.run_status(frame("dr_id string", ("1",)), done), "final_status", "audit_status") == [want]
    clean = ("CLEANUP_IN_PROGRESS", "PARTIAL_SUCCESS") if bad else ("CLEANED_UP", "SUCCESS")
    assert rows(outcomes.cleanup_status(frame("dr_id string", ("1",)), done), "final_status", "audit_status") == [clean]


def test_failed_lists(frame, spark):
    """One row per request however long its list is, and the same failures as rows of the run."""
    done = spark.range(12_000).selectExpr(
        "'r' AS run_id", "'1' AS dr_id", "concat('t', id) AS source_fqn", "'dev' AS target_environment", "'clone' AS action", "id > 11000 AS success", "'e' AS error"
    )
    found = outcomes.failed_objects(done).collect()
    assert len(found) == 1 and json.loads(found[0]["error_message"])["failed_objects"] == sorted(f"t{i}" for i in range(11_001))
    assert outcomes.failures(done).filter("run_id = 'r' AND dr_id = '1'").count() == 11_001


def change(frame, old, new):
    got = approvals.compare_configs(frame("old_json string, new_json string", (json.dumps(old), json.dumps(new)))).first()
    return [tuple(c) for c in got["changes"]], got["sensitive"]


def test_config_changes(frame):
    assert change(frame, {"developers": ["b", "a"], "description": ""}, {"developers": ["a", "b"], "qa_users": [], "description": None}) == ([], False)
    assert change(frame, {"description": "x"}, {"description": "y", "expiration_date": "2026-01-01"}) == (
        [("description", "x", "y"), ("lifecycle.expiration_date", None, "2026-01-01")], False,
    )
    assert change(frame, {"developers": ["a"]}, {"developers": ["b", "a"], "additional_objects": ["p.q.r"]}) == (
        [("access.developers", '["a"]', '["a","b"]'), ("additional_objects", "[]", '["p.q.r"]')], True,
    )


def test_staging_and_approval(frame):
    edits = frame(
        "dr_id string, old_json string, new_json string, config_status string, created_by string, requester string",
        ("1", '{"developers": ["a"]}', '{"developers": ["b"], "expiration_date": "2026-05-05"}', "provisioned", "own", "r"),
        ("2", '{"developers": ["a"]}', '{"developers": ["b"]}', "scanned", "own", "r"),
        ("3", '{"description": "a"}', '{"description": "b"}', "provisioned", "own", "r"),
        ("4", '{"developers": ["a"]}', '{"developers": ["b"]}', "provisioned", "own", "r"),
    )
    staged = approvals.staged_audit_rows(approvals.edits_to_stage(edits), F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz"))
    assert ids(staged) == ["1", "4"]
    detail = json.loads(staged.filter("dr_id = '1'").first()["action_detail"])
    assert detail["pending_edit_id"].startswith("pe-") and len(detail["pending_edit_id"]) == 15 and detail["original_created_by"] == "own"
    assert detail["changes"][0]["field"] == "access.developers"

    configs = frame(
        "dr_id string, config_json string, status string, validation_errors string, updated_at string, expiration_date string, description string, created_by string",
        ("1", '{"developers": ["a"]}', "provisioned", "x", None, "2026-01-01", "old", "own"), ("4", '{"developers": ["a"]}', "provisioned", "x", None, "2026-01-01", "old", "other"),
    )
    asked = edits.select("dr_id", F.col("new_json").alias("proposed_config_json"), F.col("created_by").alias("original_created_by"))
    changed, users = approvals.approve(configs, asked, F.lit("now"))
    assert rows(changed, "dr_id", "validation_errors", "updated_at", "expiration_date", "description") == [
        ("1", "[]", "now", "2026-05-05", None), ("4", "x", None, "2026-01-01", "old"),
    ]
    assert rows(users) == [("1", "dev", "grant", "b"), ("1", "dev", "revoke", "a")]
    assert ids(approvals.drifted(asked, configs)) == ["4"]


def test_pending(frame):
    audit = frame(
        "action string, action_detail string", ("CONFIG_EDIT_PENDING", '{"pending_edit_id": "x"}'), ("CONFIG_EDIT_PENDING", '{"pending_edit_id": "y"}'),
        ("CONFIG_EDIT_PENDING", '{"pending_edit_id": "z"}'), ("CONFIG_EDIT_PENDING", "broken"), ("CONFIG_EDIT_APPROVED", '{"pending_edit_id": "x"}'),
        ("CONFIG_EDIT_REJECTED", '{"pending_edit_id": "y"}'), ("CONFIG_EDIT_REJECTED", None),
    )
    assert rows(approvals.pending_edits(audit), "pending_edit_id") == [("z",)]
    assert approvals.find_pending(audit, "z").count() == 1 and approvals.find_pending(audit, "x").count() == 0


def test_lists_and_principals(frame):
    df = frame("o array<string>, a array<string>, r array<string>", (["x", "y"], ["b", "x"], ["y"]), (None, None, ["q"]))
    assert [r[0] for r in df.select(principals.edited_list(F.col("o"), F.col("a"), F.col("r"))).collect()] == [["b", "x"], []]
    plan = frame("dr_id string, principal string", ("1", "a"), ("1", "b"), ("1", "b"), ("2", "b"))
    known = frame("principal string", ("a",))
    assert rows(principals.grantable(plan, known)) == [("1", "a")] and rows(principals.unknown_principals(plan, known)) == [("1", "b"), ("2", "b")]


def document(**changes):
    body = {
        "dr_id": "DR-1042", "streams": [{"name": "s"}], "environments": {"dev": {"enabled": True}}, "data_revision": {"mode": "latest"},
        "access": {"developers": ["a@co.com"]}, "lifecycle": {"expiration_date": "2026-02-01"},
    }
    version = changes.pop("version", "1.0")
    return json.dumps({"version": version, "development_request": body | changes})


@pytest.mark.parametrize(
    "changes, want",
    [
        ({}, []),
        ({"version": "2"}, ["version"]), ({"dr_id": "X"}, ["dr_id"]), ({"streams": []}, ["streams"]), ({"streams": [{"name": ""}]}, ["streams"]),
        ({"additional_objects": ["a.b.c", "a. .c"]}, ["additional_objects"]), ({"additional_objects": []}, []),
        ({"environments": {"dev": {"enabled": True}, "qa": {"enabled": True}}}, ["access.qa_users"]),
        ({"environments": {"dev": {"enabled": True}, "qa": {"enabled": True}}, "access": {"developers": ["a"], "qa_users": ["q"]}}, []),
        ({"environments": {}}, ["environments.dev"]), ({"access": {"developers": []}}, ["access.developers"]), ({"access": {"developers": [" "]}}, ["access.developers"]),
        ({"data_revision": {"mode": "version"}}, ["data_revision.version"]), ({"data_revision": {"mode": "version", "version": -1}}, ["data_revision.version"]),
        ({"data_revision": {"mode": "timestamp"}}, ["data_revision.timestamp"]), ({"data_revision": {"mode": "timestamp", "timestamp": "2026-04-01T00:00:00Z"}}, []),
        ({"data_revision": {"mode": "timestamp", "timestamp": "not a date"}}, ["data_revision.timestamp"]), ({"data_revision": {"mode": "odd"}}, ["data_revision.mode"]),
        ({"lifecycle": {"expiration_date": "2026-01-01"}}, ["lifecycle.expiration_date"]), ({"lifecycle": {"expiration_date": "2026-04-01"}}, []),
        ({"lifecycle": {"expiration_date": "2026-04-02"}}, ["lifecycle.expiration_date"]), ({"lifecycle": {"expiration_date": "01/02/2026"}}, ["lifecycle.expiration_date"]),
        ({"lifecycle": {"expiration_date": "2026-02-01", "notification_days_before": -1}}, ["lifecycle.notification_days_before"]),
    ],
)
def test_validation(frame, changes, want):
    flat = documents.flat_requests(documents.parse_request_documents(frame("document string", (document(**changes),))))
    got = validate.validate_requests(flat, "2026-01-01").first()
    assert [e.split(":")[0] for e in got["errors"]] == want and got["config_status"] == ("invalid" if want else "valid")


@pytest.mark.parametrize("text, ok", [("2026-04-01", True), ("2026-04-01T10:30:00+02:00", True), ("2026-04-01 10:30", True), ("2026-04-01T24:00:00", False), ("2026-02-30T00:00:00Z", False), ("April", False)])
def test_iso_timestamps(frame, text, ok):
    assert frame("t string", (text,)).select(validate.is_iso_timestamp(F.col("t"))).first()[0] is ok


def test_notices_look_up_objects_of_due_requests_only(spark, frame, tmp_path, monkeypatch):
    state = StateTables(spark, str(tmp_path / "due"))
    state.create()
    one = "dr_id string, description string, status string, created_by string, expiration_date date"
    day = date(2026, 1, 4)
    state.append("requests", frame(one, *[(f"DR-{i}", "d", "ACTIVE", "a@co.com", day if i == 1 else date(2027, 1, 1)) for i in (1, 2)]), "2026-01-01 00:00:00")
    objects = frame("dr_id string, source_fqn string, target_environment string, status string", ("DR-1", "a", "dev", None), ("DR-1", "b", "dev", None), ("DR-2", "a", "dev", None))
    state.append("objects", objects, "2026-01-01 00:00:00")
    looked, whole = [], state.current

    def current(name, dr_ids=None):
        looked.append((name, None if dr_ids is None else sorted(r["dr_id"] for r in dr_ids.collect())))
        return whole(name, dr_ids)

    monkeypatch.setattr(state, "current", current)
    assert rows(runs.notify(state, "2026-01-01 00:00:00"), "dr_id", "total_objects") == [("DR-1", 2)]
    assert ("objects", ["DR-1"]) in looked and ("objects", None) not in looked
