"""Submitting and deciding config edits against stored state."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sandboxlake.operators import approvals
from sandboxlake.plans import edits
from sandboxlake.sources.state import StateTables

NOW = "2026-01-01 10:00:00"


def form(**changes):
    return json.dumps({"dr_id": "DR-1", "streams": ["s"], "developers": ["a"], "expiration_date": "2026-02-01"} | changes)


@pytest.fixture
def state(spark, frame, tmp_path):
    state = StateTables(spark, f"{tmp_path}/state")
    state.create()
    state.append("configs", frame(
        "dr_id string, config_json string, status string, created_by string",
        ("DR-1", form(), "provisioned", "own"), ("DR-2", form(), "scanned", "own"), ("DR-3", form(), "provisioned", "own"),
    ), "2026-01-01")
    state.append("objects", frame(
        "dr_id string, source_fqn string, target_fqn string, target_environment string, status string",
        ("DR-1", "p.s.t", "d.dr_1_s.t", "dev", "PROVISIONED"), ("DR-1", "p.x.t", "d.dr_1_x.t", "dev", "DROPPED"),
    ), "2026-01-01")
    return state


def submit(state, frame, *items, now=NOW):
    return rows(edits.submit_edits(state, frame("dr_id string, new_json string, requester string", *[(d, j, "me") for d, j in items]), now))


def pending(state):
    return {r.dr_id: r.pending_edit_id for r in approvals.pending_edits(state.current("audit")).collect()}


def decide(state, frame, *items):
    done = edits.decide_edits(state, frame("pending_edit_id string, decision string, reason string", *[(*i, None) for i in items]), "2026-01-02 10:00:00", "admin")
    return rows(done.outcomes, "dr_id", "outcome"), rows(done.statements, "statement")


def test_submit(state, frame):
    got = submit(state, frame, ("DR-1", form(developers=["a", "b"])), ("DR-2", form(expiration_date="2027-01-01")), ("DR-3", form(description="new")))
    assert got == [("DR-1", "pending_review"), ("DR-2", "applied"), ("DR-3", "applied")]
    assert rows(state.current("configs"), "dr_id", "status", "validation_errors", "description") == [
        ("DR-1", "provisioned", None, None), ("DR-2", "invalid", '["lifecycle.expiration_date: too far ahead"]', None), ("DR-3", "provisioned", "[]", "new"),
    ]
    assert list(pending(state)) == ["DR-1"]


def test_approve_and_reject(state, frame):
    submit(state, frame, ("DR-1", form(developers=["b"])), ("DR-3", form(developers=["b"])))
    ids = pending(state)
    outcomes, statements = decide(state, frame, (ids["DR-1"], "approve"), (ids["DR-3"], "reject"), ("pe-none", "approve"))
    assert outcomes == [("DR-1", "approved"), ("DR-3", "rejected"), (None, "not_found")]
    assert statements == [
        ("GRANT SELECT, MODIFY ON SCHEMA d.dr_1_s TO `b`",), ("GRANT USAGE ON SCHEMA d.dr_1_s TO `b`",), ("REVOKE ALL PRIVILEGES ON SCHEMA d.dr_1_s FROM `a`",),
    ]
    assert rows(state.current("access"), "dr_id", "user_email", "environment") == [("DR-1", "b", "dev")]
    now = {r.dr_id: json.loads(r.config_json)["developers"] for r in state.current("configs").collect()}
    assert now["DR-1"] == ["b"] and now["DR-3"] == ["a"] and pending(state) == {}
    assert decide(state, frame, (ids["DR-1"], "approve"))[0] == [(None, "not_found")]


def test_config_that_changed_hands(state, frame):
    submit(state, frame, ("DR-1", form(developers=["b"])))
    moved = state.current("configs").filter("dr_id = 'DR-1'").withColumn("created_by", F.lit("other"))
    state.append("configs", moved, NOW)
    assert decide(state, frame, (pending(state)["DR-1"], "approve"))[0] == [("DR-1", "owner_changed")]
    assert list(pending(state)) == ["DR-1"]


def test_latest_approved_edit_remains(state, frame):
    submit(state, frame, ("DR-1", form(developers=["b"])), now="2026-01-01 10:00:00")
    first = pending(state)["DR-1"]
    submit(state, frame, ("DR-1", form(developers=["c"])), now="2026-01-01 11:00:00")
    both = [r.pending_edit_id for r in approvals.pending_edits(state.current("audit")).collect()]
    assert first in both and len(both) == 2
    outcomes, statements = decide(state, frame, *[(i, "approve") for i in both])
    assert outcomes == [("DR-1", "approved")] * 2
    assert json.loads(state.current("configs").filter("dr_id = 'DR-1'").first()["config_json"])["developers"] == ["c"]
    assert not any("`b`" in s[0] for s in statements)


def test_configs_are_looked_up_once_per_step(state, frame, monkeypatch):
    """What is stored stays with the edit, so the log of configs is not folded again for each thing told of it."""
    seen, real = [], StateTables._write

    def watched(self, name, new):
        if name == "configs":
            seen.append(new._jdf.queryExecution().executedPlan().toString())
        return real(self, name, new)

    monkeypatch.setattr(StateTables, "_write", watched)
    submit(state, frame, ("DR-1", form(developers=["b"])), ("DR-2", form(description="new")))
    decide(state, frame, (pending(state)["DR-1"], "approve"))
    assert len(seen) == 2 and not any("Window" in plan or "Join" in plan for plan in seen)
    now = {r.dr_id: r for r in state.current("configs").collect()}
    assert json.loads(now["DR-1"].config_json)["developers"] == ["b"] and now["DR-1"].created_by == "own" and now["DR-1"].status == "provisioned"
    assert (now["DR-2"].description, now["DR-2"].status, now["DR-2"].created_by) == ("new", "valid", "own")
    assert json.loads(now["DR-3"].config_json) == json.loads(form()) and now["DR-3"].updated_at is None
