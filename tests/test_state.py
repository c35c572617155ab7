"""Updates, deletes, time travel, retention, audit."""

from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sandboxlake import fixed
from sandboxlake.operators import asof, lifecycle, updates
from sandboxlake.plans import copy_plan
from sandboxlake.sources import commits, files
from sandboxlake.sources import state as state_module
from sandboxlake.sources.state import StateTables

LOG = "k string, v int, commit_version bigint, commit_ts timestamp_ntz, op string"


def day(n):
    return datetime(2026, 1, n)


@pytest.fixture
def log(frame):
    return frame(LOG, ("a", 1, 1, day(1), "upsert"), ("a", 2, 3, day(3), "upsert"), ("b", 1, 2, day(2), "upsert"), ("b", None, 4, day(4), "delete"), ("c", 9, 5, day(5), "upsert"))


def test_as_of(log):
    assert rows(asof.as_of(log, ["k"])) == [("a", 2), ("c", 9)]
    assert rows(asof.as_of(log, ["k"], version=3)) == [("a", 2), ("b", 1)]
    assert rows(asof.as_of(log, ["k"], timestamp="2026-01-01 12:00:00")) == [("a", 1)]
    assert rows(asof.as_of(log, ["k"], timestamp="2026-01-01T17:00:00+05:00")) == [("a", 1)]
    assert rows(asof.as_of(log, ["k"], version=0)) == []
    with pytest.raises(ValueError):
        asof.as_of(log, ["k"], version=1, timestamp="2026-01-01")


def test_snapshots(spark, frame, tmp_path):
    for v, n in ((1, 10), (4, 40)):
        frame("x int", (n,)).write.parquet(f"{tmp_path}/t/v={v}")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert rows(asof.snapshot_as_of(table, 3)) == [(10,)]
    assert rows(asof.snapshot_as_of(table, 9)) == [(40,)]
    plan = asof.snapshot_as_of(table, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(v" in plan


def test_overlay(frame, log):
    base = frame("k string, v int", ("a", 0), ("b", 0), ("z", 7))
    assert rows(asof.overlay(base, log, ["k"])) == [("a", 2), ("c", 9), ("z", 7)]


CHANGE = "dr_id string, current_status string, new_status string, seq int, at timestamp_ntz"


def test_compare_and_set(frame):
    state = frame("dr_id string, status string, at timestamp_ntz", ("1", "ACTIVE", None), ("2", "PROVISIONING", None), ("3", "FAILED", day(9)), ("4", "ACTIVE", None))
    changes = frame(
        CHANGE, ("1", "ACTIVE", "EXPIRED", 2, day(2)), ("1", "ACTIVE", "FAILED", 1, day(1)), ("2", "ACTIVE", "FAILED", 1, day(1)),
        ("3", "FAILED", "ACTIVE", 1, day(1)), ("5", "ACTIVE", "FAILED", 1, day(1)),
    )
    args = (state, changes, ["dr_id"], fixed.REQUEST_MOVES)
    assert rows(updates.compare_and_set(*args, {"at": "at"})) == [
        ("1", "FAILED", day(1)), ("2", "PROVISIONING", None), ("3", "FAILED", day(9)), ("4", "ACTIVE", None),
    ]
    assert rows(updates.compare_and_set(*args, {"at": "at"}, only_changed=True)) == [("1", "FAILED", day(1))]
    assert rows(updates.compare_and_set_outcomes(*args), "dr_id", "seq", "outcome") == [
        ("1", 1, "applied"), ("1", 2, "superseded"), ("2", 1, "status_differs"), ("3", 1, "illegal_move"), ("5", 1, "not_found"),
    ]


def test_moves_match_the_documented_relation(frame):
    pairs = [(a, b) for a in ("PROVISIONED", "REFRESH_PENDING", "FAILED", "DROPPED") for b in ("PROVISIONED", "REFRESH_PENDING", "FAILED", "DROPPED")]
    bad = rows(updates.illegal_moves(frame("current_status string, new_status string", *pairs), fixed.OBJECT_MOVES))
    assert len(bad) == 8 and ("DROPPED", "PROVISIONED") in bad and ("REFRESH_PENDING", "DROPPED") in bad and ("PROVISIONED", "PROVISIONED") in bad
    assert len(fixed.REQUEST_MOVES) == 14 and len(fixed.OBJECT_MOVES) == 8


def test_set_columns_and_deletes(frame):
    state = frame("k int, a string, b string", (1, "x", "x"), (2, "y", "y"), (3, "z", "z"))
    new = frame("k int, a string", (1, "n"), (2, None), (9, "q"))
    assert rows(updates.set_columns(state, new, ["k"], {"a": F.col("new_a")})) == [(1, "n", "x"), (2, None, "y"), (3, "z", "z")]
    assert rows(updates.set_columns(state, new, ["k"], {"a": F.col("new_a")}, F.col("new_a").isNotNull(), only_changed=True)) == [(1, "n", "x")]
    assert rows(updates.delete_matching(state, new, ["k"])) == [(3, "z", "z")]
    assert rows(updates.delete_matching(state, new, ["k"], F.col("b") == "y")) == [(1, "x", "x"), (3, "z", "z")]


def test_provisioned_configs_stay(frame):
    configs = frame("dr_id string, status string", ("1", "provisioned"), ("2", "valid"), ("3", None), ("4", "valid"))
    assert rows(updates.delete_configs(configs, frame("dr_id string", ("1",), ("2",), ("3",)))) == [("1", "provisioned"), ("4", "valid")]


def test_expiration_in_the_past_is_refused(frame):
    state = frame("dr_id string, expiration_date date, last_modified_at timestamp_ntz", ("1", date(2026, 1, 1), None), ("2", date(2026, 1, 1), None))
    changes = frame("dr_id string, expiration_date date, seq int", ("1", date(2026, 5, 5), 1), ("1", date(2026, 6, 6), 2), ("2", date(2025, 5, 5), 1))
    got = updates.change_expiration(state, changes, "2026-02-02", F.lit(day(2)).cast("timestamp_ntz"))
    assert rows(got) == [("1", date(2026, 6, 6), day(2)), ("2", date(2026, 1, 1), None)]


def test_retention(frame):
    history = frame("fqn string, version bigint, ts timestamp_ntz", ("t", 9, day(9)), ("t", 5, day(5)), ("u", 1, day(1)))
    asked = frame(
        "fqn string, rev_mode string, rev_version bigint, rev_ts timestamp_ntz", ("t", "version", 4, None), ("t", "version", 5, None),
        ("t", "timestamp", None, day(4)), ("t", "timestamp", None, day(5)), ("t", "latest", 1, None), ("none", "version", 0, None),
    )
    assert rows(commits.retention_violations(asked, history), "fqn", "rev_mode") == [("t", "timestamp"), ("t", "version")]


def test_state_tables(spark, frame, tmp_path):
    state = StateTables(spark, f"{tmp_path}/state")
    state.create()
    assert state.current("requests").count() == 0 and state.current("audit").count() == 0
    state.append("requests", frame("dr_id string, status string", ("1", "ACTIVE"), ("2", "ACTIVE")), "2026-01-01")
    state.append("requests", frame("dr_id string, status string", ("1", "EXPIRED")), "2026-01-02")
    state.append("requests", frame("dr_id string", ("2",)), "2026-01-03", "delete")
    assert rows(state.current("requests"), "dr_id", "status") == [("1", "EXPIRED")]
    assert rows(state.of_requests("requests", frame("dr_id string", ("2",)))) == []


def test_audit_store(spark, frame, tmp_path):
    state = StateTables(spark, f"{tmp_path}/state")
    state.create()
    audit = "log_id string, dr_id string, action string, performed_at timestamp_ntz"
    state.append_audit(frame(audit, ("x", "1", "A", datetime(2025, 1, 1)), (None, "1", "A", datetime(2026, 1, 9, 6)), ("y", "1", "B", datetime(2026, 1, 9, 18)), ("z", "1", "B", datetime(2026, 3, 1))))
    assert state.current("audit").filter("log_id IS NULL").count() == 0
    assert rows(state.audit_since("2026-02-01"), "log_id") == [("z",)]
    assert "PartitionFilters: [isnotnull(day" in state.audit_since("2026-02-01")._jdf.queryExecution().toString()
    state.purge_audit("2027-01-09 12:00:00", 365)
    assert rows(state.current("audit"), "log_id") == [("y",), ("z",)]
    state.purge_audit("2027-01-09 20:00:00", 365)
    assert rows(state.current("audit"), "log_id") == [("z",)]


@pytest.mark.parametrize("broken", ["write", "ready", "clear", "move"])
def test_an_interrupted_purge_loses_nothing(spark, frame, tmp_path, monkeypatch, broken):
    state = StateTables(spark, f"{tmp_path}/state")
    state.create()
    times = [datetime(2025, 1, 1), datetime(2026, 1, 9, 6), datetime(2026, 1, 9, 18), datetime(2026, 1, 9, 19), None, datetime(2026, 3, 1)]
    state.append_audit(frame("log_id string, performed_at timestamp_ntz", *[(str(i), t) for i, t in enumerate(times)]).repartition(4))

    class Dead(BaseException):
        pass

    calls = []

    def dying(name, at):
        real = getattr(state_module, name)

        def call(*args):
            calls.append(name)
            if calls.count(name) == at:
                raise Dead
            return real(*args)

        return call

    with monkeypatch.context() as patch:
        if broken == "write":
            patch.setattr(state_module, "audit_kept", dying("audit_kept", 1))
        elif broken == "ready":
            patch.setattr(state_module, "make_folder", dying("make_folder", 1))
        elif broken == "clear":
            patch.setattr(state_module, "make_folder", dying("make_folder", 2))
        else:
            patch.setattr(state_module, "move_into", dying("move_into", 1))
        with pytest.raises(Dead):
            state.purge_audit("2027-01-09 12:00:00", 365)
    kept = ["2", "3", "4", "5"]
    left = [r[0] for r in rows(state.current("audit"), "log_id")]
    assert left == (kept if broken in ("clear", "move") else ["1", *kept])
    state.purge_audit("2027-01-09 12:00:00", 365)
    assert [r[0] for r in rows(state.current("audit"), "log_id")] == kept


def test_versions_are_claimed_in_order(spark, frame, tmp_path):
    """The newest change wins whatever a clock says; a folder from before claims goes on from its newest row."""
    state = StateTables(spark, f"{tmp_path}/state")
    frame("dr_id string, status string, commit_version bigint, commit_ts timestamp_ntz, op string", ("1", "OLD", 7 * 10**18, None, "upsert")).write.parquet(f"{tmp_path}/state/requests")
    for text in ("ACTIVE", "EXPIRED"):
        state.append("requests", frame("dr_id string, status string", ("1", text)), "2026-01-01")
        assert rows(state.current("requests"), "status") == [(text,)]
    assert files.claim_next(spark, f"{tmp_path}/claims") == 1 and files.claim_next(spark, f"{tmp_path}/claims") == 2
    assert not files.claim(spark, f"{tmp_path}/claims", "2")


def test_a_lookup_reads_its_buckets(spark, frame, tmp_path, monkeypatch):
    state = StateTables(spark, f"{tmp_path}/state")
    state.create()
    state.append("requests", frame("dr_id string, status string", *[(f"DR-{i}", "ACTIVE") for i in range(200)]), "2026-01-01")
    state.append("requests", frame("dr_id string, status string", *[(f"DR-{i}", "EXPIRED") for i in range(0, 200, 7)]), "2026-01-02")
    state.append("requests", frame("dr_id string", ("DR-3",), ("DR-14",)), "2026-01-03", "delete")
    want = rows(state.current("requests"))
    assert state.compact("requests", 8) == state.compact("requests", 8)
    assert rows(state.current("requests")) == want and len(want) == 198
    asked = frame("dr_id string", ("DR-7",), ("DR-3",), ("DR-nowhere",))
    found = state.of_requests("requests", asked)
    assert rows(found, "dr_id", "status") == [("DR-7", "EXPIRED")]
    read = {part for f in found.inputFiles() for part in f.split("/") if part.startswith("bucket=")}
    assert 1 <= len(read) <= 3 and len({p.name for p in (tmp_path / "state").rglob("bucket=*")}) == 8
    # a run that breaks off before the old files are gone: deleted rows stay deleted
    state.append("requests", frame("dr_id string", ("DR-7",)), "2026-01-04", "delete")
    with monkeypatch.context() as patch:
        patch.setattr(state_module, "remove_folder", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            state.compact("requests", 4)
    assert rows(state.current("requests")) == [r for r in want if r[0] != "DR-7"]
    state.append("requests", frame("dr_id string, status string", ("DR-7", "ACTIVE")), "2026-01-05")
    state.compact("requests", 4)
    assert state.current("requests").count() == 198 and rows(state.of_requests("requests", asked), "status") == [("ACTIVE",)]
    with pytest.raises(ValueError):
        state.compact("audit")


def test_compaction_moves_rows_once(spark, frame, tmp_path, monkeypatch):
    """One shuffle by bucket and cell; a table that is its generation alone is read without another one."""
    state = StateTables(spark, f"{tmp_path}/state")
    state.create()
    schema = "dr_id string, source_fqn string, target_environment string, status string"
    state.append("objects", frame(schema, *[(f"DR-{i % 9}", f"t{i}", "dev", "A") for i in range(300)], (None, "t", None, "A")), "2026-01-01")
    state.append("objects", frame(schema, *[(f"DR-{i % 9}", f"t{i}", "dev", "B") for i in range(0, 300, 5)]), "2026-01-02")
    state.append("objects", frame(schema, ("DR-1", "t1", "dev", None)), "2026-01-03", "delete")
    want = rows(state.current("objects"))
    plans, real = [], state_module.as_of

    def watched(log, keys, **more):
        plans.append(real(log, keys, **more))
        return plans[-1]

    with monkeypatch.context() as patch:
        patch.setattr(state_module, "as_of", watched)
        state.compact("objects", 4)
    assert plans[0]._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert rows(state.current("objects")) == want and len(want) == 300
    assert "Exchange" not in state.current("objects")._jdf.queryExecution().executedPlan().toString()
    files_of = {p.parent.name for p in (tmp_path / "state").rglob("bucket=*/*.parquet")}
    assert files_of == {f"bucket={b}" for b in range(4)}
    for path in (tmp_path / "state" / "objects").rglob("bucket=*/*.parquet"):
        ids = [r.dr_id or "" for r in spark.read.parquet(str(path)).coalesce(1).collect()]
        assert ids == sorted(ids)
    state.append("objects", frame(schema, ("DR-1", "t1", "dev", "C")), "2026-01-04")
    assert rows(state.current("objects").filter("status = 'C'"), "source_fqn") == [("t1",)] and state.current("objects").count() == 301


def test_ranges_of_the_stored_counter(spark, frame, tmp_path, monkeypatch):
    state = StateTables(spark, f"{tmp_path}/state")
    state.create()
    assert [copy_plan.lease_range(state, p, n, "2026-01-01") for p, n in (("DR", 5), ("DR", 1), ("AB", 2), ("DR", 3))] == [0, 5, 0, 6]
    with monkeypatch.context() as patch:  # a caller that breaks off between its claim and storing the value
        patch.setattr(StateTables, "append", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            copy_plan.lease_range(state, "DR", 10, "2026-01-02")
    assert copy_plan.lease_range(state, "DR", 1, "2026-01-03") == 19
    assert rows(state.current("counters"), "prefix", "last_value") == [("AB", 2), ("DR", 20)]
    with ThreadPoolExecutor(4) as pool:
        got = sorted(pool.map(lambda n: (copy_plan.lease_range(state, "QX", n, "2026-01-04"), n), [1, 2, 3, 4]))
    ends = [first + n for first, n in got]
    assert [first for first, _ in got] == [0, *ends[:-1]] and ends[-1] == 10  # no overlap, no gap
    with pytest.raises(ValueError):
        copy_plan.lease_range(state, "../x", 1, "2026-01-01")


def test_audit_lists(frame):
    audit = frame("log_id string, dr_id string, action string, performed_at timestamp_ntz, status string", *[(f"l{i}", "1" if i < 7 else "2", "A", day(1 + i // 2), "S") for i in range(10)])
    assert rows(lifecycle.recent_audit(audit, 2), "dr_id", "rank", "log_id") == [("1", 1, "l6"), ("1", 2, "l4"), ("2", 1, "l8"), ("2", 2, "l9")]
    assert [r.log_id for r in lifecycle.audit_of_request(audit, "2", 2).collect()] == ["l8", "l9"]
    assert [r.log_id for r in lifecycle.audit_by_action(audit, "A").limit(3).collect()] == ["l8", "l9", "l6"]
