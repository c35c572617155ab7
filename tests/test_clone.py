"""Copies and runs against real tables in a sandbox."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from conftest import rows
from sandboxlake.plans import clone, runs
from sandboxlake.plans.clone import CloneError, Sandbox
from sandboxlake.sources.state import StateTables

LOG = "k string, v int, commit_version bigint, commit_ts timestamp_ntz, op string"
T = "dev_main.out."


@pytest.fixture
def box(spark, tmp_path):
    box = Sandbox(spark, str(tmp_path), f"t{abs(hash(str(tmp_path)))}__", max_parallel=3)
    spark.range(10).select("id", (F.col("id") % 2).alias("part")).write.partitionBy("part").parquet(f"{tmp_path}/src")
    spark.range(5).write.parquet(f"{tmp_path}/plain")
    clone.register_source(box, "prod_main.s.plain", f"{tmp_path}/plain")
    clone.create_schema(box, "prod_main.s")
    spark.sql(f"CREATE TABLE {box.table_name('prod_main.s.parts')} (id bigint, part bigint) USING parquet PARTITIONED BY (part) LOCATION '{tmp_path}/src'")
    spark.catalog.recoverPartitions(box.table_name("prod_main.s.parts"))
    clone.create_schema(box, "dev_main.out")
    return box


def table(box, fqn):
    return box.spark.table(box.table_name(fqn))


def grow(box, tmp_path):
    box.spark.range(100, 103).write.mode("append").parquet(f"{tmp_path}/plain")
    box.spark.catalog.refreshTable(box.table_name("prod_main.s.plain"))


def test_deep_clone_keeps_partitions_and_stands_alone(box, tmp_path):
    clone.deep_clone(box, "prod_main.s.parts", T + "p")
    clone.deep_clone(box, "prod_main.s.plain", T + "q")
    grow(box, tmp_path)
    assert table(box, T + "p").count() == 10 and table(box, T + "q").count() == 5
    assert [c.name for c in box.spark.catalog.listColumns(box.table_name(T + "p")) if c.isPartition] == ["part"]


def test_shallow_clone_is_pinned_and_view_is_not(box, tmp_path):
    clone.shallow_clone(box, "prod_main.s.plain", T + "s")
    clone.view_clone(box, "prod_main.s.plain", T + "v")
    assert clone.pin_is_whole(box, T + "s")
    grow(box, tmp_path)
    assert table(box, T + "s").count() == 5 and table(box, T + "v").count() == 8
    clone.shallow_clone(box, "prod_main.s.plain", T + "s")
    assert table(box, T + "s").count() == 8
    for old in (tmp_path / "plain").glob("part-*"):
        old.unlink()
    box.spark.catalog.refreshTable(box.table_name("prod_main.s.plain"))
    assert not clone.pin_is_whole(box, T + "s")


def test_broken_pins_are_outcomes(box, frame, tmp_path):
    for name in ("plain", "parts"):
        clone.shallow_clone(box, f"prod_main.s.{name}", T + name)
    columns = "source_fqn string, target_fqn string, clone_strategy string, status string"
    objects = frame(columns, *[(f"prod_main.s.{n}", T + n, "shallow_clone", "PROVISIONED") for n in ("plain", "parts")], ("x", "y", "view", "PROVISIONED"))
    assert rows(clone.check_pins(box, objects), "target_fqn", "success") == [(T + "parts", True), (T + "plain", True)]
    box.spark.range(3).write.mode("overwrite").parquet(f"{tmp_path}/plain")
    box.spark.catalog.refreshTable(box.table_name("prod_main.s.plain"))
    assert rows(clone.check_pins(box, objects), "target_fqn", "success") == [(T + "parts", True), (T + "plain", False)]


def test_revisions(box, frame, tmp_path):
    frame(LOG, ("a", 1, 1, None, "upsert"), ("a", 2, 2, None, "upsert"), ("b", 5, 3, None, "upsert"), ("a", None, 4, None, "delete")).withColumn(
        "commit_ts", F.expr("timestamp_ntz'2026-01-01' + make_dt_interval(cast(commit_version as int))")
    ).write.parquet(f"{tmp_path}/log")
    clone.register_source(box, "prod_main.s.log", f"{tmp_path}/log", "k")
    for name, mode, value, want in (
        ("l", "latest", None, [("b", 5)]), ("v", "version", "3", [("a", 2), ("b", 5)]), ("t", "timestamp", "2026-01-02T12:00:00Z", [("a", 1)]),
    ):
        clone.deep_clone(box, "prod_main.s.log", T + "d" + name, mode, value)
        clone.view_clone(box, "prod_main.s.log", T + "w" + name, mode, value)
        clone.shallow_clone(box, "prod_main.s.log", T + "s" + name, mode, value)
        assert rows(table(box, T + "d" + name)) == rows(table(box, T + "w" + name)) == rows(table(box, T + "s" + name)) == want
    with pytest.raises(CloneError):
        clone.source_query(box, "prod_main.s.log", "odd", "1")
    with pytest.raises(Exception):  # a plain table has no versions
        clone.deep_clone(box, "prod_main.s.plain", T + "x", "version", "1")


@pytest.mark.parametrize("bad", ["a.b", "a.b.c.d", "a.b.c;drop", "a.b.`c`", "a..c"])
def test_unsafe_names(box, bad):
    with pytest.raises(CloneError):
        box.table_name(bad)


def test_outcomes_keep_order_and_errors_stay_apart(box):
    plan = box.spark.createDataFrame(
        [("d", "prod_main.s.plain", f"{T}o{i}", "dev", "no_such" if i % 3 == 1 else "deep_clone", "latest", None) for i in range(8)],
        "dr_id string, source_fqn string, target_fqn string, target_environment string, clone_strategy string, clone_revision_mode string, clone_revision_value string",
    ).coalesce(1)
    done = clone.clone_all(box, plan)
    got = rows(done, "task_no", "target_fqn", "success")
    assert got == [(i, f"{T}o{i}", i % 3 != 1) for i in range(8)]
    assert "unknown clone strategy" in done.filter("NOT success").first()["error"]
    again = clone.clone_all(box, plan.limit(1))
    assert "already exists" in again.first()["error"]
    assert clone.clone_all(box, plan.limit(0)).count() == 0


def test_drop_removes_the_data(box, tmp_path):
    clone.deep_clone(box, "prod_main.s.plain", T + "gone")
    assert list((tmp_path / "data").rglob("*.parquet"))
    clone.drop_object(box, T + "gone")
    clone.drop_object(box, T + "gone")
    assert not list((tmp_path / "data").rglob("*.parquet")) and list((tmp_path / "plain").glob("*.parquet"))


@pytest.fixture
def state(spark, tmp_path):
    state = StateTables(spark, f"{tmp_path}/state")
    state.create()
    return state


NOW = "2026-01-01 00:00:00"


def request(frame, dr="DR-5", expires="2026-02-01"):
    return frame(
        "dr_id string, description string, config_json string, qa_enabled boolean, target_catalog string, rev_mode string, rev_version bigint, "
        "rev_timestamp string, developers array<string>, qa_users array<string>, day string",
        (dr, "x", "{}", False, None, "latest", None, None, ["ann", "zed"], None, expires),
    ).withColumn("expiration_date", F.col("day").cast("date"))


def manifest(frame, *items, dr="DR-5"):
    return frame("dr_id string, fqn string, object_type string, access_mode string, clone_strategy string, estimated_size_gb double", *[(dr, *i, None) for i in items])


HEADER = "dr_id string, review_required boolean"
PLAIN = ("prod_main.s.plain", "table", "READ_ONLY", "deep_clone")
MISSING = ("prod_main.s.missing", "table", "READ_ONLY", "deep_clone")


def provision(box, state, frame, *items, **more):
    return runs.provision(box, state, request(frame), manifest(frame, *items), frame(HEADER, ("DR-5", True)), NOW, **more)


def status(state):
    return state.current("requests").first()["status"]


def test_life_of_a_request(box, state, frame, tmp_path):
    known = frame("principal string", ("ann",))
    run = provision(box, state, frame, PLAIN, MISSING, known=known)
    assert rows(run.status, "final_status", "audit_status", "succeeded", "failed") == [("ACTIVE", "PARTIAL_SUCCESS", 1, 1)]
    assert rows(state.current("objects"), "source_fqn", "status") == [("prod_main.s.missing", "FAILED"), ("prod_main.s.plain", "PROVISIONED")]
    assert rows(run.unknown, "principal") == [("zed",)] and run.grants.count() == 2
    assert rows(state.current("access"), "user_email", "environment") == [("ann", "dev"), ("zed", "dev")]
    target = "dev_main.dr_5_s.plain"
    assert table(box, target).count() == 5

    again = provision(box, state, frame, PLAIN)  # live, and a review is due
    assert rows(again.rejected) == [("DR-5",)] and again.status.count() == 0

    grow(box, tmp_path)
    asked = ("source_fqn", "clone_revision_mode", "clone_revision_value")
    before = rows(state.current("objects"), *asked)
    fresh = runs.refresh(box, state, request(frame), "incremental", "2026-01-02 00:00:00")
    assert rows(state.current("objects"), *asked) == before
    assert rows(fresh.status, "audit_status", "succeeded", "failed") == [("PARTIAL_SUCCESS", 1, 1)] and table(box, target).count() == 8
    late = runs.refresh(box, state, request(frame), "full", "2026-03-02 00:00:00")
    assert rows(late.rejected) == [("DR-5", "expired")]
    empty = runs.refresh(box, state, request(frame), "selective", "2026-01-02 00:00:00")
    assert rows(empty.status, "audit_status") == [("SUCCESS",)]

    changed = runs.modify(
        box, state, NOW, removals=frame("dr_id string, source_fqn string", ("DR-5", "prod_main.s.missing")),
        users=frame("dr_id string, environment string, action string, principal string", ("DR-5", "dev", "grant", "bob"), ("DR-5", "dev", "revoke", "zed")),
    )
    assert rows(changed.status, "audit_status") == [("SUCCESS",)]
    assert rows(state.current("access"), "user_email") == [("ann",), ("bob",)]
    assert rows(changed.revokes, "statement") == [("REVOKE ALL PRIVILEGES ON SCHEMA dev_main.dr_5_s FROM `zed`",)]

    gone = runs.clean_up(box, state, request(frame), "2026-02-02 00:00:00")
    assert rows(gone.status, "final_status", "audit_status") == [("CLEANED_UP", "SUCCESS")] and status(state) == "CLEANED_UP"
    assert {r[0] for r in rows(state.current("objects"), "status")} == {"DROPPED"}
    assert not box.spark.catalog.tableExists(box.table_name(target))
    refused = runs.clean_up(box, state, request(frame), "2026-02-03 00:00:00")
    assert rows(refused.rejected) == [("DR-5", "CLEANED_UP")]
    actions = rows(state.current("audit").groupBy("action").count())
    assert actions == [("CLEANUP", 2), ("MODIFY", 1), ("PROVISION", 2), ("REFRESH", 2)]


def test_all_failed(box, state, frame):
    run = provision(box, state, frame, MISSING)
    assert rows(run.status, "final_status", "audit_status") == [("FAILED", "FAILED")] and status(state) == "FAILED"
    errors = state.current("audit").filter("error_message IS NOT NULL").first()
    assert errors["error_message"] == '{"failed_objects":["prod_main.s.missing"]}'


def test_force_replaces_stale_rows(box, state, frame, tmp_path):
    provision(box, state, frame, PLAIN, MISSING)
    started = state.current("requests").first()["created_at"]
    grow(box, tmp_path)
    run = runs.provision(
        box, state, request(frame, expires="2026-03-01"), manifest(frame, PLAIN), frame(HEADER, ("DR-5", True)), "2026-01-05 00:00:00", force=True
    )
    assert rows(run.status, "final_status") == [("ACTIVE",)]
    assert rows(state.current("objects"), "source_fqn", "status") == [("prod_main.s.plain", "PROVISIONED")]
    assert table(box, "dev_main.dr_5_s.plain").count() == 8
    again = state.current("requests").first()
    assert again["created_at"] == started and str(again["expiration_date"]) == "2026-03-01"


def test_targets_of_others_are_not_replaced(box, state, frame):
    clone.create_schema(box, "dev_main.dr_5_s")
    clone.deep_clone(box, "prod_main.s.plain", "dev_main.dr_5_s.plain")
    run = provision(box, state, frame, PLAIN)
    assert rows(run.status, "final_status") == [("FAILED",)]
    assert "already exists" in run.outcomes.filter("NOT success").first()["error"]


def test_a_failed_full_refresh_keeps_the_copy(box, state, frame, tmp_path):
    provision(box, state, frame, PLAIN)
    box.spark.sql(f"ALTER TABLE {box.table_name('prod_main.s.plain')} RENAME TO {box.table_name('prod_main.s.away')}")
    run = runs.refresh(box, state, request(frame), "full", "2026-01-02 00:00:00")
    assert rows(run.status, "audit_status") == [("FAILED",)]
    assert rows(state.current("objects"), "status") == [("FAILED",)]
    assert table(box, "dev_main.dr_5_s.plain").count() == 5
    box.spark.sql(f"ALTER TABLE {box.table_name('prod_main.s.away')} RENAME TO {box.table_name('prod_main.s.plain')}")
    grow(box, tmp_path)
    runs.refresh(box, state, request(frame), "full", "2026-01-03 00:00:00")
    assert rows(state.current("objects"), "status") == [("PROVISIONED",)] and table(box, "dev_main.dr_5_s.plain").count() == 8


def names_in(box, schema="dev_main.out"):
    return sorted(t.name for t in box.spark.catalog.listTables(box.schema_name(schema)))


@pytest.mark.parametrize("strategy", ["deep_clone", "view", "shallow_clone", "schema_only"])
@pytest.mark.parametrize("broken", ["copy", "mark", "retire", "place"])
def test_a_replacement_that_breaks_off_is_ended_or_undone(box, tmp_path, monkeypatch, strategy, broken):
    """A run that dies in any step; the next one ends with one whole copy of the target and nothing beside it."""
    row = Row(source_fqn="prod_main.s.plain", target_fqn=T + "r", clone_strategy=strategy, clone_revision_mode="latest", clone_revision_value=None, replaces=True)
    clone.clone_object(box, row)
    old = table(box, T + "r").count()
    grow(box, tmp_path)
    new = 0 if strategy == "schema_only" else 8
    if strategy == "view":
        old = 8

    class Dead(BaseException):
        pass

    real, calls = clone._rename, []

    def rename(*args):
        calls.append(args)
        if (broken, len(calls)) in (("retire", 1), ("place", 2)):
            raise Dead
        real(*args)

    def die(*args):
        raise Dead

    with monkeypatch.context() as patch:
        patch.setattr(clone, "_rename", rename)
        if broken == "copy":
            patch.setitem(clone._CLONES, strategy, lambda box, source, target, *more: (box.spark.range(1).write.saveAsTable(box.table_name(target)), die()))
        if broken == "mark":
            patch.setattr(clone, "_swap_in", die)
        with pytest.raises(Dead):
            clone.clone_object(box, row)
    if broken != "place":
        assert table(box, T + "r").count() == old  # the old copy is still there
    clone.end_swap(box, T + "r")
    assert names_in(box) == ["r"] and table(box, T + "r").count() == (old if broken in ("copy", "mark") else new)
    clone.clone_object(box, row)
    assert names_in(box) == ["r"] and table(box, T + "r").count() == new
    clone.drop_object(box, T + "r")
    assert names_in(box) == [] and not list((tmp_path / "data").rglob("*.parquet"))


def test_partitioned_targets_are_replaced_whole(box, tmp_path):
    clone.deep_clone(box, "prod_main.s.parts", T + "p")
    clone.deep_clone(box, "prod_main.s.parts", T + "p")
    assert names_in(box) == ["p"] and table(box, T + "p").count() == 10
    assert [c.name for c in box.spark.catalog.listColumns(box.table_name(T + "p")) if c.isPartition] == ["part"]


def test_writing_to_a_shallow_clone(box, frame, tmp_path):
    keyed = frame("k int, v string", (1, "a"), (2, "b"), (None, "n"))
    keyed.write.parquet(f"{tmp_path}/keyed")
    clone.register_source(box, "prod_main.s.keyed", f"{tmp_path}/keyed", row_keys="k")
    clone.shallow_clone(box, "prod_main.s.keyed", T + "w")
    assert clone.write_clone(box, T + "w", frame("v string, k bigint", ("c", 3), ("A", 1), ("N", None))) == 1
    assert clone.write_clone(box, T + "w", frame("k int", (2,)), "delete") == 2
    assert clone.write_clone(box, T + "w", frame("k int, v string", (2, "again"))) == 3
    clone.write_clone(box, T + "w", frame("k int", (3,)), "delete")
    assert rows(table(box, T + "w")) == [(1, "A"), (2, "again"), (None, "N")]
    assert table(box, "prod_main.s.keyed").count() == 3 and clone.pin_is_whole(box, T + "w")
    for bad, op in ((frame("k int", (1,)), "upsert"), (frame("v string", ("x",)), "delete"), (frame("k int", (1,)), "merge")):
        with pytest.raises(CloneError):
            clone.write_clone(box, T + "w", bad, op)
    clone.shallow_clone(box, "prod_main.s.keyed", T + "w")  # made anew, without the changes
    assert table(box, T + "w").count() == 3 and len([p for p in (tmp_path / "data").rglob("*") if p.suffix == ".parquet"]) == 1


def test_a_source_without_keys_can_only_be_added_to(box, frame):
    clone.shallow_clone(box, "prod_main.s.plain", T + "a")
    clone.write_clone(box, T + "a", frame("id bigint", (77,)))
    assert table(box, T + "a").count() == 6
    with pytest.raises(CloneError):
        clone.write_clone(box, T + "a", frame("id bigint", (77,)), "delete")
    clone.deep_clone(box, "prod_main.s.plain", T + "d")
    with pytest.raises(CloneError):
        clone.write_clone(box, T + "d", frame("id bigint", (77,)))


def test_files_of_the_same_moment_fall_outside_the_pin(box, tmp_path):
    """Files written right after the clone; no row is read to make the pin."""
    for i in range(5):
        clone.shallow_clone(box, "prod_main.s.plain", f"{T}now{i}")
        have = 5 + i
        (tmp_path / "plain" / f"more{i}.parquet").write_bytes(next((tmp_path / "plain").glob("part-*.parquet")).read_bytes())
        box.spark.catalog.refreshTable(box.table_name("prod_main.s.plain"))
        assert table(box, f"{T}now{i}").count() >= 5 and clone.pin_is_whole(box, f"{T}now{i}"), have


def test_cleaning_one_request_up_leaves_others_alone(box, state, frame):
    both = request(frame).unionByName(request(frame, "DR005")).unionByName(request(frame, "DS005"))
    objects = manifest(frame, PLAIN).unionByName(manifest(frame, PLAIN, dr="DR005")).unionByName(manifest(frame, PLAIN, dr="DS005"))
    runs.provision(box, state, both, objects, frame(HEADER, *[(d, False) for d in ("DR-5", "DR005", "DS005")]), NOW)
    runs.clean_up(box, state, request(frame, "DR005"), "2026-02-02 00:00:00")
    assert rows(state.current("objects"), "dr_id", "status") == [("DR-5", "PROVISIONED"), ("DR005", "DROPPED"), ("DS005", "PROVISIONED")]
    assert table(box, "dev_main.dr_5_s.plain").count() == table(box, "dev_main.dr_ds005_s.plain").count() == 5


def test_the_daily_cleanup_takes_what_is_due_or_left_over(box, state, frame):
    requests = request(frame).unionByName(request(frame, "DR-6", "2026-04-01"))
    objects = manifest(frame, PLAIN).unionByName(manifest(frame, PLAIN, dr="DR-6"))
    runs.provision(box, state, requests, objects, frame(HEADER, ("DR-5", False), ("DR-6", False)), NOW)
    run = runs.clean_up_expired(box, state, "2026-02-01 08:00:00")
    assert rows(run.status, "dr_id", "final_status") == [("DR-5", "CLEANED_UP")]
    assert runs.clean_up_expired(box, state, "2026-02-01 09:00:00").status.count() == 0
    assert rows(state.current("requests"), "dr_id", "status") == [("DR-5", "CLEANED_UP"), ("DR-6", "ACTIVE")]


def test_joined_schema_names_do_not_meet(box):
    names = ["a__b.c", "a.b__c", "a_._b", "a.__b", "a__._b", "a_.__b", "a__.b", "a.b", "a.b__1", "a__b__1.c", "a__b.c__4", "a___b.c"]
    assert len({box.schema_name(n) for n in names}) == len(names)


def test_notices(box, state, frame):
    provision(box, state, frame, PLAIN)
    sent = "dr_id string, success boolean, error string"
    assert runs.notify(state, "2026-01-10 00:00:00").count() == 0
    due = runs.notify(state, "2026-01-28 00:00:00")
    assert rows(due, "dr_id", "total_objects", "recipients") == [("DR-5", 1, ["ann"])]
    assert runs.notify(state, "2026-01-28 00:59:00").count() == 0  # leased
    assert runs.notify(state, "2026-01-28 01:00:00").count() == 1  # the lease has run out
    assert state.current("requests").first()["notification_sent_at"] is None
    failed = runs.confirm_notices(state, frame(sent, ("DR-5", False, "no answer"), ("DR-9", True, None)), "2026-01-28 01:01:00")
    assert rows(failed, "dr_id", "status", "attempts", "error") == [("DR-5", "FAILED", 2, "no answer")]
    assert runs.confirm_notices(state, frame(sent, ("DR-5", True, None)), "2026-01-28 01:02:00").count() == 0  # not leased
    assert runs.notify(state, "2026-01-28 01:03:00").count() == 1
    runs.confirm_notices(state, frame(sent, ("DR-5", True, None)), "2026-01-28 01:04:00")
    assert runs.notify(state, "2026-01-29 00:00:00").count() == 0
    told = state.current("audit").filter("action = 'NOTIFY'").collect()
    assert [r["action_detail"] for r in told] == ['{"recipients":["ann"],"object_count":1,"expiration_date":"2026-02-01"}']
    provision(box, state, frame, PLAIN, force=True)  # the same end: no second notice
    assert runs.notify(state, "2026-01-30 00:00:00").count() == 0


def test_modify_needs_something_to_do(box, state):
    with pytest.raises(ValueError):
        runs.modify(box, state, NOW)
