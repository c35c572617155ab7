"""Names of targets, ids and plans."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sandboxlake.functions import checks, names
from sandboxlake.plans import copy_plan as plans


def one(frame, make, **values):
    df = frame(", ".join(f"{k} string" for k in values), tuple(values.values()))
    return df.select(make(*[F.col(k) for k in values])).first()[0]


@pytest.mark.parametrize("dr, want", [("DR-1042", "1042"), ("DR00042", "00042"), ("AB1", None), ("x-1", None), ("DR-", None)])
def test_request_number(frame, dr, want):
    assert one(frame, names.request_number, d=dr) == want


@pytest.mark.parametrize(
    "catalog, env, override, want",
    [
        ("prod_sales", "dev", None, "dev_sales"), ("prod_sales", "qa", None, "dev_sales"), ("production", "dev", None, "devuction"),
        ("raw", "qa", None, "raw_qa"), ("prod_prod_x", "dev", None, "dev_prod_x"), ("prod_sales", "dev", "box", "box"), ("raw", "dev", "  ", "raw_dev"),
    ],
)
def test_target_catalog(frame, catalog, env, override, want):
    assert one(frame, names.target_catalog, c=catalog, e=env, o=override) == want


def test_target_names(frame):
    assert one(frame, names.target_object, f="prod_a.s.t", d="DR-7", e="qa") == "dev_a.qa_7_s.t"
    assert one(frame, names.target_object, f="a.b", d="DR-7", e="dev") is None
    assert one(frame, names.target_object, f="a.b.c.d", d="DR-7", e="dev") is None
    assert one(frame, names.target_object, f="a.b.c", d="DR-7", e="prod") is None
    assert one(frame, names.target_schema, f="raw.s", d="DR00012", e="dev") == "raw_dev.dr_dr00012_s"
    assert one(frame, names.target_schema, f="raw", d="DR-1", e="dev") is None


def test_every_id_has_a_name_of_its_own(frame):
    """Also where names are compared without case, and whatever schema follows."""
    ids = ["DR-001", "DR001", "AB001", "CD001", "Ab001", "aB001", "ab001", "DR-1", "DR-01", "A1001", "A1b001", "A001", "DR0001"]
    schemas = ["s", "001_s", "b_001_s", "_s", "1"]
    rows_ = [(d, f"raw.{s}", e) for d in ids for s in schemas for e in ("dev", "qa")]
    got = frame("d string, f string, e string", *rows_).select(names.target_schema(F.col("f"), F.col("d"), F.col("e")).alias("n")).collect()
    assert len({r["n"].lower() for r in got}) == len(rows_)


def test_target_conflicts(frame):
    columns = "dr_id string, source_fqn string, target_environment string, target_fqn string"
    planned = frame(columns, ("1", "a.s.t", "dev", "x.s.T"), ("1", "b.s.t", "dev", "x.s.t"), ("2", "a.s.u", "dev", "x.s.u"), ("2", "a.s.u", "dev", "x.s.u"))
    stored = frame(columns + ", status string", ("1", "a.s.t", "dev", "x.s.u", "ACTIVE"), ("3", "c.s.u", "dev", "x.s.u", None), ("4", "c.s.u", "dev", "x.s.u", "DROPPED"))
    assert rows(plans.target_conflicts(planned, stored), "target_fqn", "owners", "dr_ids") == [("x.s.t", 2, 1), ("x.s.u", 2, 2)]


def test_strategy(frame):
    assert one(frame, names.default_strategy, t="view", o=None) == "view"
    assert one(frame, names.default_strategy, t="table", o="") == "shallow_clone"
    assert one(frame, names.default_strategy, t="view", o="deep_clone") == "deep_clone"


@pytest.mark.parametrize("text, ok", [("DR-1", True), ("DR00042", True), ("A123", True), ("ABCDEFGH123", True), ("ABCDEFGHI123", False), ("DR12", False), ("1DR123", False), ("dr-5", False), (None, False)])
def test_ids(frame, text, ok):
    assert one(frame, checks.is_request_id, d=text) is ok


def test_formatted_ids(spark):
    got = spark.createDataFrame([(23,), (99999,), (100000,)], "n bigint").select(names.formatted_id("DR", F.col("n"), 5).alias("i"))
    assert [r.i for r in got.collect()] == ["DR00023", "DR99999", "DR100000"]
    with pytest.raises(ValueError):
        names.formatted_id("DR", F.col("n"), 0)


def test_allocation_goes_on_after_the_counter(frame):
    waiting = frame("at int, who string", (3, "c"), (1, "a"), (2, "b"))
    got = plans.allocate_ids(waiting, ["at", "who"], "DR", 98, 3)
    assert rows(got, "who", "dr_id", "counter") == [("a", "DR099", 99), ("b", "DR100", 100), ("c", "DR101", 101)]
    assert plans.next_counter(got, "DR", F.lit("2026-01-01")).first()["last_value"] == 101


REQUEST = "dr_id string, qa_enabled boolean, target_catalog string, rev_mode string, rev_version bigint, rev_timestamp string, developers array<string>, qa_users array<string>"
OBJECT = "dr_id string, fqn string, object_type string, access_mode string, clone_strategy string, estimated_size_gb double"


def test_copy_plan(frame):
    requests = frame(REQUEST, ("DR-1", True, None, "version", 5, None, ["a"], ["q"]), ("DR-2", False, "box", "timestamp", None, "2026-01-01", ["b"], None))
    objects = frame(OBJECT, ("DR-1", "prod_x.s.t", "table", "READ_WRITE", None, 1.5), ("DR-1", "x.y", "table", "READ_ONLY", None, None), ("DR-2", "prod_x.s.v", "view", None, None, None))
    got = plans.copy_plan(objects, requests)
    assert rows(got, "dr_id", "target_environment", "target_fqn", "clone_strategy", "clone_revision_mode", "clone_revision_value", "status") == [
        ("DR-1", "dev", "dev_x.dr_1_s.t", "shallow_clone", "version", "5", "REFRESH_PENDING"),
        ("DR-1", "qa", "dev_x.qa_1_s.t", "shallow_clone", "version", "5", "REFRESH_PENDING"),
        ("DR-2", "dev", "box.dr_2_s.v", "view", "timestamp", "2026-01-01", "REFRESH_PENDING"),
    ]


def test_grants_and_revokes(frame):
    requests = frame(REQUEST, ("DR-1", True, None, "latest", None, None, ["a@co.com", "bad`name"], ["q"]))
    schemas = frame("dr_id string, target_environment string, schema_fqn string", ("DR-1", "dev", "c.d"), ("DR-1", "qa", "c.q"), ("DR-1", "dev", "c;d.x"))
    assert rows(plans.grant_plan(schemas, requests), "statement") == [
        ("GRANT SELECT, MODIFY ON SCHEMA c.d TO `a@co.com`",), ("GRANT SELECT, MODIFY ON SCHEMA c.q TO `q`",),
        ("GRANT USAGE ON SCHEMA c.d TO `a@co.com`",), ("GRANT USAGE ON SCHEMA c.q TO `q`",),
    ]
    objects = frame("dr_id string, target_fqn string", ("DR-1", "c.d.t"), ("DR-1", "c.d.u"))
    access = frame("dr_id string, user_email string", ("DR-1", "a@co.com"), ("DR-1", "a@co.com"), ("DR-1", ""))
    assert rows(plans.revoke_plan(objects, access), "statement") == [("REVOKE ALL PRIVILEGES ON SCHEMA c.d FROM `a@co.com`",)]


def test_drops_take_views_first(frame):
    objects = frame(
        "dr_id string, target_environment string, source_fqn string, target_fqn string, object_type string, clone_strategy string, status string",
        ("d", "dev", "s1", "t1", "table", "deep_clone", "PROVISIONED"), ("d", "dev", "s2", "t2", "view", "view", "FAILED"), ("d", "dev", "s3", "t3", "table", "view", "DROPPED"),
    )
    assert rows(plans.drop_plan(objects), "target_fqn", "drop_rank", "action") == [("t1", 1, "drop"), ("t2", 0, "drop"), ("t3", 1, "skip")]
    removed = frame("dr_id string, source_fqn string", ("d", "s2"), ("d", "s3"))
    assert rows(plans.removal_plan(objects, removed), "target_fqn", "drop_kind") == [("t2", "VIEW")]


def test_names_of_a_tag_worked_out_before(frame):
    ids = ("DR-12", "AB00000012", "aB123", "none", None)
    fqns = ("prod_a.s.t", "a", "a.b", "a.b.c.d", "", "a..", None)
    df = frame("dr_id string, fqn string", *[(d, f) for d in ids for f in fqns]).withColumn("tag", names.request_tag(F.col("dr_id")))
    args = F.col("fqn"), F.col("dr_id"), F.lit("qa"), F.lit(None).cast("string")
    for name in (names.target_schema, names.target_object):
        assert df.filter(~name(*args).eqNullSafe(name(*args, F.col("tag")))).count() == 0
    got = {(r[0], r[1]): r[2] for r in df.select("dr_id", "fqn", names.target_object(*args, F.col("tag"))).collect()}
    assert got[("DR-12", "prod_a.s.t")] == "dev_a.qa_12_s.t" and got[("aB123", "a..")] == "a_qa.qa_a_b123_."
    assert [f for d, f in got if d == "DR-12" and got[d, f] is not None] == ["prod_a.s.t", "a.."]


def test_a_plan_is_worked_out_once_for_its_conflicts(frame):
    key = "dr_id string, source_fqn string, target_environment string, target_fqn string"
    planned = frame(key, ("DR-1", "a.s.t", "dev", "x.s.t"), ("DR-1", "a.s.t", "dev", "x.s.t"), ("DR-1", None, "dev", "x.s.n"), ("DR-2", "b.s.t", "dev", "X.s.t"))
    stored = frame(
        f"{key}, status string", ("DR-1", "a.s.t", "dev", "x.s.old", None), ("DR-3", "c.s.t", "dev", "x.s.old", "FAILED"),
        ("DR-1", None, "dev", "x.s.N", None), ("DR-4", "d.s.t", "qa", "x.s.t", "DROPPED"),
    )
    conflicts = plans.target_conflicts(planned, stored)
    assert rows(conflicts, "target_fqn", "owners", "dr_ids") == [("x.s.n", 2, 1), ("x.s.t", 2, 2)]
    plan = conflicts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") + plan.count("LogicalRDD") == 2


@pytest.mark.parametrize("moved", [False, True])
def test_conflicts_against_one_by_one(frame, spark, moved):
    rng = random.Random(5)
    pick = lambda *values: rng.choice(values)
    row = lambda: (pick("1", "2", "3", None), pick("a", "b", "c", None), pick("dev", "qa", None), pick("x.T", "x.t", "y.t", "z.t", "w.t", None))
    planned, stored = [row() for _ in range(12)], [(*row(), pick("ACTIVE", "DROPPED", None)) for _ in range(40)]
    keys = {r[:3] for r in planned if None not in r[:3]}
    owners = set(planned) | {r[:4] for r in stored if r[4] != "DROPPED" and r[:3] not in keys}
    found = defaultdict(list)
    for r in owners:
        found[r[3] and r[3].lower()].append(r[0])
    want = [(t, len(o), len(set(o) - {None})) for t, o in found.items() if len(o) > 1]
    columns = "dr_id string, source_fqn string, target_environment string, target_fqn string"
    plan = frame(columns, *planned)
    got = plans.target_conflicts(plan.repartition("dr_id") if moved else plan, frame(columns + ", status string", *stored))
    assert rows(got, "target_fqn", "owners", "dr_ids") == sorted(want, key=repr)


def test_names_of_a_plan_move_once_more_for_their_conflicts(frame):
    objects = frame("dr_id string, fqn string, object_type string, access_mode string, estimated_size_gb double, clone_strategy string", ("DR-1", "a.s.t", None, None, None, None), ("DR-1", "b.s.t", None, None, None, None))
    requests = frame("dr_id string, qa_enabled boolean, target_catalog string, rev_mode string, rev_version long, rev_timestamp string", ("DR-1", True, "x", None, None, None))
    stored = frame("dr_id string, source_fqn string, target_environment string, target_fqn string, status string", ("DR-2", "a.s.t", "dev", "x.dr_1_s.t", None))
    conflicts = plans.target_conflicts(plans.copy_plan(objects.repartition("dr_id"), requests), stored)
    assert rows(conflicts, "target_fqn", "owners", "dr_ids") == [("x.dr_1_s.t", 3, 2), ("x.qa_1_s.t", 2, 1)]
    plan = conflicts._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Union")]
    assert above.count("Exchange") == 1 and "hashpartitioning(target_fqn" in above
