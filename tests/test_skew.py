"""Hot keys against brute force, and plans that show how they are handled."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sandboxlake import fixed
from sandboxlake.operators import asof, classify, slices, topn
from sandboxlake.plans import copy_plan as plans
from sandboxlake.session import forget_settled, settle, shared_dir


@pytest.fixture
def many_slices(spark):
    """Keep the small partitions of small data apart, as large data would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def skewed(n=4000, seed=7):
    """(key, order, id): one key has most rows."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}", rng.randrange(500), i) for i in range(n)]


def test_row_numbers_over_a_hot_value(spark, many_slices):
    data = [(5, i) if i % 3 else (i, i) for i in range(3000)]
    got = slices.row_numbers(spark.createDataFrame(data, "a int, b int").repartition(7), ["a", "b"])
    assert [r[1:] for r in rows(got, "row_no", "a", "b")] == sorted(sorted(data), key=lambda r: repr((sorted(data).index(r) + 1, *r)))
    assert {r[0] for r in rows(got, "row_no")} == set(range(1, 3001))


def test_hot_values_are_split_over_slices(spark, many_slices):
    df = spark.range(20000).select(F.lit("hot").alias("k"), "id")
    sizes = [r["count"] for r in slices.range_slices(df, ["k", "id"]).groupBy("slice_no").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 20000 / 2


def test_previous_over_a_hot_key(spark, many_slices):
    data = skewed()
    df = spark.createDataFrame(data, "k string, o int, i int").repartition(5)
    want, last = [], {}
    for k, o, i in sorted(data):
        want.append((k, o, i, last.get(k)))
        last[k] = i
    got = slices.with_previous(df, ["k"], ["o", "i"], "i", "before")
    assert rows(got, "k", "o", "i", "before") == sorted(want, key=repr)


def test_previous_keeps_null_values_apart_from_no_row(spark, many_slices):
    data = [("a", 1, None), ("a", 2, "x"), ("a", 3, None), (None, 1, "n"), (None, 2, "m")]
    got = slices.with_previous(spark.createDataFrame(data, "k string, o int, v string"), ["k"], ["o"], "v", "before")
    assert rows(got, "k", "o", "before") == [("a", 1, None), ("a", 2, None), ("a", 3, "x"), (None, 1, None), (None, 2, "n")]


def test_first_rows_small_and_large(spark):
    data = skewed()
    df = spark.createDataFrame(data, "k string, o int, i int")
    groups = defaultdict(list)
    for k, o, i in sorted(data):
        groups[k].append((k, o, i))
    for n in (3, 1500):
        want = sorted((r for g in groups.values() for r in g[:n]), key=repr)
        assert rows(topn.first_rows(df, ["k"], [F.col("o"), F.col("i")], n)) == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_cuts_happen_before_the_shuffle(spark):
    df = spark.createDataFrame(skewed(100), "k string, o int, i int")
    assert "WindowGroupLimit" in plan(topn.first_rows(df, ["k"], [F.col("i")], 5))
    log = df.select("k", F.col("i").alias("commit_version"), F.lit("upsert").alias("op"), F.lit(None).cast("timestamp").alias("commit_ts"))
    assert "Partial" in plan(asof.as_of(log, ["k"]))


def test_as_of_over_a_hot_key(spark):
    data = skewed()
    log = spark.createDataFrame([(k, o, i, None, "delete" if o % 9 == 0 else "upsert") for k, o, i in data], "k string, v int, commit_version bigint, commit_ts timestamp_ntz, op string")
    newest = {}
    for k, o, i in data:
        newest[k] = (o, i)
    assert rows(asof.as_of(log, ["k"])) == sorted(((k, o) for k, (o, _) in newest.items() if o % 9), key=repr)


def test_classify_random_edges(spark):
    rng = random.Random(3)
    name = lambda: rng.choice(["hot"] * 20 + [f"t{i}" for i in range(30)] + [None, ""])
    hint = lambda: rng.choice(["VIEW", "view", "TABLE", None])
    edges = [(name(), name(), hint(), hint(), "e", i) for i in range(2000)]
    reads, writes, hints = set(), set(), {}
    for s, t, sh, th, _, _ in edges:
        for fqn, h, seen in ((s, sh, reads), (t, th, writes)):
            if fqn:
                seen.add(fqn)
                hints.setdefault(fqn, h)
    want = [
        (f, "view" if (hints[f] or "").upper() == "VIEW" else "table", fixed.READ_WRITE if f in reads & writes else fixed.WRITE_ONLY if f in writes else fixed.READ_ONLY)
        for f in reads | writes
    ]
    df = spark.createDataFrame(edges, "source_table_full_name string, target_table_full_name string, source_type string, target_type string, entity_id string, edge_seq bigint")
    got = classify.classify(df.repartition(6))
    assert rows(got, "fqn", "object_type", "access_mode") == sorted(want, key=repr)
    text = plan(got)
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_settled_rows_stay(spark):
    df = settle(spark.range(50).withColumn("r", F.rand()))
    assert rows(df) == rows(df)
    assert spark.conf.get("spark.checkpoint.dir", None) in (None, shared_dir(spark))
    forget_settled(spark)


def test_people_of_a_hot_request_are_folded_into_as_many_rows_as_they_need(spark):
    """One request holds most people; no row holds more than about what is asked for, and no statement is lost."""
    people = spark.range(3000).select(
        F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 50).cast("string"))).alias("dr_id"),
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("principal"),
    )
    folded = plans._folded(people.unionByName(people), ["dr_id"], ["principal"], 100)
    sizes = [(r["dr_id"], r["n"]) for r in folded.select("dr_id", F.size("_people").alias("n")).collect()]
    assert max(n for _, n in sizes) < 200 and sum(n for _, n in sizes) == 3000
    assert len([1 for d, _ in sizes if d == "hot"]) > 25 and len([1 for d, _ in sizes if d == "r1"]) == 1
    objects = people.select("dr_id", F.lit("c.s.t").alias("target_fqn")).distinct()
    access = people.withColumnRenamed("principal", "user_email")
    assert plans.revoke_plan(objects, access).select("dr_id", "principal").distinct().count() == 3000
