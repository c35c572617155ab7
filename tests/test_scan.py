"""Lineage, enrichment, sizes, stream names, classification and manifests on small tables."""

import json

from pyspark.sql import functions as F

from conftest import rows
from sandboxlake import schemas
from sandboxlake.operators import approvals
from sandboxlake.operators import classify as c
from sandboxlake.operators import manifest as m
from sandboxlake.operators.resolve import ambiguous_streams, resolve_streams, scannable_requests
from sandboxlake.plans.scan import facts_of_requests, scan
from sandboxlake.sources import documents, inventory, lineage, sizes


def edges(frame, *items):
    return frame(schemas.EDGES, *[(s, t, st, tt, e, i) for i, (s, t, st, tt, e) in enumerate(items)])


def test_access_modes(frame):
    got = c.classify(edges(
        frame, ("a.b.r", "a.b.w", "TABLE", "TABLE", "1"), ("a.b.rw", None, None, None, "1"), (None, "a.b.rw", None, None, "1"),
    ))
    assert rows(got) == [
        ("a.b.r", "table", "READ_ONLY", "delta"), ("a.b.rw", "table", "READ_WRITE", "delta"), ("a.b.w", "table", "WRITE_ONLY", "delta"),
    ]


def test_first_hint_wins_and_a_missing_hint_counts(frame):
    got = c.classify(edges(
        frame, ("v", None, "view", None, "1"), ("v", None, "TABLE", None, "1"), ("n", None, None, None, "1"), ("n", None, "VIEW", None, "1"),
        ("same", "same", "VIEW", "TABLE", "1"),
    ))
    assert rows(got, "fqn", "object_type", "format") == [("n", "table", "delta"), ("same", "view", None), ("v", "view", None)]


def test_empty_edges(frame):
    assert rows(c.classify(edges(frame))) == []


def test_additional_objects(frame):
    e = edges(frame, ("a.b.x", None, "VIEW", None, "1"))
    extra = frame("fqn string", ("a.b.x",), ("a.b.new",), ("a.b.new",))
    want = [("a.b.new", "table", "READ_ONLY", "delta", True), ("a.b.x", "view", "READ_ONLY", None, False)]
    assert rows(c.classify_with_additional(e, extra)) == want


def test_enrichment_hints(frame):
    got = lineage.enrichment_edges(
        frame(
            "stream_key string, object_fqn string, access_hint string",
            ("s", "r", "READ"), ("s", "w", "write"), ("s", "b", "READ_WRITE"), ("s", "n", None), ("s", "o", "odd"), ("s", None, "READ"), ("s", "", "READ"),
        )
    )
    assert rows(got, "source_table_full_name", "target_table_full_name") == [
        ("b", "b"), ("n", None), ("o", None), ("r", None), (None, "w"),
    ]


def test_sizes(frame):
    meta = frame(
        "table_catalog string, table_schema string, table_name string, data_size_in_bytes bigint",
        ("c", "s", "gb", 1073741824), ("c", "s", "tiny", 1), ("c", "s", "none", None), ("c;x", "s", "bad", 5),
    )
    names = frame("fqn string", ("c.s.gb",), ("c.s.tiny",), ("c.s.none",), ("c.s",), ("c;x.s.bad",))
    assert rows(sizes.table_sizes(meta, names)) == [("c.s.gb", 1.0), ("c.s.tiny", 0.0)]


def inventory_frame(spark):
    jobs = spark.createDataFrame(
        [("one", "1", ["a"]), ("two", "2", []), ("two", "3", []), ("both", "4", None)], "name string, resource_id string, task_keys array<string>"
    )
    pipes = spark.createDataFrame([("both", "p1"), ("pipe", "p2"), ("pp", "p3"), ("pp", "p4")], "name string, resource_id string")
    return inventory.stream_inventory(jobs, pipes)


def test_resolution(spark, frame):
    inv = inventory_frame(spark)
    streams = frame("dr_id string, name string", *[("d", n) for n in ("one", "two", "both", "pipe", "pp", "none")])
    got = resolve_streams(streams, inv)
    assert rows(got, "name", "resolution", "resource_type", "resource_id") == [
        ("both", "resolved", "job", "4"), ("none", "unresolved", None, None), ("one", "resolved", "job", "1"),
        ("pipe", "resolved", "pipeline", "p2"), ("pp", "ambiguous", None, None), ("two", "ambiguous", None, None),
    ]
    assert got.filter("name = 'one'").first()["task_keys"] == ["a"]
    assert rows(ambiguous_streams(inv), "name") == [("pp",), ("two",)]
    more = got.unionByName(got.filter("name = 'one'").withColumn("dr_id", F.lit("e")))
    assert rows(scannable_requests(more)) == [("e",)]


def test_search_takes_jobs_first(spark):
    got = inventory.search_streams(inventory_frame(spark), "pp").collect()
    assert [(r.kind, r.resource_id) for r in got] == [("pipeline", "p3"), ("pipeline", "p4")]
    assert [r.kind for r in inventory.search_streams(inventory_frame(spark), "both").collect()] == ["job", "pipeline"]


def test_row_limit_per_request(frame):
    e = edges(frame, *[(f"s{i}", None, None, None, "j1" if i % 2 else "j2") for i in range(10)])
    members = frame("dr_id string, entity_id string", ("a", "j1"), ("b", "j1"), ("b", "j2"))
    got = lineage.lineage_of_requests(e, members, 6)
    assert rows(got.groupBy("dr_id", "row_limit_hit").count()) == [("a", False, 5), ("b", True, 6)]
    assert sorted(r[0] for r in rows(got.filter("dr_id = 'b'"), "source_table_full_name")) == [f"s{i}" for i in range(6)]


def test_no_edge_is_cut_unless_asked(frame):
    e = edges(frame, *[(f"s{i}", None, None, None, "j1") for i in range(10)])
    got = lineage.lineage_of_requests(e, frame("dr_id string, entity_id string", ("a", "j1"), ("b", "j1"), ("b", "none")))
    assert rows(got.groupBy("dr_id", "row_limit_hit").count()) == [("a", False, 10), ("b", False, 10)]


def test_row_limit_above_map_side_cut(frame, spark):
    e = spark.range(5000).select(
        F.concat(F.lit("s"), "id").alias("source_table_full_name"), F.lit(None).cast("string").alias("target_table_full_name"),
        F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("string").alias("target_type"), F.lit("j").alias("entity_id"),
        (4999 - F.col("id")).alias("edge_seq"),
    )
    kept = lineage.lineage_of_requests(e, frame("dr_id string, entity_id string", ("a", "j")), 2000)
    assert kept.count() == 2000 and kept.agg(F.max("edge_seq")).first()[0] == 1999


def scanned(frame, spark, row_limit=100):
    e = edges(
        frame, ("prod_a.s.t1", "prod_a.s.t2", "VIEW", "TABLE", "1"), ("prod_a.s.t2", None, "TABLE", None, "1"), ("prod_b.s.u", None, None, None, "p2"),
    )
    return scan(
        e, frame("dr_id string, name string", ("DR-1", "one"), ("DR-1", "pipe"), ("DR-2", "two"), ("DR-3", "pipe")), inventory_frame(spark),
        frame("dr_id string, fqn string", ("DR-1", "other.s.x"), ("DR-1", "prod_a.s.t1"), ("DR-2", "q.w.e"), ("DR-3", "prod_b.s.u")),
        frame("table_catalog string, table_schema string, table_name string, data_size_in_bytes bigint", ("prod_a", "s", "t2", 2 * 1073741824), ("prod_a", "s", "t1", 9)),
        frame("stream_key string, object_fqn string, access_hint string", ("one", "prod_a.s.t1", "WRITE"), ("p2", "prod_b.s.v", None), ("two", "z.z.z", None)),
        row_limit,
    )


def test_scan(frame, spark):
    s = scanned(frame, spark)
    assert rows(s.objects, "dr_id", "fqn", "object_type", "access_mode", "estimated_size_gb", "is_additional") == [
        ("DR-1", "other.s.x", "table", "READ_ONLY", None, True), ("DR-1", "prod_a.s.t1", "view", "READ_WRITE", None, False),
        ("DR-1", "prod_a.s.t2", "table", "READ_WRITE", 2.0, False), ("DR-1", "prod_b.s.u", "table", "READ_ONLY", None, False),
        ("DR-1", "prod_b.s.v", "table", "READ_ONLY", None, False), ("DR-3", "prod_b.s.u", "table", "READ_ONLY", None, False),
        ("DR-3", "prod_b.s.v", "table", "READ_ONLY", None, False),
    ]
    assert rows(s.headers, "dr_id", "total_objects", "total_schemas", "review_required", "lineage_row_limit_hit") == [
        ("DR-1", 5, 3, True, False), ("DR-3", 2, 1, False, False),
    ]
    assert rows(s.non_prod) == [("DR-1", "other.s.x")]


def test_scan_without_a_limit(frame, spark):
    limited, whole = scanned(frame, spark), scanned(frame, spark, None)
    assert rows(whole.objects) == rows(limited.objects) and rows(whole.headers) == rows(limited.headers)


def test_scan_over_the_limit_asks_for_review(frame, spark):
    s = scanned(frame, spark, 2)
    assert rows(s.headers, "dr_id", "review_required", "lineage_row_limit_hit") == [("DR-1", True, True), ("DR-3", False, False)]


def test_documents(frame, spark, tmp_path):
    s = scanned(frame, spark)
    docs = m.manifest_documents(s.headers, s.objects, s.streams, s.non_prod, "2026-01-01T00:00:00+00:00")
    doc = json.loads(docs.filter("dr_id = 'DR-1'").first()["manifest_json"])["scan_result"]
    assert [o["fqn"] for o in doc["objects"]] == sorted(o["fqn"] for o in doc["objects"]) and doc["total_objects"] == 5
    assert doc["schemas_required"] == ["other.s", "prod_a.s", "prod_b.s"] and doc["non_prod_additional_objects"] == ["other.s.x"]
    assert doc["streams_scanned"][0] == {"name": "one", "workflow_id": "1", "tasks": ["a"]}
    assert "estimated_size_gb" not in doc["objects"][0]
    assert docs.count() == 2 and rows(documents.manifest_objects(docs), "dr_id", "fqn") == rows(s.objects, "dr_id", "fqn")


def test_manifest_sink(frame, spark, tmp_path):
    s = scanned(frame, spark)
    items = m.manifest_items(s.objects, s.streams, s.non_prod)
    m.write_manifests(s.headers, items, str(tmp_path / "out"), "2026-01-01")
    headers, again = m.read_manifests(spark, str(tmp_path / "out"))
    assert rows(headers.drop("scanned_at")) == rows(s.headers.select(headers.drop("scanned_at").columns))
    assert rows(again) == rows(items) and again.count() == items.count()
    assert rows(m.documents_of(headers, again, "x")) == rows(m.manifest_documents(s.headers, s.objects, s.streams, s.non_prod, "x"))


def test_items_move_once_to_their_document(frame, spark):
    """Items are not folded to lists before they move, and schemas are read off the gathered objects."""
    objects = frame(
        "dr_id string, fqn string, object_type string, access_mode string, format string, estimated_size_gb double, is_additional boolean",
        *[("DR-1", name, "table", "READ_ONLY", "delta", 1.0, False) for name in ("b.s.x", "a.s.y", "b.s.w", "plain", "a.t")],
    )
    streams = frame("dr_id string, name string, resource_id string, task_keys array<string>", ("DR-1", "one", "1", ["k"]), ("DR-2", "two", None, None))
    headers = m.manifest_headers(objects, frame("dr_id string, row_limit_hit boolean", ("DR-1", False)))
    docs = m.manifest_documents(headers, objects, streams, frame("dr_id string, fqn string", ("DR-1", "c.s.z")), "x")
    found = {r.dr_id: json.loads(r.manifest_json)["scan_result"] for r in docs.collect()}
    assert list(found) == ["DR-1"] and found["DR-1"]["schemas_required"] == ["a.s", "a.t", "b.s"] and found["DR-1"]["total_objects"] == 5
    assert [o["fqn"] for o in found["DR-1"]["objects"]] == ["a.s.y", "a.t", "b.s.w", "b.s.x", "plain"]
    assert found["DR-1"]["streams_scanned"] == [{"name": "one", "workflow_id": "1", "tasks": ["k"]}] and found["DR-1"]["non_prod_additional_objects"] == ["c.s.z"]
    plan = docs.select("*")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("partial_collect_list"):]
    assert below.count("REPARTITION_BY_COL") == 1 and below.count("Exchange") == 1


def test_a_long_manifest_is_one_document_and_one_pending_row(frame, spark):
    many = spark.range(12_000).select(
        F.lit("DR-1").alias("dr_id"), F.concat(F.lit("prod_a.s.t"), F.col("id").cast("string")).alias("fqn"), F.lit("table").alias("object_type"),
        F.lit("READ_ONLY").alias("access_mode"), F.lit("delta").alias("format"), F.lit(None).cast("double").alias("estimated_size_gb"), F.lit(False).alias("is_additional"),
    )
    headers = m.manifest_headers(many, frame("dr_id string, row_limit_hit boolean", ("DR-1", False)))
    streams = frame("dr_id string, name string, resource_id string, task_keys array<string>")
    docs = m.manifest_documents(headers, many, streams, frame("dr_id string, fqn string"), "x")
    configs = docs.select("dr_id", "manifest_json", *[F.lit(v).alias(c) for c, v in (("status", "scanned"), ("description", "d"), ("created_by", "u"), ("scanned_at", "x"))])
    assert rows(approvals.pending_provisions(configs), "dr_id", "total_objects", "total_schemas") == [("DR-1", 12_000, 1)]
    assert documents.manifest_objects(docs).count() == 12_000


def test_manifest_needs_an_object_list(frame):
    texts = frame("dr_id string, manifest_json string", ("a", '{"scan_result": {"objects": []}}'), ("b", '{"scan_result": {}}'), ("c", "[]"), ("d", None))
    got = texts.select("dr_id", F.coalesce(documents.manifest_is_whole(), F.lit(False)).alias("ok"))
    assert rows(got) == [("a", True), ("b", False), ("c", False), ("d", False)]


def test_request_files(spark, tmp_path):
    (tmp_path / "docs.json").write_text('{"version": "1.0", "development_request": {"dr_id": "DR-1"}}\nnot json\n')
    got = documents.read_request_documents(spark, str(tmp_path))
    assert rows(got.select("doc.development_request.dr_id", "reject")) == [("DR-1", None), (None, "not json")]


def test_manifest_sink_is_compressed(frame, spark, tmp_path):
    s = scanned(frame, spark)
    m.write_manifests(s.headers, m.manifest_items(s.objects, s.streams, s.non_prod), str(tmp_path / "out"), "2026-01-01")
    parts = [f.name for part in ("items", "headers") for f in (tmp_path / "out" / part).glob("part-*")]
    assert parts and all(name.endswith(".gz") for name in parts)


def test_listed_objects_read_the_objects_once(frame):
    objects = frame("dr_id string, fqn string", ("DR-1", "a.s.t"), ("DR-1", "a.s.u"), ("DR-2", "a.t"))
    listed = frame("dr_id string, fqn string", ("DR-1", "b.s.x"), ("DR-1", "a.s.u"), ("DR-2", "b.s.x"))
    found = m.non_prod_additional(objects, listed)
    assert rows(found) == [("DR-1", "b.s.x")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_facts_move_once_and_packed(frame, spark):
    """Objects come out of the one move to their request: none by name, none for what only other results need."""
    s = scanned(frame, spark, None)
    plan = s.objects._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "hashpartitioning(fqn" not in plan and "hashpartitioning(dr_id#" in plan
    above = plan[: plan.index("REPARTITION_BY_COL")]
    assert above.count("Exchange") == 1 and "HashAggregate" in above and "SortAggregate" not in above


def test_facts_of_a_large_request_are_spread(frame):
    columns = "kind int, key string, fqn string, seq bigint"
    many = [(0, "a", f"c.s.t{i}", i) for i in range(2500)] + [(0, "b", f"c.s.t{i}", -i) for i in range(5)] + [(1, "a", "other", 0)]
    links = [("DR-1", 0, "a"), ("DR-1", 0, "b"), ("DR-2", 0, "b"), ("DR-3", 1, "a"), ("DR-4", 0, "none")]
    facts, linked = frame(columns, *many), frame("dr_id string, kind int, key string", *links)
    want = sorted(((d, *f[2:]) for d, kind, key in links for f in many if f[:2] == (kind, key)), key=repr)
    for per_task in (100, 1_000_000):
        got = facts_of_requests(facts, linked, per_task)
        assert rows(got, "dr_id", "fqn", "seq") == want
        parts = {(r["dr_id"], r["fqn"]): r["_part"] for r in got.collect()}  # one place for each name
        assert len({p for (d, _), p in parts.items() if d == "DR-1"}) == (26 if per_task == 100 else 1)
        assert got.groupBy("dr_id", "fqn").agg(F.countDistinct("_part").alias("n")).filter("n > 1").count() == 0
    assert rows(facts_of_requests(facts.filter("false"), linked)) == [] == rows(facts_of_requests(facts, linked.filter("false")))


def test_a_name_of_several_sizes_has_a_row_for_each(frame, spark):
    gb = 1073741824
    s = scan(
        edges(frame, ("p.s.t", "p.s.v", "TABLE", "VIEW", "1"), ("p.s.u", None, None, None, "1")), frame("dr_id string, name string", ("DR-1", "one")),
        inventory_frame(spark), frame("dr_id string, fqn string", ("DR-1", "p.s.x")),
        frame("table_catalog string, table_schema string, table_name string, data_size_in_bytes bigint", *[("p", "s", n, k * gb) for n, k in (("t", 1), ("t", 2), ("t", 2), ("v", 1), ("v", 3), ("x", 4))]),
    )
    assert rows(s.objects, "fqn", "estimated_size_gb") == [
        ("p.s.t", 1.0), ("p.s.t", 2.0), ("p.s.t", 2.0), ("p.s.u", None), ("p.s.v", None), ("p.s.v", None), ("p.s.x", 4.0),
    ]
    assert rows(s.headers, "total_objects") == [(4,)]
