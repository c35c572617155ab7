"""Queries: lineage, stream names, classification, manifests, request documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandboxlake import fixed
from sandboxlake.functions.parsing import with_parsed
from sandboxlake.operators import approvals, classify as classifying, manifest, resolve, validate
from sandboxlake.plans.scan import scan
from sandboxlake.session import settle, shared_dir
from sandboxlake.sources import commits, documents, inventory, lineage, sizes
from workload.fixtures import NOW, TODAY
from workload.registry import Tables, query

EDGE = ", ".join(lineage.EDGE_COLUMNS)
EDGE_ORDER = ", ".join(f"{c} NULLS FIRST" for c in reversed(lineage.EDGE_COLUMNS))

# SQL of one job lookup, used by several of the texts below.
COUNTS = """
counts AS (
  SELECT name, count(*) FILTER (WHERE kind = 'job') AS jobs, count(*) FILTER (WHERE kind = 'pipeline') AS pipelines,
         max(CASE WHEN kind = 'job' THEN resource_id END) AS job_id, max(CASE WHEN kind = 'pipeline' THEN resource_id END) AS pipeline_id
  FROM fx_inventory GROUP BY name)"""
RESOLVED = COUNTS + """,
resolved AS (
  SELECT s.dr_id, s.name,
         CASE WHEN coalesce(jobs, 0) = 0 AND coalesce(pipelines, 0) = 0 THEN 'unresolved'
              WHEN jobs = 1 OR (jobs = 0 AND pipelines = 1) THEN 'resolved' ELSE 'ambiguous' END AS resolution,
         CASE WHEN jobs = 1 THEN 'job' WHEN jobs = 0 AND pipelines = 1 THEN 'pipeline' END AS resource_type,
         CASE WHEN jobs = 1 THEN job_id WHEN jobs = 0 AND pipelines = 1 THEN pipeline_id END AS resource_id
  FROM fx_request_streams s LEFT JOIN counts c ON s.name = c.name)"""


def classified(sides: str, by: str = "") -> str:
    """SQL that classifies rows (by..., fqn, w, is_view, seq) of ``sides``."""
    return f"""
SELECT {by} fqn, CASE WHEN arg_min(is_view, seq) THEN 'view' ELSE 'table' END AS object_type,
       CASE WHEN bool_or(w = 0) AND bool_or(w = 1) THEN 'READ_WRITE' WHEN bool_or(w = 1) THEN 'WRITE_ONLY' ELSE 'READ_ONLY' END AS access_mode,
       CASE WHEN NOT arg_min(is_view, seq) THEN 'delta' END AS format
FROM {sides} WHERE fqn IS NOT NULL GROUP BY {by} fqn"""


def edge_sides(edges: str, by: str = "") -> str:
    return f"""
SELECT {by} source_table_full_name AS fqn, 0 AS w, coalesce(upper(source_type) = 'VIEW', false) AS is_view, coalesce(edge_seq * 2, 9223372036854775804) AS seq FROM {edges}
UNION ALL
SELECT {by} target_table_full_name AS fqn, 1 AS w, coalesce(upper(target_type) = 'VIEW', false) AS is_view, coalesce(edge_seq * 2 + 1, 9223372036854775805) AS seq FROM {edges}"""


CURATED = """
SELECT CASE WHEN h <> 'WRITE' THEN object_fqn END AS source_table_full_name,
       CASE WHEN h IN ('WRITE', 'READ_WRITE') THEN object_fqn END AS target_table_full_name,
       CAST(NULL AS VARCHAR) AS source_type, CAST(NULL AS VARCHAR) AS target_type, stream_key AS entity_id
FROM (SELECT *, upper(coalesce(nullif(access_hint, ''), 'READ')) AS h FROM fx_enrichment)
WHERE object_fqn IS NOT NULL AND object_fqn <> ''"""


@query("lineage_scan", f"SELECT {EDGE} FROM fx_edges WHERE entity_id IN (SELECT resource_id FROM fx_inventory WHERE kind = 'job')")
def _(t: Tables) -> DataFrame:
    jobs = t.view("fx_inventory").filter("kind = 'job'").select(F.col("resource_id").alias("entity_id"))
    return lineage.lineage_scan(t.view("fx_edges"), jobs)


@query(
    "lineage_row_limit",
    f"""SELECT {EDGE}, (SELECT count(*) FROM fx_edges) > 10000 AS row_limit_hit
    FROM (SELECT * FROM fx_edges ORDER BY {EDGE_ORDER} LIMIT 10000)""",
)
def _(t: Tables) -> DataFrame:
    edges, more = lineage.lineage_limited(t.view("fx_edges"), fixed.LINEAGE_ROW_LIMIT)
    return edges.withColumn("row_limit_hit", F.lit(more))


@query(
    "lineage_limit_per_request",
    f"""WITH {RESOLVED},
    edges AS (
      SELECT DISTINCT r.dr_id, r.resource_id FROM resolved r WHERE resource_id IS NOT NULL),
    ranked AS (
      SELECT m.dr_id, e.*, row_number() OVER (PARTITION BY m.dr_id ORDER BY {EDGE_ORDER}) AS edge_rank
      FROM edges m JOIN fx_edges e ON m.resource_id = e.entity_id)
    SELECT k.dr_id, {EDGE}, row_limit_hit FROM ranked k
    JOIN (SELECT dr_id, count(*) > 40 AS row_limit_hit FROM ranked GROUP BY dr_id) h ON k.dr_id = h.dr_id
    WHERE edge_rank <= 40""",
)
def _(t: Tables) -> DataFrame:
    streams = resolve.resolve_streams(t.view("fx_request_streams"), t.view("fx_inventory"))
    members = streams.filter("resource_id IS NOT NULL").select("dr_id", F.col("resource_id").alias("entity_id"))
    return lineage.lineage_of_requests(t.view("fx_edges"), members, 40)


@query(
    "enrichment_edges",
    f"""SELECT * FROM ({CURATED}) WHERE entity_id IN (SELECT name FROM fx_inventory UNION SELECT resource_id FROM fx_inventory)""",
)
def _(t: Tables) -> DataFrame:
    keys = t.view("fx_inventory").select(F.explode(F.array("name", "resource_id")).alias("stream_key"))
    return lineage.enrichment_edges(t.view("fx_enrichment"), keys)


@query("merged_edges", f"SELECT {EDGE} FROM fx_edges UNION ALL SELECT *, CAST(NULL AS BIGINT) AS edge_seq FROM ({CURATED})")
def _(t: Tables) -> DataFrame:
    return lineage.merged_edges(t.view("fx_edges"), lineage.enrichment_edges(t.view("fx_enrichment")))


@query(
    "table_sizes",
    """SELECT concat_ws('.', table_catalog, table_schema, table_name) AS fqn, round(data_size_in_bytes / 1073741824.0::DOUBLE, 6) AS size_gb
    FROM fx_sizes WHERE data_size_in_bytes IS NOT NULL AND table_catalog <> '9bad'
    AND concat_ws('.', table_catalog, table_schema, table_name) IN (SELECT target_table_full_name FROM fx_edges)""",
)
def _(t: Tables) -> DataFrame:
    names = t.view("fx_edges").select(F.col("target_table_full_name").alias("fqn"))
    return sizes.table_sizes(t.view("fx_sizes"), names)


@query("resolve_streams", f"WITH {RESOLVED} SELECT * FROM resolved")
def _(t: Tables) -> DataFrame:
    return resolve.resolve_streams(t.view("fx_request_streams"), t.view("fx_inventory")).drop("task_keys")


@query(
    "ambiguous_streams",
    f"WITH {COUNTS} SELECT name, jobs, pipelines FROM counts WHERE jobs > 1 OR (jobs = 0 AND pipelines > 1)",
)
def _(t: Tables) -> DataFrame:
    return resolve.ambiguous_streams(t.view("fx_inventory"))


@query(
    "stream_search",
    """SELECT kind, name, resource_id FROM fx_inventory
    WHERE (kind = 'job' AND name = 'stream-12') OR (kind = 'pipeline' AND contains(name, 'stream-12'))
    ORDER BY kind, name, resource_id LIMIT 20""",
)
def _(t: Tables) -> DataFrame:
    return inventory.search_streams(t.view("fx_inventory"), "stream-12")


@query("earliest_commit", "SELECT fqn, min(version) AS earliest_version, min(ts) AS earliest_ts FROM fx_history GROUP BY fqn")
def _(t: Tables) -> DataFrame:
    return commits.earliest_commit(t.view("fx_history"))


@query(
    "retention_violations",
    """WITH e AS (SELECT fqn, min(version) AS earliest_version, min(ts) AS earliest_ts FROM fx_history GROUP BY fqn)
    SELECT r.*, earliest_version, earliest_ts FROM fx_revisions r JOIN e ON r.fqn = e.fqn
    WHERE (rev_mode = 'version' AND rev_version < earliest_version) OR (rev_mode = 'timestamp' AND rev_ts < earliest_ts)""",
)
def _(t: Tables) -> DataFrame:
    return commits.retention_violations(t.view("fx_revisions"), t.view("fx_history"))


_CLASSIFIED = f"WITH sides AS ({edge_sides('fx_edges')}), classified AS ({classified('sides')})"


@query("classify", _CLASSIFIED + " SELECT * FROM classified")
def classify_query(t: Tables) -> DataFrame:
    return classifying.classify(t.view("fx_edges")).orderBy("fqn")


@query(
    "additional_objects",
    _CLASSIFIED + """ SELECT *, false AS is_additional FROM classified
    UNION ALL SELECT DISTINCT fqn, 'table', 'READ_ONLY', 'delta', true FROM fx_additional WHERE fqn NOT IN (SELECT fqn FROM classified)""",
)
def _(t: Tables) -> DataFrame:
    return classifying.classify_with_additional(t.view("fx_edges"), t.view("fx_additional"))


@query(
    "schemas_required",
    r"""SELECT DISTINCT dr_id, regexp_extract(fqn, '^([^.]*[.][^.]*)', 1) AS schema_fqn FROM fx_manifest_objects""",
)
def _(t: Tables) -> DataFrame:
    return manifest.schemas_required(t.view("fx_manifest_objects"))


_NON_PROD = """
listed AS (SELECT DISTINCT dr_id, fqn FROM fx_additional),
baseline AS (
  SELECT DISTINCT o.dr_id, split_part(o.fqn, '.', 1) AS catalog FROM {objects} o
  WHERE len(string_split(o.fqn, '.')) = 3 AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.dr_id = o.dr_id AND l.fqn = o.fqn)),
non_prod AS (
  SELECT l.dr_id, l.fqn FROM listed l
  WHERE EXISTS (SELECT 1 FROM baseline b WHERE b.dr_id = l.dr_id)
    AND NOT EXISTS (SELECT 1 FROM baseline b WHERE b.dr_id = l.dr_id AND b.catalog = split_part(l.fqn, '.', 1)))"""


@query("non_prod_additional", f"WITH {_NON_PROD.format(objects='fx_manifest_objects')} SELECT * FROM non_prod")
def _(t: Tables) -> DataFrame:
    return manifest.non_prod_additional(t.view("fx_manifest_objects"), t.view("fx_additional"))


_SCAN = f"""WITH {RESOLVED},
go AS (SELECT dr_id FROM resolved GROUP BY dr_id HAVING bool_and(resolution = 'resolved')),
members AS (SELECT DISTINCT r.dr_id, r.name, r.resource_id FROM resolved r JOIN go USING (dr_id)),
keys AS (SELECT dr_id, name AS entity_id FROM members UNION SELECT dr_id, resource_id FROM members),
ids AS (SELECT DISTINCT dr_id, resource_id FROM members),
all_edges AS (
  SELECT i.dr_id, {EDGE} FROM ids i JOIN fx_edges e ON e.entity_id = i.resource_id
  UNION ALL
  SELECT k.dr_id, c.*, CAST(NULL AS BIGINT) FROM keys k JOIN ({CURATED}) c ON c.entity_id = k.entity_id),
sides AS ({edge_sides('all_edges', 'dr_id,')}),
classified AS ({classified('sides', 'dr_id,')}),
extra AS (
  SELECT DISTINCT a.dr_id, a.fqn FROM fx_additional a JOIN go USING (dr_id)
  WHERE NOT EXISTS (SELECT 1 FROM classified c WHERE c.dr_id = a.dr_id AND c.fqn = a.fqn)),
objects AS (
  SELECT *, false AS is_additional FROM classified
  UNION ALL SELECT dr_id, fqn, 'table', 'READ_ONLY', 'delta', true FROM extra),
sizes AS (
  SELECT concat_ws('.', table_catalog, table_schema, table_name) AS fqn, round(data_size_in_bytes / 1073741824.0::DOUBLE, 6) AS gb
  FROM fx_sizes WHERE data_size_in_bytes IS NOT NULL AND table_catalog <> '9bad'),
headers AS (
  SELECT dr_id, count(*) AS total_objects, count(DISTINCT regexp_extract(fqn, '^([^.]*[.][^.]*)', 1)) AS total_schemas,
         bool_or(is_additional) AS review_required, false AS lineage_row_limit_hit
  FROM objects GROUP BY dr_id)"""


def _scan(t: Tables):
    return scan(
        t.view("fx_edges"), t.view("fx_request_streams"), t.view("fx_inventory"), t.view("fx_additional"),
        t.view("fx_sizes"), t.view("fx_enrichment"),
    )


@query(
    "scan_manifest",
    _SCAN + """ SELECT o.*, CASE WHEN object_type = 'table' THEN gb END AS estimated_size_gb
    FROM objects o LEFT JOIN sizes s ON o.fqn = s.fqn""",
)
def scan_manifest(t: Tables) -> DataFrame:
    return _scan(t).objects


@query("scan_headers", _SCAN + " SELECT * FROM headers")
def _(t: Tables) -> DataFrame:
    return _scan(t).headers


def _manifest_rows(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Headers, objects, streams and listed objects away from the others.  Objects are read by each of these, so they are settled."""
    objects = settle(t.view("fx_manifest_objects").drop("clone_strategy")).withColumn("format", F.lit("delta")).withColumn("is_additional", F.lit(False))
    hits = objects.groupBy("dr_id").agg((F.count(F.lit(1)) > 3).alias("row_limit_hit"))
    headers = manifest.manifest_headers(objects, hits)
    streams = t.view("fx_request_streams").select(
        "dr_id", "name", F.lit(None).cast("string").alias("resource_id"), F.lit(None).cast("array<string>").alias("task_keys")
    )
    return headers, objects, streams, manifest.non_prod_additional(objects, t.view("fx_additional"))


@query(
    "manifest_documents",
    f"""WITH {_NON_PROD.format(objects='fx_manifest_objects')}
    SELECT o.dr_id, o.fqn, o.object_type AS type, o.access_mode, o.estimated_size_gb, n.total_objects,
           n.total_objects > 3 AS lineage_row_limit_hit, s.streams, q.schemas, coalesce(p.non_prod, 0) AS non_prod
    FROM fx_manifest_objects o
    JOIN (SELECT dr_id, count(*) AS total_objects FROM fx_manifest_objects GROUP BY dr_id) n USING (dr_id)
    JOIN (SELECT dr_id, count(*) AS streams FROM fx_request_streams GROUP BY dr_id) s USING (dr_id)
    JOIN (SELECT dr_id, count(DISTINCT regexp_extract(fqn, '^([^.]*[.][^.]*)', 1)) AS schemas FROM fx_manifest_objects GROUP BY dr_id) q USING (dr_id)
    LEFT JOIN (SELECT dr_id, count(*) AS non_prod FROM non_prod GROUP BY dr_id) p USING (dr_id)""",
)
def _(t: Tables) -> DataFrame:
    docs = manifest.manifest_documents(*_manifest_rows(t), f"{TODAY}T00:00:00+00:00")
    parsed = with_parsed(docs, "_p", {"doc": ("manifest_json", documents.schemas.MANIFEST)})
    return parsed.select("dr_id", F.col("_p.doc.scan_result").alias("m")).select(
        "dr_id", F.explode("m.objects").alias("o"), "m.total_objects", "m.lineage_row_limit_hit",
        F.size("m.streams_scanned").cast("bigint").alias("streams"), F.size("m.schemas_required").cast("bigint").alias("schemas"),
        F.size("m.non_prod_additional_objects").cast("bigint").alias("non_prod"),
    ).select(
        "dr_id", "o.fqn", "o.type", "o.access_mode", "o.estimated_size_gb", "total_objects", "lineage_row_limit_hit",
        "streams", "schemas", "non_prod",
    )


@query(
    "manifest_sink",
    f"""WITH {_NON_PROD.format(objects='fx_manifest_objects')}, items AS (
      SELECT dr_id, 'object' AS kind, fqn AS name, access_mode FROM fx_manifest_objects
      UNION ALL SELECT dr_id, 'stream', name, NULL FROM fx_request_streams
      UNION ALL SELECT DISTINCT dr_id, 'schema', regexp_extract(fqn, '^([^.]*[.][^.]*)', 1), NULL FROM fx_manifest_objects
      UNION ALL SELECT dr_id, 'non_prod', fqn, NULL FROM non_prod)
    SELECT i.*, n.total_objects FROM items i JOIN (SELECT dr_id, count(*) AS total_objects FROM fx_manifest_objects GROUP BY dr_id) n USING (dr_id)""",
)
def _(t: Tables) -> DataFrame:
    """Written and read back: a header per request, and all its items beside it."""
    headers, objects, streams, away = _manifest_rows(t)
    path = f"{shared_dir(t.spark)}/manifests-{uuid.uuid4().hex}"
    manifest.write_manifests(headers, manifest.manifest_items(objects, streams, away), path, NOW)
    headers, items = manifest.read_manifests(t.spark, path)
    return headers.select("dr_id", "total_objects").join(items, "dr_id").select(
        "dr_id", "kind", "name", F.col("object.access_mode").alias("access_mode"), "total_objects"
    )


@query(
    "manifest_objects",
    """SELECT dr_id, json_extract_string(o, '$.fqn') AS fqn, json_extract_string(o, '$.type') AS type, json_extract_string(o, '$.access_mode') AS access_mode
    FROM (SELECT dr_id, unnest(CAST(json_extract(CASE WHEN json_valid(manifest_json) THEN manifest_json END, '$.scan_result.objects') AS JSON[])) AS o FROM fx_configs)""",
)
def _(t: Tables) -> DataFrame:
    return documents.manifest_objects(t.view("fx_configs")).select("dr_id", "fqn", "type", "access_mode")


_DOC = "CASE WHEN json_valid(document) THEN document END"


@query(
    "request_docs",
    f"""SELECT doc_no, CASE WHEN NOT json_valid(document) OR json_extract({_DOC}, '$.development_request') IS NULL THEN document END AS reject,
           json_extract_string({_DOC}, '$.development_request.dr_id') AS dr_id,
           json_extract_string({_DOC}, '$.development_request.description') AS description,
           json_extract_string({_DOC}, '$.development_request.data_revision.version') AS rev_version,
           json_extract_string({_DOC}, '$.development_request.access.developers[0]') AS first_developer,
           json_extract_string({_DOC}, '$.development_request.lifecycle.expiration_date') AS expiration_date
    FROM fx_documents""",
)
def _(t: Tables) -> DataFrame:
    body = "doc.development_request"
    parsed = documents.parse_request_documents(t.view("fx_documents"))
    return parsed.select(
        "doc_no", "reject", f"{body}.dr_id", f"{body}.description",
        F.col(f"{body}.data_revision.version").cast("string").alias("rev_version"),
        F.get(f"{body}.access.developers", F.lit(0)).alias("first_developer"), f"{body}.lifecycle.expiration_date",
    )


_BODY = "json_extract_string(document, '$.development_request.{}')"


def _list(path: str) -> str:
    return f"CAST(json_extract(document, '$.development_request.{path}') AS VARCHAR[])"


_DAY = "try_cast(CASE WHEN regexp_full_match(expires, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN expires END AS DATE)"
_RULES = [
    ("version <> '1.0'", "version: must be 1.0"),
    ("NOT regexp_full_match(dr_id, 'DR-[0-9]+')", "dr_id: not a request id"),
    ("len(streams) = 0", "streams: at least one is needed"),
    ("list_contains(streams, '')", "streams: a name is empty"),
    ("len(list_filter(extra, lambda o: NOT regexp_full_match(o, '[^.]+[.][^.]+[.][^.]+'))) > 0", "additional_objects: not a three-part name"),
    ("dev <> 'true'", "environments.dev: cannot be off"),
    ("mode NOT IN ('latest', 'version', 'timestamp')", "data_revision.mode: unknown"),
    ("mode = 'version' AND rev IS NULL", "data_revision.version: missing"),
    ("rev < 0", "data_revision.version: negative"),
    ("mode = 'timestamp' AND ts IS NULL", "data_revision.timestamp: missing"),
    ("ts IN ('yesterday', '1998-02-30T00:00:00Z')", "data_revision.timestamp: not ISO 8601"),
    ("len(devs) = 0", "access.developers: at least one is needed"),
    ("len(list_filter(devs, lambda d: trim(d) = '')) > 0", "access.developers: a name is blank"),
    ("qa = 'true' AND qa_users IS NULL", "access.qa_users: needed when qa is on"),
    (f"{_DAY} IS NULL", "lifecycle.expiration_date: not a date"),
    (f"{_DAY} <= DATE '{TODAY}'", "lifecycle.expiration_date: not in the future"),
    (f"{_DAY} - DATE '{TODAY}' > 90", "lifecycle.expiration_date: too far ahead"),
    ("notice < 0", "lifecycle.notification_days_before: negative"),
]
_VALIDATE = f"""
WITH docs AS (
  SELECT doc_no, document FROM fx_documents WHERE json_valid(document)),
flat AS (
  SELECT doc_no, json_extract_string(document, '$.version') AS version, {_BODY.format('dr_id')} AS dr_id,
         list_transform(CAST(json_extract(document, '$.development_request.streams') AS JSON[]), lambda s: json_extract_string(s, '$.name')) AS streams,
         {_list('additional_objects')} AS extra, {_BODY.format('environments.dev.enabled')} AS dev, {_BODY.format('environments.qa.enabled')} AS qa,
         {_BODY.format('data_revision.mode')} AS mode, CAST({_BODY.format('data_revision.version')} AS BIGINT) AS rev,
         {_BODY.format('data_revision.timestamp')} AS ts, {_list('access.developers')} AS devs, {_BODY.format('access.qa_users')} AS qa_users,
         {_BODY.format('lifecycle.expiration_date')} AS expires, CAST({_BODY.format('lifecycle.notification_days_before')} AS INT) AS notice
  FROM docs WHERE json_extract(document, '$.development_request') IS NOT NULL)
SELECT dr_id, errors, CASE WHEN errors = '' THEN 'valid' ELSE 'invalid' END AS config_status
FROM (SELECT dr_id, concat_ws('; ', {', '.join(f"CASE WHEN {c} THEN '{m}' END" for c, m in _RULES)}) AS errors FROM flat)"""


@query("validate_requests", _VALIDATE)
def _(t: Tables) -> DataFrame:
    flat = documents.flat_requests(documents.parse_request_documents(t.view("fx_documents")))
    return validate.validate_requests(flat, TODAY).select("dr_id", F.array_join("errors", "; ").alias("errors"), "config_status")


@query(
    "pending_provisions",
    """WITH s AS (
      SELECT *, CASE WHEN json_valid(manifest_json) THEN coalesce(json_extract(manifest_json, '$.scan_result'), CAST(manifest_json AS JSON)) END AS m
      FROM fx_configs WHERE status = 'scanned')
    SELECT dr_id, description, created_by AS requested_by, scanned_at,
           coalesce(CAST(json_extract_string(m, '$.total_objects') AS BIGINT), 0) AS total_objects,
           coalesce(CAST(json_array_length(m, '$.schemas_required') AS BIGINT), 0) AS total_schemas,
           coalesce(json_extract_string(m, '$.review_required') = 'true', false) AS review_required,
           coalesce(CAST(json_array_length(m, '$.non_prod_additional_objects') AS BIGINT), 0) AS non_prod_objects
    FROM s""",
)
def _(t: Tables) -> DataFrame:
    return approvals.pending_provisions(t.view("fx_configs"))
