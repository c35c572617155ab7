"""Queries: target names, copy, grant, revoke and drop plans, ids, checks on names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandboxlake.functions import checks, names
from sandboxlake.operators import principals
from sandboxlake.plans import copy_plan as plans
from workload.fixtures import NOW
from workload.registry import Tables, query
from workload.state import new_state


def settings(t: Tables) -> DataFrame:
    return (
        t.view("fx_settings")
        .withColumn("developers", F.split("developers", ","))
        .withColumn("qa_users", F.split("qa_users", ","))
    )


# SQL for the name of a target; ``x`` has dr_id, env, fqn, target_catalog.
_NUMBER = "regexp_extract(x.dr_id, '([0-9]+)$', 1)"
_CATALOG = """CASE WHEN trim(x.target_catalog) <> '' THEN trim(x.target_catalog)
       WHEN starts_with(x.fqn, 'prod') THEN 'dev' || split_part(x.fqn, '.', 1)[5:]
       ELSE split_part(x.fqn, '.', 1) || '_' || x.env END"""
_TAG = f"CASE WHEN starts_with(x.dr_id, 'DR-') THEN {_NUMBER} ELSE lower(regexp_replace(x.dr_id, '([a-z])', '\\1_', 'g')) END"
_SCHEMA = f"({_CATALOG}) || CASE x.env WHEN 'dev' THEN '.dr_' ELSE '.qa_' END || {_TAG} || '_' || split_part(x.fqn, '.', 2)"
_THREE = "len(string_split(x.fqn, '.')) = 3"
_ENVS = """envs AS (SELECT s.*, unnest(CASE WHEN qa_enabled THEN ['dev', 'qa'] ELSE ['dev'] END) AS env FROM fx_settings s),
x AS (SELECT e.*, o.fqn, o.object_type, o.access_mode, o.clone_strategy, o.estimated_size_gb FROM envs e JOIN fx_manifest_objects o USING (dr_id))"""


@query(
    "target_names",
    f"""WITH {_ENVS}, named AS (  -- every id once more in the other form, with prefixes that differ in a letter or its case only
      SELECT * REPLACE (unnest([dr_id] || ['DR', 'DS', 'Ds', 'dS'].list_transform(lambda p: p || lpad(dr_id[4:], 8, '0'))) AS dr_id) FROM x)
    SELECT DISTINCT x.dr_id, x.fqn, x.env, {_NUMBER} AS request_number, {_SCHEMA} AS target_schema,
      CASE WHEN {_THREE} THEN {_SCHEMA} || '.' || split_part(x.fqn, '.', 3) END AS target_object FROM named x""",
)
def _(t: Tables) -> DataFrame:
    digits = F.lpad(F.substring("dr_id", 4, 20), 8, "0")
    forms = [F.col("dr_id"), *[F.concat(F.lit(prefix), digits) for prefix in ("DR", "DS", "Ds", "dS")]]
    ids = F.array(*[F.struct(i.alias("dr_id"), names.request_number(i).alias("request_number"), names.request_tag(i).alias("tag")) for i in forms])
    requests = settings(t).select("dr_id", "target_catalog", ids.alias("ids"), plans.environments(F.col("qa_enabled")).alias("envs"))
    rows = t.view("fx_manifest_objects").select("dr_id", "fqn").distinct().join(requests, "dr_id").select(
        "fqn", "target_catalog", "envs", F.inline_outer("ids")
    ).withColumn("env", F.explode("envs"))
    dr, fqn, env, cat, tag = F.col("dr_id"), F.col("fqn"), F.col("env"), F.col("target_catalog"), F.col("tag")
    return rows.select(
        "dr_id", "fqn", "env", "request_number",
        names.target_schema(fqn, dr, env, cat, tag).alias("target_schema"),
        names.target_object(fqn, dr, env, cat, tag).alias("target_object"),
    )


@query("target_schemas", f"WITH {_ENVS} SELECT DISTINCT dr_id, env AS target_environment, {_SCHEMA} AS schema_fqn FROM x")
def _(t: Tables) -> DataFrame:
    return plans.target_schemas(t.view("fx_manifest_objects"), settings(t))


@query(
    "copy_plan",
    f"""WITH {_ENVS} SELECT x.dr_id, x.fqn AS source_fqn, {_SCHEMA} || '.' || split_part(x.fqn, '.', 3) AS target_fqn, x.env AS target_environment,
      coalesce(object_type, 'table') AS object_type, coalesce(access_mode, 'READ_ONLY') AS access_mode,
      coalesce(nullif(clone_strategy, ''), CASE WHEN object_type = 'view' THEN 'view' ELSE 'shallow_clone' END) AS clone_strategy,
      rev_mode AS clone_revision_mode,
      CASE rev_mode WHEN 'version' THEN CAST(rev_version AS VARCHAR) WHEN 'timestamp' THEN rev_timestamp END AS clone_revision_value,
      CAST(NULL AS TIMESTAMP) AS provisioned_at, CAST(NULL AS TIMESTAMP) AS last_refreshed_at,
      'REFRESH_PENDING' AS status, estimated_size_gb
    FROM x WHERE {_THREE}""",
)
def copy_plan(t: Tables) -> DataFrame:
    return plans.copy_plan(t.view("fx_manifest_objects"), settings(t))


@query(
    "target_conflicts",
    f"""WITH envs AS (SELECT s.*, unnest(CASE WHEN qa_enabled THEN ['dev', 'qa'] ELSE ['dev'] END) AS env FROM fx_settings s),
    o AS (SELECT dr_id, fqn FROM fx_manifest_objects UNION ALL SELECT dr_id, 'other_' || fqn FROM fx_manifest_objects),
    x AS (SELECT e.*, o.fqn FROM envs e JOIN o USING (dr_id)),
    planned AS (SELECT x.dr_id, x.fqn AS source_fqn, x.env AS target_environment, {_SCHEMA} || '.' || split_part(x.fqn, '.', 3) AS target_fqn FROM x WHERE {_THREE}),
    kept AS (SELECT dr_id, source_fqn, target_environment, target_fqn FROM fx_objects s WHERE status IS DISTINCT FROM 'DROPPED' AND NOT EXISTS (
      SELECT 1 FROM planned p WHERE p.dr_id = s.dr_id AND p.source_fqn = s.source_fqn AND p.target_environment = s.target_environment))
    SELECT lower(target_fqn) AS target_fqn, count(*) AS owners, count(DISTINCT dr_id) AS dr_ids
    FROM (SELECT * FROM planned UNION SELECT * FROM kept) GROUP BY lower(target_fqn) HAVING count(*) > 1""",
)
def _(t: Tables) -> DataFrame:
    """Objects of two catalogs under one name each: they meet where the request sends both to one catalog.

    Objects move to their request before they are doubled.
    """
    objects = t.view("fx_manifest_objects").repartition("dr_id")
    both = objects.withColumn("fqn", F.explode(F.array("fqn", F.concat(F.lit("other_"), "fqn"))))
    return plans.target_conflicts(plans.copy_plan(both, settings(t)), t.view("fx_objects"))


_GRANTS = f"""WITH {_ENVS},
s AS (SELECT DISTINCT dr_id, env AS target_environment, {_SCHEMA} AS schema_fqn, developers, qa_users FROM x),
p AS (SELECT dr_id, target_environment, schema_fqn, unnest(string_split(CASE WHEN target_environment = 'dev' THEN developers ELSE qa_users END, ',')) AS principal FROM s),
grants AS (
  SELECT *, unnest(['GRANT USAGE ON SCHEMA ' || schema_fqn || ' TO `' || principal || '`',
                    'GRANT SELECT, MODIFY ON SCHEMA ' || schema_fqn || ' TO `' || principal || '`']) AS statement
  FROM p WHERE principal <> 'not safe')"""


def _grants(t: Tables) -> DataFrame:
    return plans.grant_plan(plans.target_schemas(t.view("fx_manifest_objects"), settings(t)), settings(t))


@query("grant_plan", _GRANTS + " SELECT * FROM grants")
def grant_plan(t: Tables) -> DataFrame:
    return _grants(t)


@query("grantable_principals", _GRANTS + " SELECT * FROM grants WHERE principal IN (SELECT principal FROM fx_principals)")
def _(t: Tables) -> DataFrame:
    return principals.grantable(_grants(t), t.view("fx_principals"))


@query("unknown_principals", _GRANTS + " SELECT DISTINCT dr_id, principal FROM grants WHERE principal NOT IN (SELECT principal FROM fx_principals)")
def _(t: Tables) -> DataFrame:
    return principals.unknown_principals(_grants(t), t.view("fx_principals"))


_TARGET_SCHEMA = "regexp_extract(target_fqn, '^([^.]*[.][^.]*)', 1)"


@query(
    "revoke_plan",
    f"""SELECT o.dr_id, schema_fqn, principal, 'REVOKE ALL PRIVILEGES ON SCHEMA ' || schema_fqn || ' FROM `' || principal || '`' AS statement
    FROM (SELECT DISTINCT dr_id, {_TARGET_SCHEMA} AS schema_fqn FROM fx_objects) o
    JOIN (SELECT DISTINCT dr_id, user_email AS principal FROM fx_access WHERE user_email <> 'bad name') a USING (dr_id)""",
)
def _(t: Tables) -> DataFrame:
    return plans.revoke_plan(t.view("fx_objects"), t.view("fx_access"))


@query(
    "access_rows",
    f"""SELECT dr_id, user_email, environment, 'READ_WRITE' AS access_level, TIMESTAMP '{NOW}' AS granted_at FROM (
      SELECT dr_id, unnest(string_split(developers, ',')) AS user_email, 'dev' AS environment FROM fx_settings
      UNION ALL SELECT dr_id, unnest(string_split(qa_users, ',')), 'qa' FROM fx_settings WHERE qa_enabled)""",
)
def _(t: Tables) -> DataFrame:
    return plans.access_rows(settings(t), F.lit(NOW).cast("timestamp_ntz"))


@query("env_schemas", f"SELECT DISTINCT dr_id, target_environment, {_TARGET_SCHEMA} AS schema_fqn FROM fx_objects WHERE status IS NULL OR status <> 'DROPPED'")
def _(t: Tables) -> DataFrame:
    return plans.env_schemas(t.view("fx_objects"))


@query(
    "cleanup_plan",
    """SELECT dr_id, target_environment, source_fqn, target_fqn, object_type, clone_strategy, status,
      CASE WHEN object_type = 'view' THEN 0 ELSE 1 END AS drop_rank, CASE WHEN status = 'DROPPED' THEN 'skip' ELSE 'drop' END AS action FROM fx_objects""",
)
def _(t: Tables) -> DataFrame:
    return plans.drop_plan(t.view("fx_objects"))


@query(
    "removal_plan",
    """SELECT dr_id, target_environment, source_fqn, target_fqn, object_type, clone_strategy, status,
      CASE WHEN clone_strategy = 'view' THEN 'VIEW' ELSE 'TABLE' END AS drop_kind
    FROM fx_objects o WHERE (status IS NULL OR status <> 'DROPPED')
      AND EXISTS (SELECT 1 FROM fx_manifest_objects m WHERE m.dr_id = o.dr_id AND m.fqn = o.source_fqn)""",
)
def _(t: Tables) -> DataFrame:
    named = t.view("fx_manifest_objects").select("dr_id", F.col("fqn").alias("source_fqn"))
    return plans.removal_plan(t.view("fx_objects"), named)


@query(
    "net_new_objects",
    """SELECT * FROM fx_manifest_objects m
    WHERE NOT EXISTS (SELECT 1 FROM fx_objects o WHERE o.dr_id = m.dr_id AND o.source_fqn = m.fqn)""",
)
def _(t: Tables) -> DataFrame:
    return plans.net_new_objects(t.view("fx_manifest_objects"), t.view("fx_objects"))


_ALLOCATED = """SELECT o_orderkey, counter, 'DR' || CASE WHEN counter < 10000 THEN lpad(CAST(counter AS VARCHAR), 5, '0') ELSE CAST(counter AS VARCHAR) END AS dr_id
    FROM (SELECT o_orderkey, 41 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS counter FROM orders)"""


@query("allocate_ids", _ALLOCATED)
def allocate_ids(t: Tables) -> DataFrame:
    waiting = t.base("orders").select("o_orderdate", "o_orderkey")
    return plans.allocate_ids(waiting, ["o_orderdate", "o_orderkey"], "DR", 41).drop("o_orderdate")


@query("next_counter", f"SELECT 'DR' AS prefix, max(counter) AS last_value, TIMESTAMP '{NOW}' AS updated_at FROM ({_ALLOCATED})")
def _(t: Tables) -> DataFrame:
    return plans.next_counter(allocate_ids(t), "DR", F.lit(NOW).cast("timestamp_ntz"))


@query(
    "allocate_ids_stored",
    """SELECT o_orderkey, counter, 'DR' || CASE WHEN counter < 10000 THEN lpad(CAST(counter AS VARCHAR), 5, '0') ELSE CAST(counter AS VARCHAR) END AS dr_id,
      (SELECT count(*) FROM orders) AS last_value
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey % 2, o_orderdate, o_orderkey) AS counter FROM orders)""",
)
def _(t: Tables) -> DataFrame:
    """Two calls, the second of which goes on where the first one ended."""
    state, waiting = new_state(t), t.base("orders").select("o_orderdate", "o_orderkey")
    order = ["o_orderdate", "o_orderkey"]
    first = plans.allocate_stored(state, waiting.filter("o_orderkey % 2 = 0"), order, "DR", NOW)
    second = plans.allocate_stored(state, waiting.filter("o_orderkey % 2 = 1"), order, "DR", NOW)
    last = state.current("counters").select("last_value")
    return first.unionByName(second).drop("o_orderdate").join(F.broadcast(last), F.lit(True))


@query(
    "name_checks",
    """SELECT no, fqn, regexp_full_match(fqn, '[a-zA-Z0-9_]+[.][a-zA-Z0-9_]+[.][a-zA-Z0-9_]+') AS is_object,
      regexp_full_match(fqn, '[a-zA-Z0-9_]+[.][a-zA-Z0-9_]+') AS is_schema, regexp_full_match(split_part(fqn, '.', 1), '[A-Za-z_][A-Za-z0-9_]*') AS is_catalog
    FROM fx_names""",
)
def _(t: Tables) -> DataFrame:
    fqn = F.col("fqn")
    return t.view("fx_names").select(
        "no", "fqn", checks.is_object_name(fqn).alias("is_object"), checks.is_schema_name(fqn).alias("is_schema"),
        checks.is_catalog_name(names.catalog_of(fqn)).alias("is_catalog"),
    )


@query(
    "principal_checks",
    r"""SELECT no, principal, regexp_full_match(principal, '[a-zA-Z0-9_.@\-]+') AS is_safe,
      regexp_full_match(principal, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') AS is_email FROM fx_names""",
)
def _(t: Tables) -> DataFrame:
    p = F.col("principal")
    return t.view("fx_names").select("no", "principal", checks.is_principal(p).alias("is_safe"), checks.is_email(p).alias("is_email"))


@query(
    "dr_id_checks",
    """SELECT no, dr_id, regexp_full_match(dr_id, 'DR-[0-9]+') AS is_legacy,
      regexp_full_match(dr_id, 'DR-[0-9]+') OR regexp_full_match(dr_id, '[A-Za-z][A-Za-z0-9]{0,7}[0-9]{3,12}') AS is_valid FROM fx_names""",
)
def _(t: Tables) -> DataFrame:
    d = F.col("dr_id")
    return t.view("fx_names").select("no", "dr_id", checks.is_legacy_id(d).alias("is_legacy"), checks.is_request_id(d).alias("is_valid"))
