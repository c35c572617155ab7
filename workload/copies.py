"""Queries: copies of real tables, made, refreshed, changed and dropped in a sandbox."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandboxlake.operators import asof
from sandboxlake.plans import clone, runs
from sandboxlake.plans.clone import Sandbox
from workload.fixtures import NOW
from workload.registry import Tables, query
from workload.state import middle_version, new_state

SALES = ("customer", "lineitem", "orders", "part")


def source(table: str) -> str:
    return f"prod_main.sales.{table}"


def sandbox(t: Tables, tables=SALES) -> Sandbox:
    """A sandbox whose production schema holds the given tables."""
    box = Sandbox.fresh(t.spark)
    for table in tables:
        clone.register_source(box, source(table), t.path(table))
    clone.create_schema(box, "dev_main.copies")
    return box


def growing_source(t: Tables, box: Sandbox, table: str, row_keys: str | None = None) -> str:
    """A source of our own that can grow: a copy of a table, returned as its folder."""
    folder = f"{box.root}/source/{table}"
    t.base(table).write.parquet(folder)
    clone.register_source(box, source(table), folder, row_keys=row_keys)
    return folder


def read(box: Sandbox, fqn: str) -> DataFrame:
    return box.spark.table(box.table_name(fqn))


def rows_in(box: Sandbox, targets: list[tuple[str, ...]], names: str) -> DataFrame:
    """(names..., rows) for (names..., fqn) targets that exist."""
    parts = []
    for *labels, fqn in targets:
        columns = [F.lit(v).alias(n) for v, n in zip(labels, names.split(), strict=True)]
        parts.append(read(box, fqn).agg(F.count(F.lit(1)).alias("rows")).select(*columns, "rows"))
    return reduce(DataFrame.unionByName, parts)


# ---- single strategies -------------------------------------------------------------------------


@query("deep_clone", "SELECT * FROM orders")
def deep_clone(t: Tables) -> DataFrame:
    box = sandbox(t, ["orders"])
    clone.deep_clone(box, source("orders"), "dev_main.copies.orders")
    return read(box, "dev_main.copies.orders")


def _commit_source(t: Tables, box: Sandbox) -> str:
    folder = f"{box.root}/source/balances"
    t.view("fx_commits").write.parquet(folder)
    clone.register_source(box, source("balances"), folder, commit_keys="k")
    return folder


_AS_OF = """SELECT k, payload FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY commit_version DESC) AS rn FROM fx_commits {})
WHERE rn = 1 AND op <> 'delete'"""


@query("deep_clone_version", _AS_OF.format("WHERE commit_version <= (SELECT max(event_id) // 2 FROM events)"))
def _(t: Tables) -> DataFrame:
    box = sandbox(t, [])
    _commit_source(t, box)
    clone.deep_clone(box, source("balances"), "dev_main.copies.balances", "version", str(middle_version(t)))
    return read(box, "dev_main.copies.balances")


@query("view_clone_timestamp", _AS_OF.format("WHERE commit_ts <= TIMESTAMP '2024-01-16 07:30:00'"))
def _(t: Tables) -> DataFrame:
    box = sandbox(t, [])
    _commit_source(t, box)
    clone.view_clone(box, source("balances"), "dev_main.copies.balances", "timestamp", "2024-01-16T07:30:00")
    return read(box, "dev_main.copies.balances")


@query("view_clone", "SELECT * FROM customer")
def _(t: Tables) -> DataFrame:
    box = sandbox(t, ["customer"])
    clone.view_clone(box, source("customer"), "dev_main.copies.customer")
    return read(box, "dev_main.copies.customer")


@query("shallow_clone", "SELECT * FROM orders")
def _(t: Tables) -> DataFrame:
    box = sandbox(t, [])
    folder = growing_source(t, box, "orders")
    clone.shallow_clone(box, source("orders"), "dev_main.copies.orders")
    t.base("orders").withColumn("o_orderkey", -F.col("o_orderkey") - 1).write.mode("append").parquet(folder)
    t.spark.catalog.refreshTable(box.table_name(source("orders")))
    return read(box, "dev_main.copies.orders")


@query("shallow_clone_commits", _AS_OF.format(""))
def _(t: Tables) -> DataFrame:
    box = sandbox(t, [])
    folder = _commit_source(t, box)
    clone.shallow_clone(box, source("balances"), "dev_main.copies.balances")
    later = t.view("fx_commits").withColumn("commit_version", F.col("commit_version") + 10**12).withColumn("op", F.lit("delete"))
    later.write.mode("append").parquet(folder)
    t.spark.catalog.refreshTable(box.table_name(source("balances")))
    return read(box, "dev_main.copies.balances")


@query(
    "shallow_clone_overlay",
    """WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY commit_version DESC) AS rn FROM fx_order_changes) WHERE rn = 1)
    SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM fx_order_changes)
    UNION ALL SELECT o_orderkey, o_totalprice, o_orderpriority FROM latest WHERE op <> 'delete'""",
)
def overlay(t: Tables) -> DataFrame:
    box = sandbox(t, ["orders"])
    clone.shallow_clone(box, source("orders"), "dev_main.copies.orders")
    base = read(box, "dev_main.copies.orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return asof.overlay(base, t.view("fx_order_changes"), ["o_orderkey"])


@query(
    "shallow_clone_write",
    """WITH source AS (SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders)
    SELECT 'source' AS place, * FROM source
    UNION ALL SELECT 'clone', o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END,
      CASE WHEN o_orderkey % 10 = 0 THEN 'NONE' ELSE o_orderpriority END FROM source WHERE o_orderkey % 5 <> 1 OR o_orderkey % 10 = 6
    UNION ALL SELECT 'clone', -o_orderkey - 1, o_totalprice, o_orderpriority FROM source WHERE o_orderkey % 5 = 2""",
)
def _(t: Tables) -> DataFrame:
    """Changed, deleted, added and written again; deleted rows that come back; the source stays as it was."""
    box, target, columns = sandbox(t, []), "dev_main.copies.orders", ["o_orderkey", "o_totalprice", "o_orderpriority"]
    growing_source(t, box, "orders", row_keys="o_orderkey")
    clone.shallow_clone(box, source("orders"), target)
    orders, key = t.base("orders"), F.col("o_orderkey")
    dearer = orders.filter(key % 5 == 0).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    clone.write_clone(box, target, dearer)
    clone.write_clone(box, target, orders.filter(key % 5 == 1), "delete")
    clone.write_clone(box, target, orders.filter(key % 5 == 2).withColumn("o_orderkey", -key - 1))
    clone.write_clone(box, target, dearer.filter(key % 10 == 0).withColumn("o_orderpriority", F.lit("NONE")))
    clone.write_clone(box, target, orders.filter(key % 10 == 6))
    places = {"source": source("orders"), "clone": target}
    return reduce(DataFrame.unionByName, [read(box, fqn).select(F.lit(place).alias("place"), *columns) for place, fqn in places.items()])


@query(
    "schema_only_clone",
    "SELECT table_name, column_name, CAST(0 AS BIGINT) AS rows FROM information_schema.columns WHERE table_name IN ("
    + ", ".join(f"'{name}'" for name in SALES) + ")",
)
def _(t: Tables) -> DataFrame:
    box = sandbox(t)
    for table in SALES:
        clone.schema_only_clone(box, source(table), f"dev_main.copies.{table}")
    counted = rows_in(box, [(x, f"dev_main.copies.{x}") for x in SALES], "table_name")
    names = [(x, c) for x in SALES for c in read(box, f"dev_main.copies.{x}").columns]
    return counted.join(t.spark.createDataFrame(names, "table_name string, column_name string"), "table_name")


# ---- many copies -------------------------------------------------------------------------------

STRATEGIES = ("shallow_clone", "deep_clone", "view", "schema_only")


def _strategy_plan(t: Tables) -> DataFrame:
    """Every sales table with every strategy, and three plans that cannot work."""
    def row(src: str, strategy: str, target: str) -> tuple:
        return ("DR-1", src, target, "dev", strategy, "latest", None)

    rows = [row(source(x), s, f"dev_main.copies.{x}_{s}") for x in SALES for s in STRATEGIES]
    rows += [
        row(source("orders"), "symlink", "dev_main.copies.orders_symlink"),
        row(source("absent"), "deep_clone", "dev_main.copies.absent"),
        row(source("orders"), "deep_clone", "dev_main.copies.or`ders"),
    ]
    return t.spark.createDataFrame(
        rows, "dr_id string, source_fqn string, target_fqn string, target_environment string, "
        "clone_strategy string, clone_revision_mode string, clone_revision_value string",
    )


@query(
    "clone_outcomes",
    "WITH ok AS (" + " UNION ALL ".join(
        f"SELECT 'prod_main.sales.{x}' AS source_fqn, s AS strategy, true AS success, CASE WHEN s = 'schema_only' THEN 0 ELSE (SELECT count(*) FROM {x}) END AS rows FROM (SELECT unnest(['shallow_clone', 'deep_clone', 'view', 'schema_only']) AS s)"
        for x in SALES
    ) + """) SELECT source_fqn, strategy, success, CAST(rows AS BIGINT) AS rows FROM ok
    UNION ALL SELECT 'prod_main.sales.orders', 'symlink', false, -1 UNION ALL SELECT 'prod_main.sales.absent', 'deep_clone', false, -1
    UNION ALL SELECT 'prod_main.sales.orders', 'deep_clone', false, -1""",
)
def clone_outcomes(t: Tables) -> DataFrame:
    box = sandbox(t)
    done = clone.clone_all(box, _strategy_plan(t))
    counted = rows_in(
        box, [(f"dev_main.copies.{x}_{s}", f"dev_main.copies.{x}_{s}") for x in SALES for s in STRATEGIES], "target_fqn"
    )
    return done.join(counted, "target_fqn", "left").select("source_fqn", "strategy", "success", F.coalesce("rows", F.lit(-1)).cast("bigint").alias("rows"))


# ---- runs --------------------------------------------------------------------------------------


def _requests(t: Tables) -> DataFrame:
    none = F.lit(None)
    return t.view("fx_run_requests").select(
        "dr_id", "description", "qa_enabled", F.array("developer", "second_developer").alias("developers"), F.array("tester").alias("qa_users"),
        F.lit("{}").alias("config_json"), none.cast("string").alias("target_catalog"), F.lit("latest").alias("rev_mode"),
        none.cast("bigint").alias("rev_version"), none.cast("string").alias("rev_timestamp"), F.lit("2099-01-01").cast("date").alias("expiration_date"),
    )


def _dr_ids(t: Tables, description: str) -> DataFrame:
    return t.view("fx_run_requests").filter(F.col("description") == description)


def _manifest(t: Tables) -> DataFrame:
    """Each request uses the four tables, which table with which strategy follows from its orders, and one that is not there."""
    listed = t.view("fx_run_objects")
    absent = t.view("fx_run_requests").select("dr_id", F.lit("absent").alias("table_name"), F.lit("deep_clone").alias("clone_strategy"))
    return listed.unionByName(absent).select(
        "dr_id", F.concat(F.lit(source("")), "table_name").alias("fqn"), F.lit("table").alias("object_type"), F.lit("READ_ONLY").alias("access_mode"),
        "clone_strategy", F.lit(None).cast("double").alias("estimated_size_gb"),
    )


def provisioned(t: Tables, growing: bool = False) -> tuple[Sandbox, object, runs.Run]:
    """Two requests, provisioned."""
    box = sandbox(t, [] if growing else SALES)
    if growing:
        for table in SALES:
            growing_source(t, box, table)
    state, objects = new_state(t), _manifest(t)
    done = runs.provision(box, state, _requests(t), objects, _headers(objects), NOW)
    return box, state, done


_KEY = ["dr_id", "target_environment", "source_fqn"]


def _targets(state) -> list[tuple[str, ...]]:
    """(request, environment, source, target) of all object rows; a handful of them."""
    return [tuple(r) for r in state.current("objects").select(*_KEY, "target_fqn").collect()]


def _target_rows(box: Sandbox, state) -> DataFrame:
    there = [x for x in _targets(state) if box.spark.catalog.tableExists(box.table_name(x[-1]))]
    return rows_in(box, there, " ".join(_KEY))


_ENVS = "(SELECT dr_id, 'dev' AS target_environment FROM fx_run_requests UNION ALL SELECT dr_id, 'qa' FROM fx_run_requests WHERE qa_enabled)"
_SIZES = "(" + " UNION ALL ".join(f"SELECT '{x}' AS table_name, count(*) AS n FROM {x}" for x in SALES) + ")"


def _expected(rows: dict[str, str]) -> str:
    """SQL (dr_id, target_environment, source_fqn, clone_strategy, rows) of the provisioned objects; ``rows`` by strategy."""
    cases = " ".join(f"WHEN '{s}' THEN {count}" for s, count in rows.items())
    return f"""SELECT dr_id, target_environment, 'prod_main.sales.' || table_name AS source_fqn, clone_strategy,
      CAST(CASE clone_strategy {cases} END AS BIGINT) AS rows FROM {_ENVS} JOIN fx_run_objects USING (dr_id) JOIN {_SIZES} USING (table_name)"""


_ABSENT = f"SELECT dr_id, target_environment, 'prod_main.sales.absent' AS source_fqn, 'deep_clone' AS clone_strategy, CAST(NULL AS BIGINT) AS rows FROM {_ENVS}"


_COUNT = dict.fromkeys(STRATEGIES, "n") | {"schema_only": "0"}


@query(
    "provision_end_to_end",
    f"""SELECT *, CASE WHEN source_fqn LIKE '%absent' THEN 'FAILED' ELSE 'PROVISIONED' END AS status, 'ACTIVE' AS request_status,
      'PARTIAL_SUCCESS' AS audit_status FROM (SELECT dr_id, target_environment, source_fqn, clone_strategy, CAST(rows AS VARCHAR) AS rows FROM ({_expected(_COUNT)} UNION ALL {_ABSENT}))""",
)
def provision_end_to_end(t: Tables) -> DataFrame:
    box, state, _ = provisioned(t)
    requests = state.current("requests").select("dr_id", F.col("status").alias("request_status"))
    audit = state.current("audit").filter("action = 'PROVISION' AND get_json_object(action_detail, '$.phase') = 'complete'").select(
        "dr_id", F.col("status").alias("audit_status")
    )
    return (
        state.current("objects").join(_target_rows(box, state), _KEY, "left")
        .join(requests, "dr_id").join(audit, "dr_id")
        .select(*_KEY, "clone_strategy", F.col("rows").cast("string").alias("rows"), "status", "request_status", "audit_status")
    )


def _headers(objects: DataFrame) -> DataFrame:
    return objects.groupBy("dr_id").agg(F.count(F.lit(1)).alias("total_objects")).withColumn("review_required", F.lit(False))


def _grow(t: Tables, box: Sandbox) -> None:
    """Append every row of every source once more."""
    for table in SALES:
        t.base(table).write.mode("append").parquet(f"{box.root}/source/{table}")
        t.spark.catalog.refreshTable(box.table_name(source(table)))


def _refreshed(t: Tables, mode: str, selected: DataFrame | None = None):
    box, state, _ = provisioned(t, growing=True)
    _grow(t, box)
    run = runs.refresh(box, state, _requests(t), mode, "1998-06-16 12:00:00", selected=selected)
    return box, state, run


_TWICE = dict.fromkeys(STRATEGIES, "2 * n") | {"schema_only": "0"}


def _with_strategy(box: Sandbox, state) -> DataFrame:
    objects = state.current("objects").select(*_KEY, "clone_strategy")
    return _target_rows(box, state).join(objects, _KEY)


@query(
    "reprovision",
    f"""SELECT *, CASE WHEN source_fqn LIKE '%absent' THEN 'FAILED' ELSE 'PROVISIONED' END AS status, 'ACTIVE' AS request_status, true AS same_start
    FROM (SELECT dr_id, target_environment, source_fqn, clone_strategy, CAST(rows AS VARCHAR) AS rows FROM ({_expected(_TWICE)} UNION ALL {_ABSENT}))""",
)
def _(t: Tables) -> DataFrame:
    """Provisioned, and provisioned again after the sources have grown: copies are replaced, the request keeps its start."""
    box, state, _ = provisioned(t, growing=True)
    _grow(t, box)
    objects = _manifest(t)
    runs.provision(box, state, _requests(t), objects, _headers(objects), "1998-06-16 12:00:00")
    started = (F.col("created_at") == F.lit(NOW).cast("timestamp_ntz")).alias("same_start")
    live = state.current("requests").select("dr_id", F.col("status").alias("request_status"), started)
    return (
        state.current("objects").join(_target_rows(box, state), _KEY, "left").join(live, "dr_id")
        .select(*_KEY, "clone_strategy", F.col("rows").cast("string").alias("rows"), "status", "request_status", "same_start")
    )


@query("refresh_incremental", _expected(_TWICE))
def _(t: Tables) -> DataFrame:
    box, state, _ = _refreshed(t, "incremental")
    return _with_strategy(box, state)


@query("refresh_full", _expected(_TWICE))
def _(t: Tables) -> DataFrame:
    box, state, _ = _refreshed(t, "full")
    return _with_strategy(box, state)


_CHOSEN = dict.fromkeys(("shallow_clone", "deep_clone"), "CASE WHEN table_name IN ('lineitem', 'orders') THEN 2 * n ELSE n END")


@query("refresh_selective", _expected(_TWICE | _CHOSEN))
def _(t: Tables) -> DataFrame:
    chosen = t.spark.createDataFrame([(source(x),) for x in ("lineitem", "orders")], "source_fqn string")
    box, state, _ = _refreshed(t, "selective", chosen)
    return _with_strategy(box, state)


@query(
    "refresh_outcomes",
    f"""SELECT dr_id, target_environment, source_fqn, clone_strategy, clone_strategy IN ('shallow_clone', 'deep_clone') AND source_fqn NOT LIKE '%absent' AS refreshed,
      'PARTIAL_SUCCESS' AS audit_status FROM ({_expected(_COUNT)} UNION ALL {_ABSENT})""",
)
def _(t: Tables) -> DataFrame:
    _, state, run = _refreshed(t, "incremental")
    stamped = F.col("last_refreshed_at") == F.lit("1998-06-16 12:00:00").cast("timestamp_ntz")
    return state.current("objects").join(run.status.select("dr_id", "audit_status"), "dr_id").select(
        "dr_id", "target_environment", "source_fqn", "clone_strategy", F.coalesce(stamped, F.lit(False)).alias("refreshed"), "audit_status"
    )


def _of(description: str) -> str:
    return f"(SELECT * FROM fx_run_requests WHERE description = '{description}')"


def _additions(requests: DataFrame, *fqns: str) -> DataFrame:
    none = F.lit(None)
    return requests.select(
        "dr_id", F.explode(F.array(*[F.lit(x) for x in fqns])).alias("fqn"), F.lit("table").alias("object_type"), F.lit("READ_ONLY").alias("access_mode"),
        F.lit("deep_clone").alias("clone_strategy"), none.cast("double").alias("estimated_size_gb"),
    )


def _rows_of(box: Sandbox, state, table: str) -> DataFrame:
    return rows_in(box, [x for x in _targets(state) if x[2] == source(table)], " ".join(_KEY))


@query(
    "modify_add",
    f"""SELECT dr_id, 'dev' AS target_environment, 'prod_main.sales.supplier' AS source_fqn, 'PROVISIONED' AS status,
      (SELECT count(*) FROM supplier) AS rows FROM {_of('filled')}""",
)
def _(t: Tables) -> DataFrame:
    box, state, _ = provisioned(t)
    clone.register_source(box, source("supplier"), t.path("supplier"))
    runs.modify(box, state, NOW, additions=_additions(_dr_ids(t, "filled"), source("supplier"), "short.name"))
    return state.current("objects").join(_rows_of(box, state, "supplier"), _KEY).select(*_KEY, "status", "rows")


@query(
    "modify_remove",
    f"""SELECT dr_id, target_environment, source_fqn, CASE WHEN source_fqn LIKE '%absent' THEN 'FAILED'
      WHEN clone_strategy IN ('view', 'deep_clone') AND dr_id IN (SELECT dr_id FROM {_of('filled')}) THEN 'DROPPED' ELSE 'PROVISIONED' END AS status
    FROM ({_expected(_COUNT)} UNION ALL {_ABSENT})""",
)
def _(t: Tables) -> DataFrame:
    """The filled request loses what it has as a view or a full copy."""
    box, state, _ = provisioned(t)
    gone = t.view("fx_run_objects").filter("clone_strategy IN ('view', 'deep_clone')").join(_dr_ids(t, "filled").select("dr_id"), "dr_id")
    runs.modify(box, state, NOW, removals=gone.select("dr_id", F.concat(F.lit(source("")), "table_name").alias("source_fqn")))
    return state.current("objects").select(*_KEY, "status")


@query(
    "modify_outcomes",
    f"""SELECT dr_id, 'add_objects:false;add_users:true;change_expiration:true;remove_objects:true;remove_users:true' AS actions,
      'PARTIAL_SUCCESS' AS status, CASE WHEN qa_enabled THEN 3 ELSE 2 END::BIGINT AS statements FROM {_of('filled')}
    UNION ALL SELECT dr_id, 'change_expiration:false', 'FAILED', 0 FROM {_of('open')}""",
)
def _(t: Tables) -> DataFrame:
    """A tester becomes a developer of the filled request; whether there is a grant to revoke depends on its qa environment."""
    box, state, _ = provisioned(t)
    filled, both = _dr_ids(t, "filled"), t.view("fx_run_requests")
    users = filled.select("dr_id", F.inline(F.array(
        F.struct(F.lit("dev").alias("environment"), F.lit("grant").alias("action"), F.col("tester").alias("principal")),
        F.struct(F.lit("qa").alias("environment"), F.lit("revoke").alias("action"), F.col("tester").alias("principal")),
    )))
    ends = F.when(F.col("description") == "filled", "1998-09-01").otherwise("1998-01-01").cast("date").alias("expiration_date")
    run = runs.modify(
        box, state, NOW, additions=_additions(filled, source("nowhere")),
        removals=filled.select("dr_id", F.lit(source("orders")).alias("source_fqn")), users=users, expirations=both.select("dr_id", ends),
    )
    audit = state.current("audit").filter("action = 'MODIFY'")
    statements = run.grants.unionByName(run.revokes).groupBy("dr_id").agg(F.count(F.lit(1)).alias("n"))
    return audit.select("dr_id", _actions(), "status").join(statements, "dr_id", "left").select(
        "dr_id", "actions", "status", F.coalesce("n", F.lit(0)).cast("bigint").alias("statements")
    )


def _actions():
    """The actions of an audit row as text."""
    detail = F.from_json("action_detail", "actions array<struct<action: string, success: boolean>>")["actions"]
    return F.array_join(F.transform(detail, lambda a: F.concat_ws(":", a["action"], a["success"].cast("string"))), ";").alias("actions")


@query(
    "cleanup_run",
    f"""SELECT *, description = 'open' AND status = 'PROVISIONED' AS still_there, CASE WHEN description = 'filled' THEN 'CLEANED_UP' ELSE 'ACTIVE' END AS request_status
    FROM (SELECT dr_id, target_environment, source_fqn, description,
      CASE WHEN description = 'filled' THEN 'DROPPED' WHEN source_fqn LIKE '%absent' THEN 'FAILED' ELSE 'PROVISIONED' END AS status
      FROM ({_expected(_COUNT)} UNION ALL {_ABSENT}) JOIN (SELECT dr_id, description FROM fx_run_requests) USING (dr_id))""",
)
def _(t: Tables) -> DataFrame:
    """The filled request is taken down, the open one stays as it is."""
    box, state, _ = provisioned(t)
    names = _targets(state)
    runs.clean_up(box, state, _dr_ids(t, "filled"), NOW)
    found = [(*x[:3], t.spark.catalog.tableExists(box.table_name(x[3]))) for x in names]
    there = t.spark.createDataFrame(found, "dr_id string, target_environment string, source_fqn string, still_there boolean")
    requests = state.current("requests").select("dr_id", "description", F.col("status").alias("request_status"))
    return state.current("objects").select(*_KEY, "status").join(there, _KEY).join(requests, "dr_id")


@query(
    "modify_add_streams",
    f"""SELECT dr_id, 'dev' AS target_environment, 'prod_main.sales.supplier' AS source_fqn, 'PROVISIONED' AS status, 'add_streams:true' AS actions,
      (SELECT count(*) FROM supplier) AS rows FROM fx_run_requests""",
)
def _(t: Tables) -> DataFrame:
    """Both requests get a stream of their own that reads the suppliers and the orders, which they have already."""
    box, state, _ = provisioned(t)
    clone.register_source(box, source("supplier"), t.path("supplier"))
    requests = t.view("fx_run_requests")
    inventory = requests.select(F.lit("job").alias("kind"), F.concat(F.lit("nightly-"), "description").alias("name"), F.col("orders").cast("string").alias("resource_id"))
    runs.modify(
        box, state, NOW, streams=requests.select("dr_id", F.concat(F.lit("nightly-"), "description").alias("name")), lineage=t.view("fx_run_edges"),
        inventory=inventory, revision=("latest", None),
    )
    audit = state.current("audit").filter("action = 'MODIFY'").select("dr_id", _actions())
    return state.current("objects").join(_rows_of(box, state, "supplier"), _KEY).join(audit, "dr_id").select(*_KEY, "status", "actions", "rows")
