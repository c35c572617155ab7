"""Copying objects: full copies, file-sharing copies, read-through views and empty tables.

A copy is made of plain catalog statements and one write job.  Where the catalog has no time travel
of its own, a source table that carries ``commit_version``, ``commit_ts`` and ``op`` and names its
keys in the table property ``commit_keys`` can be read as of a version or a time.
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sandboxlake import fixed, schemas
from sandboxlake.operators.asof import COMMIT_COLUMNS
from sandboxlake.session import shared_dir
from sandboxlake.sources.files import claim_next, clock_tick, remove_folder

OUTCOMES_PER_WRITE = 1000
_STAGED, _RETIRED = "__staged_copy", "__retired_copy"  # behind the name of a target that is being replaced
_READY = "copy_is_ready"


class CloneError(Exception):
    """A copy that cannot be planned: an unsafe name, an unknown strategy or revision."""


@dataclass(frozen=True)
class Sandbox:
    """Where copies go.  A session catalog has two name levels, so catalog and schema are joined there.

    ``namespace`` keeps several sandboxes apart in one catalog.
    """

    spark: SparkSession
    root: str
    namespace: str = ""
    joined_names: bool = True
    max_parallel: int = fixed.MAX_PARALLEL_COPIES
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def fresh(cls, spark: SparkSession) -> Sandbox:
        """A new sandbox in a new folder of the shared directory."""
        tag = uuid.uuid4().hex[:12]
        return cls(spark, f"{shared_dir(spark)}/sandbox-{tag}", f"sb_{tag}__")

    def schema_name(self, schema_fqn: str) -> str:
        if not re.match(fixed.TWO_PART_NAME, schema_fqn):
            raise CloneError(f"not a safe two-part name: {schema_fqn!r}")
        if not self.joined_names:
            return schema_fqn
        catalog, schema = schema_fqn.split(".")
        joined = f"{catalog}__{schema}"
        # where the joint could be looked for in several places, the length of the catalog's name tells which one it is
        where = f"__{len(catalog)}" if len(re.findall("(?=__)", joined)) > 1 else ""
        return f"{self.namespace}{joined}{where}"

    def table_name(self, fqn: str) -> str:
        if not re.match(fixed.THREE_PART_NAME, fqn):
            raise CloneError(f"not a safe three-part name: {fqn!r}")
        schema, name = fqn.rsplit(".", 1)
        return f"{self.schema_name(schema)}.{name}"

    def folder(self, fqn: str) -> str:
        """A new folder for one copy of an object."""
        return f"{self.home(fqn)}/{uuid.uuid4().hex}"

    def home(self, fqn: str) -> str:
        """The folder with all copies of an object, those being made or given up too."""
        return f"{self.root}/data/{fqn.removesuffix(_STAGED).removesuffix(_RETIRED).replace('.', '/')}"


# ---- schemas -----------------------------------------------------------------------------------


def create_schema(sandbox: Sandbox, schema_fqn: str) -> None:
    name = sandbox.schema_name(schema_fqn)
    sandbox.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name} LOCATION '{sandbox.root}/schemas/{name}'")


def drop_schema(sandbox: Sandbox, schema_fqn: str) -> None:
    sandbox.spark.sql(f"DROP SCHEMA IF EXISTS {sandbox.schema_name(schema_fqn)} CASCADE")


def register_source(sandbox: Sandbox, fqn: str, path: str, commit_keys: str | None = None, row_keys: str | None = None) -> None:
    """Make a Parquet folder known as a source table.

    ``commit_keys`` are the keys of a commit-stamped table, ``row_keys`` those of a plain one: names with commas between.
    """
    create_schema(sandbox, fqn.rsplit(".", 1)[0])
    known = {"commit_keys": commit_keys, "row_keys": row_keys}
    listed = ", ".join(f"'{k}' = '{v}'" for k, v in known.items() if v)
    properties = f" TBLPROPERTIES ({listed})" if listed else ""
    sandbox.spark.sql(f"CREATE TABLE {sandbox.table_name(fqn)} USING parquet LOCATION '{path}'{properties}")


# ---- reading a source at a revision ------------------------------------------------------------


def _property(spark: SparkSession, table: str, name: str) -> str | None:
    row = spark.sql(f"SHOW TBLPROPERTIES {table}").filter(f"key = '{name}'").first()
    return row["value"] if row else None


def _bound(spark: SparkSession, table: str, mode: str, value: str | None) -> str | None:
    """The predicate on the commit columns that a revision stands for."""
    if mode == "latest":
        return None
    if mode == "version" and value is not None:
        return f"commit_version <= {int(value)}"
    if mode == "timestamp" and value is not None:
        kind = spark.table(table).schema["commit_ts"].dataType.simpleString()
        return "commit_ts <= CAST(CAST('{}' AS TIMESTAMP) AS {})".format(value.replace("'", ""), kind)
    raise CloneError(f"unknown revision {mode!r} {value!r}")


def _as_of_query(table: str, columns: list[str], keys: str, bound: str | None) -> str:
    wanted = ", ".join(f"`{c}`" for c in columns if c not in COMMIT_COLUMNS)
    where = f" WHERE {bound}" if bound else ""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY commit_version DESC) AS _rn FROM {table}{where}"
    return f"SELECT {wanted} FROM ({ranked}) WHERE _rn = 1 AND op <> 'delete'"


def source_query(sandbox: Sandbox, source_fqn: str, mode: str = "latest", value: str | None = None) -> str:
    """SELECT over the source at a revision, for a view or for a copy job."""
    spark, table = sandbox.spark, sandbox.table_name(source_fqn)
    keys = _property(spark, table, "commit_keys")
    if keys:
        return _as_of_query(table, spark.table(table).columns, keys, _bound(spark, table, mode, value))
    if mode == "latest":
        return f"SELECT * FROM {table}"
    if mode == "version" and value is not None:
        return f"SELECT * FROM {table} VERSION AS OF {int(value)}"
    if mode == "timestamp" and value is not None:
        return "SELECT * FROM {} TIMESTAMP AS OF '{}'".format(table, value.replace("'", ""))
    raise CloneError(f"unknown revision {mode!r} {value!r}")


@dataclass(frozen=True)
class Pin:
    """The state of a source's files at a time: that time in milliseconds, and how many files and bytes were there."""

    until: int
    files: int
    bytes: int

    @property
    def predicate(self) -> str:
        return f"_metadata.file_modification_time <= timestamp_millis({self.until})"


def _files_until(spark: SparkSession, folder: str, until: int) -> tuple[int, int]:
    """Number and bytes of the files dated up to a time.  Files are listed by Spark's tasks; none is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("modificationTime", "length")
    row = listed.filter(f"modificationTime <= timestamp_millis({until})").selectExpr("count(1) AS files", "coalesce(sum(length), 0) AS bytes").first()
    return row["files"], row["bytes"]


def pin_files(sandbox: Sandbox, source_fqn: str) -> Pin:
    """Pin what the source's folder holds now.  Files that are written later are dated later, by the file system's own clock."""
    spark = sandbox.spark
    until = clock_tick(spark, sandbox.root)
    return Pin(until, *_files_until(spark, _location(spark, sandbox.table_name(source_fqn)), until))


def pinned_query(sandbox: Sandbox, source_fqn: str, mode: str = "latest", value: str | None = None) -> tuple[str, Pin | None]:
    """SELECT that keeps showing what the source holds now, and the pin it rests on.

    The pin is a predicate on the time of a file.  It comes from the file listing, so no row is read; later files fall
    outside it, no list of files goes anywhere, and Spark applies it when it lists files.
    """
    spark, table = sandbox.spark, sandbox.table_name(source_fqn)
    keys = _property(spark, table, "commit_keys")
    if not keys and mode != "latest":
        return source_query(sandbox, source_fqn, mode, value), None
    pin = pin_files(sandbox, source_fqn)
    if not keys:
        return f"SELECT * FROM {table} WHERE {pin.predicate}", pin
    bound = _bound(spark, table, mode, value)
    wanted = pin.predicate if bound is None else f"{pin.predicate} AND {bound}"
    return _as_of_query(table, spark.table(table).columns, keys, wanted), pin


# ---- the four strategies -----------------------------------------------------------------------


def deep_clone(sandbox: Sandbox, source: str, target: str, mode: str = "latest", value: str | None = None) -> None:
    """Copy all rows; the partitioning of the source is kept."""
    spark, folder = sandbox.spark, sandbox.folder(target)
    rows = spark.sql(source_query(sandbox, source, mode, value))
    parts = [c.name for c in spark.catalog.listColumns(sandbox.table_name(source)) if c.isPartition]
    if parts and _property(spark, sandbox.table_name(source), "commit_keys"):
        rows = rows.hint("rebalance", *parts)  # after the as-of shuffle: few files per partition, big ones split
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*parts) if parts else writer).parquet(folder)
    _point_table(sandbox, target, folder, rows, parts)


def _point_table(sandbox: Sandbox, target: str, folder: str, rows: DataFrame, parts: list[str]) -> None:
    """Create the target over ``folder``, or repoint it there; the old data goes only after that."""
    spark, table = sandbox.spark, sandbox.table_name(target)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        by = f" PARTITIONED BY ({', '.join(f'`{p}`' for p in parts)})" if parts else ""
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet{by} LOCATION '{folder}'")
        if parts:
            spark.catalog.recoverPartitions(table)
        return
    if parts or [(f.name, f.dataType) for f in spark.table(table).schema.fields] != [
        (f.name, f.dataType) for f in rows.schema.fields
    ]:
        drop_object(sandbox, target + _STAGED)
        _point_table(sandbox, target + _STAGED, folder, rows, parts)
        _swap_in(sandbox, target)
        return
    old = _location(spark, table)
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{folder}'")
    spark.catalog.refreshTable(table)
    if old:
        remove_folder(spark, sandbox.root, old)


def shallow_clone(sandbox: Sandbox, source: str, target: str, mode: str = "latest", value: str | None = None) -> None:
    """Share the files of the source as they are now; later source files do not show.

    The target can be written to (``write_clone``): its changes lie in a log of its own, which the view lays over the
    pinned rows by key.  Where the source names no keys, rows can only be added.
    """
    spark, table = sandbox.spark, sandbox.table_name(source)
    query, pin = pinned_query(sandbox, source, mode, value)
    keys = _property(spark, table, "commit_keys") or _property(spark, table, "row_keys")
    base = spark.sql(query)
    log, old = sandbox.folder(target), _change_log(sandbox, target)
    stamped = base.limit(0).selectExpr("*", "0L AS commit_version", "'' AS op")
    stamped.write.parquet(log)  # an empty file, which carries the schema
    known = {"pinned_source": source, "change_log": log, "change_keys": keys}
    if pin:
        known |= {"pinned_until": pin.until, "pinned_files": pin.files, "pinned_bytes": pin.bytes}
    listed = ", ".join(f"'{k}' = '{v}'" for k, v in known.items() if v is not None)
    spark.sql(
        f"CREATE OR REPLACE VIEW {sandbox.table_name(target)} TBLPROPERTIES ({listed}) AS {_written_over(query, base.columns, log, keys)}"
    )
    if old:
        remove_folder(spark, sandbox.root, old)


def _written_over(base: str, columns: list[str], log: str, keys: str | None) -> str:
    """The rows of ``base`` with the newest change of each key laid over them."""
    wanted = ", ".join(f"`{c}`" for c in columns)
    if not keys:
        return f"SELECT {wanted} FROM ({base}) UNION ALL SELECT {wanted} FROM parquet.`{log}`"
    names = [k.strip(" `") for k in keys.split(",")]
    listed = ", ".join(f"`{k}`" for k in names)
    same = " AND ".join(f"b.`{k}` <=> c.`{k}`" for k in names)
    newest = f"SELECT *, row_number() OVER (PARTITION BY {listed} ORDER BY commit_version DESC) AS _rn FROM parquet.`{log}`"
    return (
        f"SELECT {wanted} FROM ({base}) b LEFT ANTI JOIN (SELECT DISTINCT {listed} FROM parquet.`{log}`) c ON {same} "
        f"UNION ALL SELECT {wanted} FROM ({newest}) WHERE _rn = 1 AND op <> 'delete'"
    )


def _change_log(sandbox: Sandbox, target: str) -> str | None:
    table = sandbox.table_name(target)
    return _property(sandbox.spark, table, "change_log") if sandbox.spark.catalog.tableExists(table) else None


def write_clone(sandbox: Sandbox, target: str, rows: DataFrame, op: str = "upsert") -> int:
    """Write to a shallow clone: upsert whole rows, or delete the rows with the keys of ``rows``.  The source is not touched.

    Returns the number of the write.  Numbers are claimed, so of two writes of a key the one with the later number counts;
    in one write, keys have to be unique.
    """
    spark = sandbox.spark
    log = _change_log(sandbox, target)
    if log is None:
        raise CloneError(f"not a shallow clone: {target}")
    if op not in ("upsert", "delete"):
        raise CloneError(f"unknown change: {op!r}")
    keys = _property(spark, sandbox.table_name(target), "change_keys")
    if op == "delete" and not keys:
        raise CloneError(f"the source of {target} names no keys, so rows can only be added")
    fields = spark.table(sandbox.table_name(target)).schema.fields
    needed = [f.name for f in fields] if op == "upsert" else [k.strip(" `") for k in keys.split(",")]
    missing = set(needed) - set(rows.columns)
    if missing:
        raise CloneError(f"columns are missing: {', '.join(sorted(missing))}")
    number = claim_next(spark, f"{log}/_versions")
    rows.select(
        *[(F.col(f"`{f.name}`") if f.name in needed else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields],
        F.lit(number).cast("bigint").alias("commit_version"), F.lit(op).alias("op"),
    ).write.mode("append").parquet(log)
    return number


def pin_is_whole(sandbox: Sandbox, target: str) -> bool:
    """Whether a shallow clone still rests on the very files it was made of: as many of them, with as many bytes."""
    spark, view = sandbox.spark, sandbox.table_name(target)
    until = _property(spark, view, "pinned_until")
    if until is None:
        return True
    source = sandbox.table_name(_property(spark, view, "pinned_source"))
    pinned = int(_property(spark, view, "pinned_files")), int(_property(spark, view, "pinned_bytes"))
    return _files_until(spark, _location(spark, source), int(until)) == pinned


def check_pins(sandbox: Sandbox, objects: DataFrame) -> DataFrame:
    """Outcome rows for shallow clones: failed where files they rest on are gone."""
    def check(row: Row) -> None:
        if not pin_is_whole(sandbox, row.target_fqn):
            raise CloneError(f"source files are gone: {row.source_fqn}")

    return run_tasks(sandbox, objects.filter("clone_strategy = 'shallow_clone' AND status = 'PROVISIONED'"), check, "check")


def view_clone(sandbox: Sandbox, source: str, target: str, mode: str = "latest", value: str | None = None) -> None:
    """Read through to the source."""
    sandbox.spark.sql(
        f"CREATE OR REPLACE VIEW {sandbox.table_name(target)} AS {source_query(sandbox, source, mode, value)}"
    )


def schema_only_clone(sandbox: Sandbox, source: str, target: str, mode: str = "latest", value: str | None = None) -> None:
    """An empty table with the columns of the source.  The revision plays no part."""
    sandbox.spark.sql(f"CREATE TABLE {sandbox.table_name(target)} LIKE {sandbox.table_name(source)} USING parquet")


_CLONES: dict[str, Callable] = {
    "shallow_clone": shallow_clone,
    "deep_clone": deep_clone,
    "view": view_clone,
    "schema_only": schema_only_clone,
}


def clone_object(sandbox: Sandbox, row: Row) -> None:
    """Make one copy-plan row real.

    A target that is already there is an error, as for CREATE, unless the row says ``replaces``: that its request
    owns the target.
    """
    if row.clone_strategy not in _CLONES:
        raise CloneError(f"unknown clone strategy: {row.clone_strategy!r}")
    source = sandbox.table_name(row.source_fqn)
    target = sandbox.table_name(row.target_fqn)
    if not sandbox.spark.catalog.tableExists(source):
        raise CloneError(f"source does not exist: {row.source_fqn}")
    if row.asDict().get("replaces"):
        replace_object(sandbox, row)
        return
    if sandbox.spark.catalog.tableExists(target):
        raise CloneError(f"target already exists: {row.target_fqn}")
    _clone(sandbox, row, row.target_fqn)


def _clone(sandbox: Sandbox, row: Row, target: str) -> None:
    _CLONES[row.clone_strategy](sandbox, row.source_fqn, target, row.clone_revision_mode, row.clone_revision_value)


# ---- replacing a target ------------------------------------------------------------------------


def replace_object(sandbox: Sandbox, row: Row) -> None:
    """Make a copy beside the target, then put it in the target's place.  If the copy fails, the target stays as it was.

    What has been reached is told by names in the catalog, so a run that broke off is ended or undone by the next one:
    a staged copy without its mark is unfinished, with it it is to take the target's place; a retired copy is
    what the target was.
    """
    end_swap(sandbox, row.target_fqn)
    _clone(sandbox, row, row.target_fqn + _STAGED)
    _swap_in(sandbox, row.target_fqn)


def _rename(sandbox: Sandbox, fqn: str, new: str) -> None:
    """Rename a table or view; its data stay where they are."""
    spark, table = sandbox.spark, sandbox.table_name(fqn)
    kind = "VIEW" if spark.catalog.getTable(table).tableType == "VIEW" else "TABLE"
    spark.sql(f"ALTER {kind} {table} RENAME TO {sandbox.table_name(new)}")


def _swap_in(sandbox: Sandbox, target: str) -> None:
    """Mark the staged copy of a target as whole, and put it in the target's place."""
    spark, staged = sandbox.spark, sandbox.table_name(target + _STAGED)
    kind = "VIEW" if spark.catalog.getTable(staged).tableType == "VIEW" else "TABLE"
    spark.sql(f"ALTER {kind} {staged} SET TBLPROPERTIES ('{_READY}' = 'true')")
    end_swap(sandbox, target)


def end_swap(sandbox: Sandbox, target: str) -> None:
    """End what was begun: put a whole staged copy in the target's place, or drop an unfinished one."""
    catalog, staged, retired = sandbox.spark.catalog, target + _STAGED, target + _RETIRED
    if catalog.tableExists(sandbox.table_name(staged)):
        if _property(sandbox.spark, sandbox.table_name(staged), _READY):
            if catalog.tableExists(sandbox.table_name(target)):
                drop_object(sandbox, retired)
                _rename(sandbox, target, retired)
            _rename(sandbox, staged, target)
        else:
            drop_object(sandbox, staged)
    if catalog.tableExists(sandbox.table_name(target)):
        drop_object(sandbox, retired)


def refresh_object(sandbox: Sandbox, row: Row, full: bool) -> None:
    """Copy an object again.

    Full: made anew beside the old one, which goes only then.  Otherwise copies and views are replaced in place, with the
    new data written before the old goes, and an empty table is emptied.
    """
    if row.clone_strategy not in _CLONES:
        raise CloneError(f"unknown clone strategy: {row.clone_strategy!r}")
    end_swap(sandbox, row.target_fqn)
    if full:
        replace_object(sandbox, row)
    elif row.clone_strategy == "schema_only":
        sandbox.spark.sql(f"TRUNCATE TABLE {sandbox.table_name(row.target_fqn)}")
    else:
        _clone(sandbox, row, row.target_fqn)


def _location(spark: SparkSession, table: str) -> str | None:
    row = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").first()
    return row["data_type"] if row else None


def drop_object(sandbox: Sandbox, target: str) -> None:
    """Drop a view or a table with its data; nothing happens when it is not there."""
    spark, table = sandbox.spark, sandbox.table_name(target)
    if not spark.catalog.tableExists(table):
        return
    kind = spark.catalog.getTable(table).tableType
    if kind == "VIEW":
        folder = _property(spark, table, "change_log")
        spark.sql(f"DROP VIEW IF EXISTS {table}")
    else:
        folder = _location(spark, table) if kind == "EXTERNAL" else None
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    if folder and f"{sandbox.home(target).removeprefix(sandbox.root)}/" in folder:
        remove_folder(spark, sandbox.root, folder)


# ---- many objects at once ----------------------------------------------------------------------


def _tasks_done(
    sandbox: Sandbox, rows: Iterator[Row], work: Callable[[Row], None], action: str
) -> Iterator[tuple]:
    """Run ``work`` on the rows with bounded parallelism; outcomes come in row order."""
    context = sandbox.spark.sparkContext

    def one(row: Row, pool: str) -> str | None:
        context.setLocalProperty("spark.scheduler.pool", pool)
        try:
            work(row)
            return None
        except Exception as failure:  # any failure is an outcome of its own task only
            return (str(failure) or type(failure).__name__).splitlines()[0]

    def outcome(no: int, row: Row, result: Future) -> tuple:
        have = row.asDict()
        error = result.result()
        return (
            sandbox.run_id, no, have.get("dr_id"), have.get("target_environment"), have.get("source_fqn"),
            have.get("target_fqn"), have.get("clone_strategy"), have.get("action") or action, error is None, error,
        )

    running: deque[tuple[int, Row, Future]] = deque()
    with ThreadPoolExecutor(max_workers=sandbox.max_parallel) as pool:
        job = inheritable_thread_target(sandbox.spark)(one)
        for no, row in enumerate(rows):
            running.append((no, row, pool.submit(job, row, f"copy-{no % sandbox.max_parallel}")))
            if len(running) >= 4 * sandbox.max_parallel:
                yield outcome(*running.popleft())
        while running:
            yield outcome(*running.popleft())


def run_tasks(sandbox: Sandbox, tasks: DataFrame, work: Callable[[Row], None], action: str) -> DataFrame:
    """Carry out one catalog task per row; returns the stored outcome rows.

    Plan rows stream through the driver one partition at a time and outcomes are written in small
    batches, so the driver holds a bounded number of either, however long the plan is.  All data
    work is in the Spark jobs the tasks start.
    """
    path = f"{sandbox.root}/outcomes/{sandbox.run_id}/{action}-{uuid.uuid4().hex[:8]}"
    spark, batch = sandbox.spark, []

    def flush() -> None:
        spark.createDataFrame(batch, schemas.OUTCOMES).coalesce(1).write.mode("append").parquet(path)
        batch.clear()

    for done in _tasks_done(sandbox, tasks.toLocalIterator(prefetchPartitions=True), work, action):
        batch.append(done)
        if len(batch) >= OUTCOMES_PER_WRITE:
            flush()
    flush()
    return spark.read.schema(schemas.OUTCOMES).parquet(path)


def create_schemas(sandbox: Sandbox, wanted: DataFrame) -> DataFrame:
    """Create the schemas (dr_id, target_environment, schema_fqn) and report on each."""
    return run_tasks(
        sandbox, wanted.withColumnRenamed("schema_fqn", "target_fqn"),
        lambda row: create_schema(sandbox, row.target_fqn), "schema",
    )


def clone_all(sandbox: Sandbox, plan: DataFrame) -> DataFrame:
    return run_tasks(sandbox, plan, lambda row: clone_object(sandbox, row), "clone")


def refresh_all(sandbox: Sandbox, targets: DataFrame, full: bool) -> DataFrame:
    return run_tasks(sandbox, targets, lambda row: refresh_object(sandbox, row, full), "refresh")
