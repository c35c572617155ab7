"""State tables as append-only change logs in a shared folder.

A change is appended as a new row with a higher ``commit_version``; the current row of a key is the
newest one (``as_of``).  ``compact`` rewrites the newest rows as a generation, laid out by a hash of the request; after that
a lookup by request reads its part of the generation and the changes since.  Audit rows never change, so they carry no commit columns and are stored by
day: reading recent rows and purging old ones touch the matching folders only.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sandboxlake import fixed, schemas
from sandboxlake.operators.approvals import edit_key
from sandboxlake.operators.asof import COMMIT_COLUMNS, as_of
from sandboxlake.operators.lifecycle import audit_kept, audit_stays
from sandboxlake.sources.files import claim_next, make_folder, move_into, names_in, remove_folder, rename_folder

_PURGE = "_purge-"
_GENERATION = r"_gen-([0-9]+)-([0-9]+)"
BUCKETS = 64
CELLS = 8  # parts of a bucket that may go to tasks of their own, so a request of very many rows does not stay in one
_COMMIT = "commit_version bigint, commit_ts timestamp_ntz, op string"


def _bucket(dr_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(dr_id), F.lit(buckets)).cast("int")


def evolve(rows: DataFrame, schema: str) -> DataFrame:
    """Rows under a newer schema: columns they lack are NULL, types and order follow the schema."""
    return rows.select(
        *[
            (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in schemas.fields(schema)
        ]
    )


def rows_of_requests(rows: DataFrame, dr_ids: DataFrame) -> DataFrame:
    """Rows of the given requests; the bulk form of a lookup by request id."""
    return rows.join(dr_ids.select("dr_id").distinct(), "dr_id", "left_semi").select(*rows.columns)


def audit_rows(rows: DataFrame) -> DataFrame:
    """Audit rows ready to append; a row without an id gets a random one."""
    full = evolve(rows, schemas.AUDIT)
    return full.withColumn("log_id", F.coalesce("log_id", F.uuid()))


class StateTables:
    """The state tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self) -> None:
        """Make the empty tables, so that readers find them before the first append.

        Their schemas are those of ``schemas``; readers apply them, so a folder is all there is to make.
        """
        for name in schemas.STATE_SCHEMAS:
            make_folder(self.spark, self.path(name))
            if name != "audit" and not names_in(self.spark, self.path(name)):
                claim_next(self.spark, f"{self.path(name)}/_versions")

    @staticmethod
    def _schema(name: str) -> str:
        if name == "audit":
            return f"{schemas.AUDIT}, edit_key string, day date"
        return f"{schemas.STATE_SCHEMAS[name]}, {_COMMIT}"

    def _write(self, name: str, rows: DataFrame) -> None:
        """Append rows.  Audit rows go to their days; others are written aside and moved in, so that appends at the same
        time do not share a folder for unfinished files."""
        if name == "audit":
            rows.write.mode("append").partitionBy("day").parquet(self.path(name), compression="zstd")
            return
        staged = f"{self.path(name)}/_staged-{uuid.uuid4().hex}"
        rows.write.parquet(staged, compression="zstd")
        for file in names_in(self.spark, staged):
            if file.endswith(".parquet"):
                move_into(self.spark, staged, self.path(name), file)
        remove_folder(self.spark, self.path(name), staged)

    def append(self, name: str, rows: DataFrame, now: str, op: str = "upsert") -> None:
        """One bulk append: an insert, an update (whole new rows) or a delete (rows with the keys)."""
        if name == "audit":
            return self.append_audit(rows)
        full = evolve(rows, schemas.STATE_SCHEMAS[name])
        return self._write(
            name,
            full.withColumn("commit_version", F.lit(self._next_version(name)).cast("bigint"))
            .withColumn("commit_ts", F.lit(now).cast("timestamp_ntz"))
            .withColumn("op", F.lit(op)),
        )

    def _next_version(self, name: str) -> int:
        """One above the newest version of a table.  It is claimed, not read off a clock, so a later change always wins."""
        claims = f"{self.path(name)}/_versions"
        first = 1
        if not names_in(self.spark, claims):
            newest = self.log(name).agg(F.max("commit_version").alias("v")).first()["v"]
            first = 1 + (newest or 0)
        return claim_next(self.spark, claims, first)

    def append_audit(self, rows: DataFrame) -> None:
        keyed = audit_rows(rows).withColumn("edit_key", F.when(F.col("action").isin(*fixed.EDIT_ACTIONS), edit_key()))
        self._write("audit", keyed.withColumn("day", F.to_date("performed_at")))

    def _generation(self, name: str) -> tuple[str, int, int] | None:
        """The newest whole generation of a table: its folder, the version it goes up to, and its number of buckets."""
        whole = [
            (int(found[1]), int(found[2]), entry)
            for entry in names_in(self.spark, self.path(name)) if (found := re.fullmatch(_GENERATION, entry))
        ]
        if not whole:
            return None
        bound, buckets, entry = max(whole)
        return f"{self.path(name)}/{entry}", bound, buckets

    def log(self, name: str, dr_ids: DataFrame | None = None) -> DataFrame:
        """All changes that count: the newest generation, and what was appended since.

        With ``dr_ids``, rows of those requests only, from their buckets of the generation.
        """
        if name == "audit":
            self._end_purges()
        schema = self._schema(name)
        rows = self.spark.read.schema(schema).parquet(self.path(name))
        generation = None if name == "audit" else self._generation(name)
        if generation:
            folder, bound, buckets = generation
            wanted = [f"{folder}/{entry}" for entry in self._buckets(folder, buckets, dr_ids)]
            rows = rows.filter(F.col("commit_version") > bound)
            if wanted:
                rows = self.spark.read.schema(schema).option("basePath", folder).parquet(*wanted).drop("bucket").unionByName(rows)
        return rows if dr_ids is None else rows_of_requests(rows, dr_ids)

    def _buckets(self, folder: str, buckets: int, dr_ids: DataFrame | None) -> list[str]:
        there = [entry for entry in names_in(self.spark, folder) if entry.startswith("bucket=")]
        if dr_ids is None:
            return there
        asked = dr_ids.select(_bucket(F.col("dr_id"), buckets).alias("b")).distinct().collect()  # at most ``buckets`` rows
        return sorted({f"bucket={r['b']}" for r in asked} & set(there))

    def current(self, name: str, dr_ids: DataFrame | None = None) -> DataFrame:
        """Current rows; older files that lack a newer column read it as NULL."""
        if name == "audit":
            return self.log(name, dr_ids).drop("day", "edit_key")
        rows = self.log(name, dr_ids)
        # asked after the files were listed: an append in between only means one look for the newest rows too many
        return rows.drop(*COMMIT_COLUMNS) if self._is_compact(name) else as_of(rows, schemas.STATE_KEYS[name])

    def _is_compact(self, name: str) -> bool:
        """Whether a table is its newest generation alone, which holds one row per key and no deletes."""
        return bool(self._generation(name)) and not any(entry.endswith(".parquet") for entry in names_in(self.spark, self.path(name)))

    def of_requests(self, name: str, dr_ids: DataFrame) -> DataFrame:
        """Current rows of some requests; the cut to them comes before the newest row of a key is looked for."""
        return self.current(name, dr_ids)

    def compact(self, name: str, buckets: int = BUCKETS) -> int:
        """Rewrite the current rows of a table as a new generation; returns the version it goes up to.

        The generation is whole once its folder has its name, which says up to which version it goes: files of older
        changes count no more then, and are removed.  A run that breaks off in between leaves nothing that is read twice.
        Appends must not run at the same time: one that claimed its version before and arrives after would not count.

        Rows move once: by bucket and cell, which hold all changes of a key, so the newest one is found where the bucket is
        written.  They are not cut before that, as a key has at most one row per append and appends are files of their own.
        """
        if name == "audit" or "dr_id" not in schemas.STATE_KEYS[name]:
            raise ValueError(f"not laid out by request: {name}")
        old = [entry for entry in names_in(self.spark, self.path(name)) if entry.endswith(".parquet")]
        before = self._generation(name)
        log = self.log(name)
        reached = before[1] if before else 0
        bound = max(log.agg(F.max("commit_version").alias("v")).first()["v"] or 0, reached)
        if bound == reached:
            return bound
        keys = schemas.STATE_KEYS[name]
        bucket, cell = _bucket(F.col("dr_id"), buckets), _bucket(F.struct(*keys), CELLS)
        moved = log.filter(F.col("commit_version") <= bound).repartition(bucket, cell)
        placed = moved.withColumn("bucket", bucket).withColumn("_cell", cell)
        newest = as_of(placed, ["bucket", *keys, "_cell"], keep_commit=True)
        laid = newest.sortWithinPartitions("bucket", *keys).drop("_cell")  # the order they are in
        building = f"{self.path(name)}/_building-{uuid.uuid4().hex}"
        laid.write.partitionBy("bucket").parquet(building, compression="zstd")
        rename_folder(self.spark, building, f"{self.path(name)}/_gen-{bound}-{buckets}")
        # files listed before the bound was taken hold no newer change
        for entry in old:
            remove_folder(self.spark, self.path(name), f"{self.path(name)}/{entry}")
        if before:
            remove_folder(self.spark, self.path(name), before[0])
        return bound

    def audit_since(self, first: str) -> DataFrame:
        """Audit rows from a day on; folders before it are not read."""
        return self.log("audit").filter(F.col("day") >= F.lit(first).cast("date")).drop("day", "edit_key")

    def edit_rows(self, edits: DataFrame | None = None) -> DataFrame:
        """Audit rows about staged edits, with their ``edit_key``; only those of ``edits`` (pending_edit_id), if given.

        The key is a column of its own, stored when the rows are appended; only rows from before there was one are parsed.
        """
        rows = self.log("audit").filter(F.col("action").isin(*fixed.EDIT_ACTIONS)).withColumn("edit_key", F.coalesce("edit_key", edit_key())).drop("day")
        if edits is None:
            return rows
        asked = edits.select(F.col("pending_edit_id").alias("edit_key")).distinct()
        return rows.join(asked, "edit_key", "left_semi")

    def purge_audit(self, now: str, days: int = fixed.AUDIT_RETENTION_DAYS) -> int:
        """Remove audit rows older than ``days``: whole day folders, plus part of the day of the cut.

        What stays of that day is written beside it and noted before anything is removed, so a purge that
        breaks off loses no row; the next reader or purge ends it.
        """
        path, log = self.path("audit"), self.log("audit")
        oldest = self.spark.range(1).select(
            (F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")).cast("date").alias("d")
        ).first()["d"]
        cut = log.filter(F.col("day") == F.lit(oldest))
        gone = [r["day"] for r in log.filter(F.col("day") < F.lit(oldest)).select("day").distinct().toLocalIterator()]
        for day in gone:
            remove_folder(self.spark, path, f"{path}/day={day}")
        old = cut.agg(F.count(F.lit(1)).alias("all"), F.count_if(~audit_stays(now, days)).alias("old")).first()
        if old["old"]:
            staged = f"{path}/{_PURGE}{oldest}"
            remove_folder(self.spark, path, staged)  # of a purge that broke off while it wrote
            audit_kept(cut, now, days).drop("day").write.parquet(f"{staged}/rows")
            make_folder(self.spark, f"{staged}/ready")
            self._end_purges()
        return len(gone) + bool(old["old"])

    def _end_purges(self) -> None:
        """End purges whose kept rows are all written: the old files of the day go, the kept ones move in."""
        path = self.path("audit")
        for name in names_in(self.spark, path):
            if not name.startswith(_PURGE):
                continue
            staged, day = f"{path}/{name}", f"{path}/day={name.removeprefix(_PURGE)}"
            if "ready" not in names_in(self.spark, staged):
                continue
            if "cleared" not in names_in(self.spark, staged):
                remove_folder(self.spark, path, day)
                make_folder(self.spark, f"{staged}/cleared")
            for file in names_in(self.spark, f"{staged}/rows"):
                if file.endswith(".parquet"):
                    move_into(self.spark, f"{staged}/rows", day, file)
            remove_folder(self.spark, path, staged)
