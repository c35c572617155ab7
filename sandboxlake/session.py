"""Session settings, the shared folder, and lineage cuts that outlive an executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sandboxlake.sources.files import remove_folder

_own_dirs: dict[str, str] = {}


def build_session(app_name: str = "sandboxlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with runtime re-planning on, UTC time and fair scheduling for parallel copies."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.scheduler.mode": "FAIR",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if master and master.startswith("local"):
        settings |= {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(os.cpu_count() or 8)}
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="sandboxlake-")
    return _own_dirs[app]


def _settled_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/settled-{spark.sparkContext.applicationId}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Used where several consumers must see the very same rows (row numbers, range slices, plans that
    are both stored and carried out), also after an executor is lost and tasks run again, and where
    a costly part would otherwise be worked out once per consumer.  One pass over the rows; readers
    get column pruning and true sizes for their join choices.
    """
    spark = df.sparkSession
    folder = f"{_settled_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder, compression="zstd")
    return spark.read.schema(df.schema).parquet(folder)


def forget_settled(spark: SparkSession) -> None:
    """Remove what this application settled; frames that still rest on it can no longer be read."""
    remove_folder(spark, shared_dir(spark), _settled_dir(spark))
