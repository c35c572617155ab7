"""Settings and upkeep of long runs over texts."""

from __future__ import annotations

import gc
import re

from pyspark.sql import SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXTS_PER_BATCH = 1000
BYTES_PER_BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most TEXTS_PER_BATCH rows and about BYTES_PER_BATCH bytes: texts and their lists are long, and
    Spark's usual 10,000 rows or 64 megabytes of them take hundreds of megabytes in each Python worker, and as much again
    beside the heap of its executor.  Smaller settings stay."""
    now = int(spark.conf.get(_ROWS, "0"))
    if not 0 < now <= TEXTS_PER_BATCH:
        spark.conf.set(_ROWS, str(TEXTS_PER_BATCH))
    size = re.fullmatch(r"(-?[0-9]+)b?", spark.conf.get(_BYTES))
    if size and not 0 < int(size[1]) <= BYTES_PER_BATCH:
        spark.conf.set(_BYTES, str(BYTES_PER_BATCH))


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nothing refers to any more.

    It does so only once the driver has collected garbage, which may not happen during a run whose
    steps are all written out; until then every finished step keeps its files on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
