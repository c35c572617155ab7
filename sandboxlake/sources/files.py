"""Making and removing folders that belong to us, on whatever file system they are."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def make_folder(spark: SparkSession, folder: str) -> None:
    system, path = _resolve(spark, folder)
    system.mkdirs(path)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder of ours; none if it is not there."""
    system, path = _resolve(spark, folder)
    return [status.getPath().getName() for status in system.listStatus(path)] if system.exists(path) else []


def move_into(spark: SparkSession, source: str, folder: str, name: str) -> None:
    """Move one file; nothing happens if it has been moved already."""
    system, path = _resolve(spark, f"{source}/{name}")
    if system.exists(path):
        make_folder(spark, folder)
        system.rename(path, _resolve(spark, folder)[1])


def rename_folder(spark: SparkSession, folder: str, new: str) -> None:
    """Give a folder of ours its final name."""
    system, path = _resolve(spark, folder)
    if not system.rename(path, _resolve(spark, new)[1]):
        raise OSError(f"cannot rename {folder}")


def claim(spark: SparkSession, folder: str, name: str) -> bool:
    """Make an empty file; false if somebody has made it before.  One caller wins on file systems that create exclusively."""
    system, path = _resolve(spark, f"{folder}/{name}")
    try:
        system.create(path, False).close()
    except Py4JJavaError:
        if system.exists(path):
            return False
        raise
    return True


CLAIMS_KEPT = 1000


def claim_next(spark: SparkSession, folder: str, at_least: int = 1) -> int:
    """The next whole number that nobody has claimed in ``folder``: one above the largest claim."""
    taken = sorted(int(n) for n in names_in(spark, folder) if n.isdigit())
    make_folder(spark, folder)
    number = max(at_least, taken[-1] + 1 if taken else at_least)
    while not claim(spark, folder, str(number)):
        number += 1
    for old in taken[:-CLAIMS_KEPT]:  # far below any number that a caller may still be about to claim
        remove_folder(spark, folder, f"{folder}/{old}")
    return number


def step_end(spark: SparkSession, folder: str, start: int, wanted: int) -> tuple[int, bool]:
    """Where the step that leads on from ``start`` ends, and whether this caller has just made it.

    The first caller makes it and it ends where that one wants; it is a file, created exclusively, that holds the end.
    """
    system, path = _resolve(spark, f"{folder}/{start}")
    try:
        out = system.create(path, False)
        out.write(bytearray(str(wanted).encode()))
        out.close()
        return wanted, True
    except Py4JJavaError:
        if not system.exists(path):
            raise
    while not system.getFileStatus(path).getLen():  # its maker is about to write it
        time.sleep(0.01)
    return int(spark.read.text(f"{folder}/{start}").first()[0]), False


def clock_tick(spark: SparkSession, folder: str) -> int:
    """A time of the file system, in milliseconds, that is over: whatever is written from now on is dated later.

    The time comes from a file made in ``folder``, so clocks of different machines play no part.
    """
    system, path = _resolve(spark, f"{folder}/_clock-{uuid.uuid4().hex}")

    def now() -> int:
        system.create(path, True).close()
        return system.getFileStatus(path).getModificationTime()

    tick = now()
    while now() <= tick:
        time.sleep(0.002)
    system.delete(path, False)
    return tick


def remove_folder(spark: SparkSession, root: str, folder: str) -> None:
    """Delete ``folder``, which has to lie under ``root``."""
    system, target = _resolve(spark, folder)
    _, base = _resolve(spark, root)
    inside = system.makeQualified(target).toString()
    if not inside.startswith(system.makeQualified(base).toString().rstrip("/") + "/"):
        raise ValueError(f"{folder} is not under {root}")
    system.delete(target, True)
