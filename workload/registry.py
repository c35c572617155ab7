"""Registry of queries and their SQL, and access to the tables they read."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from workload.fixtures import SPARK_VIEWS, VIEWS

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WORD = re.compile(r"\b\w+\b")


def _used(sql: str, names) -> list[str]:
    words = set(_WORD.findall(sql))
    return [n for n in names if n in words]


def _with(sql: str, base: Callable[[str], str] | None) -> str:
    """``sql`` with the views it uses in front, and the base tables too if ``base`` says how to read them, as Spark does."""
    views = VIEWS if base is None else VIEWS | SPARK_VIEWS
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _used(text, VIEWS):
            if name not in ordered:
                visit(views[name])
                ordered.append(name)

    visit(sql)
    parts = [f"{n} AS ({views[n].strip()})" for n in ordered]
    if base is not None:
        tables = _used(" ".join([sql, *(views[n] for n in ordered)]), BASE_TABLES)
        parts = [f"{t} AS (SELECT * FROM {base(t)})" for t in tables] + parts
    if not parts:
        return sql
    sql = sql.strip()
    more = ",\n" + sql[5:] if sql[:5].upper() == "WITH " else "\n" + sql
    return "WITH " + ",\n".join(parts) + more


@dataclass(frozen=True)
class Tables:
    """The given tables of one scale factor, and the views over them."""

    spark: SparkSession
    folder: str

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def base(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(_with(text, self._temporary_view))

    def _temporary_view(self, table: str) -> str:
        """Name of a view over the file of a table; made once, so that its schema is read once."""
        name = f"{table}_{zlib.crc32(self.folder.encode()):08x}"
        if not self.spark.catalog.tableExists(name):
            self.base(table).createOrReplaceTempView(name)
        return name

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables)`` under ``name``, with the SQL whose rows it must equal."""
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = _with(oracle, None)
        return fn

    return register
