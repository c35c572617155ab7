"""The scan manifest: what a request touches, how large it is, and whether someone should look at it.

The rows are the manifest: one header per request, and one item row per object, schema, stream and listed object beside
it, whatever their number.  The sink stores these.  The nested document, one per request, is made of them for reading
by people and other programs; its size is what a single text can hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sandboxlake.functions.names import catalog_of, has_three_parts, schema_of
from sandboxlake.session import settle


def with_known_sizes(facts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add ``size`` and ``more_sizes``, the first size known of a name and a list of all others; NULL without any."""
    known = sizes.groupBy("fqn").agg(F.array_sort(F.collect_list("size_gb")).alias("_sizes")).select(
        "fqn", F.col("_sizes")[0].alias("size"), F.when(F.size("_sizes") > 1, F.slice("_sizes", 2, F.size("_sizes"))).alias("more_sizes")
    )
    return facts.join(known, "fqn", "left").select(*facts.columns, "size", "more_sizes")


def with_sizes(objects: DataFrame) -> DataFrame:
    """``estimated_size_gb`` in place of ``size`` and ``more_sizes``, a row for each; only tables have one."""
    one, every = F.array("size"), F.concat(F.array("size"), F.col("more_sizes"))
    return objects.withColumn("_gb", F.explode(F.when(F.col("more_sizes").isNull(), one).otherwise(every))).select(
        *[c for c in objects.columns if c not in ("size", "more_sizes")],
        F.when(F.col("object_type") == "table", F.col("_gb")).alias("estimated_size_gb"),
    )


def schemas_required(objects: DataFrame) -> DataFrame:
    """Distinct (dr_id, schema_fqn); names with a single part have no schema."""
    return (
        objects.select("dr_id", schema_of(F.col("fqn")).alias("schema_fqn"))
        .filter(F.col("schema_fqn").isNotNull())
        .distinct()
    )


def non_prod_additional(objects: DataFrame, additional: DataFrame) -> DataFrame:
    """Listed objects in a catalog none of the other objects of the request lives in.

    A request without any such other object has no baseline, and nothing is reported for it.
    """
    listed = additional.select("dr_id", "fqn").distinct()
    three = has_three_parts(F.col("fqn"))
    baseline = settle(
        objects.select("dr_id", "fqn").filter(three).join(listed, ["dr_id", "fqn"], "left_anti")
        .select("dr_id", catalog_of(F.col("fqn")).alias("catalog")).distinct()
    )
    return (
        listed.filter(three)
        .withColumn("catalog", catalog_of(F.col("fqn")))
        .join(baseline, ["dr_id", "catalog"], "left_anti")
        .join(baseline.select("dr_id").distinct(), "dr_id", "left_semi")
        .select("dr_id", "fqn")
    )


def manifest_headers(objects: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per request: object and schema totals and the review flags."""
    totals = objects.groupBy("dr_id").agg(
        F.count(F.lit(1)).alias("total_objects"), F.bool_or("is_additional").alias("_added")
    )
    schemas = schemas_required(objects).groupBy("dr_id").agg(F.count(F.lit(1)).alias("_schemas"))
    hit = F.coalesce(F.col("row_limit_hit"), F.lit(False))
    return (
        totals.join(schemas, "dr_id", "left").join(hits.select("dr_id", "row_limit_hit"), "dr_id", "left")
        .select(
            "dr_id",
            "total_objects",
            F.coalesce("_schemas", F.lit(0).cast("bigint")).alias("total_schemas"),
            (F.col("_added") | hit).alias("review_required"),
            hit.alias("lineage_row_limit_hit"),
        )
    )


def manifest_items(objects: DataFrame, streams: DataFrame, non_prod: DataFrame) -> DataFrame:
    """One row per item of a manifest: (dr_id, kind, name, object, stream); kind is object, stream, schema or non_prod."""
    schemas, (*rest, listed) = schemas_required(objects), _own_items(objects, streams, non_prod)
    return _united([*rest, _items(schemas, "schema", F.col("schema_fqn")), listed])


def _items(df: DataFrame, kind: str, name: Column, payload: Column | None = None) -> DataFrame:
    stream = F.struct(F.col("name"), F.col("resource_id").alias("workflow_id"), F.col("task_keys").alias("tasks"))
    return df.select(
        "dr_id", F.lit(kind).alias("kind"), name.alias("name"),
        (payload if payload is not None else F.lit(None).cast(_OBJECT)).alias("object"),
        (stream.cast(_STREAM) if kind == "stream" else F.lit(None).cast(_STREAM)).alias("stream"),
    )


def _own_items(objects: DataFrame, streams: DataFrame, non_prod: DataFrame) -> list[DataFrame]:
    """Items of objects, streams and listed objects; those of schemas follow from the objects."""
    payload = F.struct(
        F.col("fqn"), F.col("object_type").alias("type"), "access_mode", "format", "estimated_size_gb"
    ).cast(_OBJECT)
    return [
        _items(objects, "object", F.col("fqn"), payload), _items(streams, "stream", F.col("name")),
        _items(non_prod, "non_prod", F.col("fqn")),
    ]


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def documents_of(headers: DataFrame, items: DataFrame, scanned_at: str, schemas: Column | None = None) -> DataFrame:
    """Nested manifests as JSON, one per request with items: (dr_id, manifest_json).

    Items move to their request before they are gathered: hardly any two of a request lie in one task before that, and lists
    of one item are wider than the item.  ``schemas`` is the list of schemas in terms of the gathered lists; without it, it
    is made of items.
    """
    tag = lambda kind, when: F.when(F.col("kind") == kind, when)
    lists = {
        "objects": F.col("object"), "streams_scanned": F.col("stream"), "schemas_required": tag("schema", F.col("name")),
        "non_prod_additional_objects": tag("non_prod", F.col("name")),
    }
    if schemas is not None:
        del lists["schemas_required"]
    moved = items.select("dr_id", *[item.alias(name) for name, item in lists.items()]).repartition("dr_id")
    gathered = moved.groupBy("dr_id").agg(*[F.array_sort(F.collect_list(name)).alias(name) for name in lists])
    if schemas is not None:
        gathered = gathered.withColumn("schemas_required", schemas)
    return headers.join(gathered, "dr_id").select(
        "dr_id",
        F.to_json(
            F.struct(
                F.struct(
                    "dr_id", F.lit(scanned_at).alias("scanned_at"), "streams_scanned", "objects",
                    "schemas_required", "total_objects", "review_required", "lineage_row_limit_hit",
                    "non_prod_additional_objects",
                ).alias("scan_result")
            )
        ).alias("manifest_json"),
    )


def manifest_documents(headers: DataFrame, objects: DataFrame, streams: DataFrame, non_prod: DataFrame, scanned_at: str) -> DataFrame:
    """``documents_of`` the items of a scan.  Schemas are those of the gathered objects, so they are no rows of their own."""
    schemas = F.array_compact(F.transform("objects", lambda o: schema_of(o["fqn"])))
    return documents_of(headers, _united(_own_items(objects, streams, non_prod)), scanned_at, F.array_sort(F.array_distinct(schemas)))


_OBJECT = "struct<fqn:string,type:string,access_mode:string,format:string,estimated_size_gb:double>"
_STREAM = "struct<name:string,workflow_id:string,tasks:array<string>>"
_ITEM = f"dr_id string, kind string, name string, object {_OBJECT}, stream {_STREAM}"
_HEADER = (
    "dr_id string, total_objects bigint, total_schemas bigint, review_required boolean, lineage_row_limit_hit boolean, "
    "scanned_at string"
)


def write_manifests(headers: DataFrame, items: DataFrame, path: str, scanned_at: str) -> None:
    """Manifest sink: JSON rows, headers and items side by side, for all requests of a scan.

    The headers come last, so a folder without them is a scan that broke off.  Files are compressed: most of a row is names of fields.
    """
    items.write.mode("errorifexists").json(f"{path}/items", compression="gzip")
    headers.withColumn("scanned_at", F.lit(scanned_at)).write.mode("errorifexists").json(f"{path}/headers", compression="gzip")


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, items) of a folder that ``write_manifests`` has written."""
    return spark.read.schema(_HEADER).json(f"{path}/headers"), spark.read.schema(_ITEM).json(f"{path}/items")
