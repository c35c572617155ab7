"""Lineage edges: automatic ones from the lineage table, curated ones from the enrichment table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandboxlake.operators.topn import first_rows

EDGE_COLUMNS = (
    "source_table_full_name", "target_table_full_name", "source_type", "target_type", "entity_id", "edge_seq",
)


def lineage_scan(lineage: DataFrame, entity_ids: DataFrame) -> DataFrame:
    """Edges of the given entities.  Only the edge columns are read."""
    wanted = entity_ids.select("entity_id").distinct()
    return lineage.select(*EDGE_COLUMNS).join(wanted, "entity_id", "left_semi").select(*EDGE_COLUMNS)


def edge_counts(lineage: DataFrame, members: DataFrame, row_limit: int) -> DataFrame:
    """(dr_id, edges, row_limit_hit) for members (dr_id, entity_id).

    Edges are counted per entity from that one column, before anything is joined; requests only add
    up those counts.
    """
    wanted = members.select("entity_id").distinct()
    per_entity = lineage.select("entity_id").join(wanted, "entity_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias("edges"))
    return (
        members.select("dr_id", "entity_id").distinct().join(per_entity, "entity_id")
        .groupBy("dr_id").agg(F.sum("edges").alias("edges"))
        .withColumn("row_limit_hit", F.col("edges") > row_limit)
    )


def first_edges(lineage: DataFrame, members: DataFrame, row_limit: int) -> DataFrame:
    """The first ``row_limit`` edges of each request, in ``edge_seq`` order.

    An edge that comes later than that within its own entity cannot be among the first of any
    request, so entities are cut before they meet the requests that name them.
    """
    ids = members.select("dr_id", "entity_id").distinct()
    order = [F.col(c) for c in reversed(EDGE_COLUMNS)]
    heads = first_rows(lineage_scan(lineage, ids), ["entity_id"], order, row_limit)
    edges = heads.join(ids, "entity_id").select("dr_id", *EDGE_COLUMNS)
    return first_rows(edges, ["dr_id"], order, row_limit)


def lineage_of_requests(lineage: DataFrame, members: DataFrame, row_limit: int | None = None) -> DataFrame:
    """Edges per request, with ``row_limit_hit``; all of them unless the caller gives a ``row_limit`` per request.

    Only requests over the limit go through an ordering; all others are a plain join.
    """
    if row_limit is None:
        every = lineage.select(*EDGE_COLUMNS).join(members.select("dr_id", "entity_id").distinct(), "entity_id")
        return every.select("dr_id", *EDGE_COLUMNS, F.lit(False).alias("row_limit_hit"))
    marked = members.select("dr_id", "entity_id").distinct().join(
        edge_counts(lineage, members, row_limit).select("dr_id", "row_limit_hit"), "dr_id"
    )
    within = lineage.select(*EDGE_COLUMNS).join(marked.filter(~F.col("row_limit_hit")), "entity_id")
    over = first_edges(lineage, marked.filter("row_limit_hit"), row_limit).withColumn("row_limit_hit", F.lit(True))
    return within.select("dr_id", *EDGE_COLUMNS, "row_limit_hit").unionByName(over)


def lineage_limited(lineage: DataFrame, row_limit: int) -> tuple[DataFrame, bool]:
    """The first ``row_limit`` edges of one scan, and whether there were more."""
    edges = lineage.select(*EDGE_COLUMNS)
    more = edges.limit(row_limit + 1).count() > row_limit
    return (edges.orderBy(*EDGE_COLUMNS[::-1]).limit(row_limit) if more else edges), more


def enrichment_edges(enrichment: DataFrame, stream_keys: DataFrame | None = None) -> DataFrame:
    """Curated rows as edges.  A missing hint reads; ``WRITE`` writes; ``READ_WRITE`` does both."""
    rows = enrichment.select("stream_key", "object_fqn", "access_hint")
    if stream_keys is not None:
        rows = rows.join(stream_keys.select("stream_key").distinct(), "stream_key", "left_semi")
    hint = F.upper(F.coalesce(F.nullif(F.col("access_hint"), F.lit("")), F.lit("READ")))
    fqn = F.col("object_fqn")
    none = F.lit(None).cast("string")
    return rows.filter(fqn.isNotNull() & (fqn != "")).select(
        F.when(hint != "WRITE", fqn).alias("source_table_full_name"),
        F.when(hint.isin("WRITE", "READ_WRITE"), fqn).alias("target_table_full_name"),
        none.alias("source_type"),
        none.alias("target_type"),
        F.col("stream_key").alias("entity_id"),
    )


def merged_edges(automatic: DataFrame, curated: DataFrame) -> DataFrame:
    """All edges, duplicates kept.  Curated edges come after all automatic ones (no sequence number)."""
    return automatic.unionByName(curated, allowMissingColumns=True)
