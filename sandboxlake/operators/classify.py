"""Which objects a set of edges touches, and how."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sandboxlake import fixed

_LATE = 9223372036854775804  # edges without a sequence number come last ...
_LAST = 9223372036854775807  # ... and names that only a user listed after them


def edge_sides(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two rows per edge, one for each named side: (by..., fqn, is_write, is_view, seq).

    The source side comes before the target side of the same edge.
    """
    seq = F.coalesce(F.col("edge_seq") * 2, F.lit(_LATE))

    def side(name: str, hint: str, write: int):
        return F.struct(
            F.col(name).alias("fqn"),
            F.lit(bool(write)).alias("is_write"),
            F.coalesce(F.upper(hint) == "VIEW", F.lit(False)).alias("is_view"),
            (seq + write).alias("seq"),
        )

    both = F.array(
        side("source_table_full_name", "source_type", 0), side("target_table_full_name", "target_type", 1)
    )
    return edges.select(*by, F.inline(both)).filter(F.col("fqn").isNotNull() & (F.col("fqn") != ""))


def edge_facts(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges folded to one row per object: read or written, and the type hint that came first.

    All aggregate buffers are fixed-width, so this is a hash aggregation with a partial step: an
    object named by a third of all edges costs one row per map task.
    """
    return edge_sides(edges, by).groupBy(*by, "fqn").agg(
        F.bool_or(~F.col("is_write")).alias("reads"),
        F.bool_or("is_write").alias("writes"),
        F.min_by("is_view", "seq").alias("is_view"),
        F.min("seq").alias("seq"),
    )


def listed_facts(additional: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Facts of objects a user listed: they give a name and nothing else."""
    no = F.lit(False)
    return additional.select(
        *by, "fqn", no.alias("reads"), no.alias("writes"), no.alias("is_view"), F.lit(_LAST).alias("seq")
    ).filter(F.col("fqn").isNotNull())


def merge_facts(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Facts from several places folded once more."""
    return facts.groupBy(*by, "fqn").agg(
        F.bool_or("reads").alias("reads"),
        F.bool_or("writes").alias("writes"),
        F.min_by("is_view", "seq").alias("is_view"),
        F.min("seq").alias("seq"),
    )


FACTS_PER_ROW = 1000


def gathered_facts(facts: DataFrame, by: Sequence[str], per_row: int = FACTS_PER_ROW) -> DataFrame:
    """At most ``per_row`` facts in a row, as a list of each column: (by..., chunk, n, columns...); a key with more of them has more rows."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*by))
    columns = [c for c in facts.columns if c not in by]
    lists = facts.withColumn("chunk", F.floor((place - 1) / per_row)).groupBy(*by, "chunk").agg(F.collect_list(F.struct(*columns)).alias("_facts"))
    return lists.select(*by, "chunk", F.size("_facts").alias("n"), *[F.col(f"_facts.{c}").alias(c) for c in columns])


def from_facts(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Object type, access mode and format from folded edges.

    ``is_additional`` marks objects that no edge names; they count as tables that are read.
    """
    return facts.select(
        *by,
        "fqn",
        F.when(F.col("is_view"), "view").otherwise("table").alias("object_type"),
        F.when(F.col("reads") & F.col("writes"), fixed.READ_WRITE)
        .when(F.col("writes"), fixed.WRITE_ONLY)
        .otherwise(fixed.READ_ONLY)
        .alias("access_mode"),
        F.when(~F.col("is_view"), "delta").alias("format"),
        (~F.col("reads") & ~F.col("writes")).alias("is_additional"),
    )


def classify(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per object (per request, with ``by=["dr_id"]``): type, access mode, format.

    The type comes from the first edge side that names the object, also if that side has no hint.
    """
    return from_facts(edge_facts(edges, by), by).drop("is_additional")


def classify_with_additional(edges: DataFrame, additional: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``classify`` plus the objects a user listed, in one aggregation; ``is_additional`` tells them apart."""
    return from_facts(merge_facts(edge_facts(edges, by).unionByName(listed_facts(additional, by)), by), by)
