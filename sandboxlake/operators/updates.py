"""Updates and deletes on state tables, as joins.

A hot key in the change batch is reduced to one row (or one row per expected status) before any
join, so each state row meets at most one change.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sandboxlake import fixed


def legal_moves(spark: SparkSession, moves: Sequence[tuple[str, str]]) -> DataFrame:
    """The relation of legal moves; 14 and 8 rows for requests and objects."""
    return spark.createDataFrame(list(moves), "current_status string, new_status string")


def last_change(changes: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """One row per key: the change with the highest ``seq``."""
    rest = [c for c in changes.columns if c not in keys]
    picked = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_c"))
    return picked.select(*keys, "_c.*")


def set_columns(
    state: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    where: Column | None = None,
    only_changed: bool = False,
) -> DataFrame:
    """State after the change: matched rows get ``values``, other rows stay.

    With ``only_changed`` just the rows that changed come back, ready to be appended to a log.

    ``changes`` has at most one row per key.  Its columns are reachable in ``values`` and ``where``
    as ``new_<column>``.
    """
    renamed = changes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(c).alias(f"new_{c}") for c in changes.columns if c not in keys],
        F.lit(True).alias("_hit"),
    )
    how = "inner" if only_changed else "left"
    joined = state.join(renamed, [F.col(k) == F.col(f"_k_{k}") for k in keys], how)
    hit = F.col("_hit").isNotNull()
    if where is not None:
        hit = hit & F.coalesce(where, F.lit(False))
    if only_changed:
        joined = joined.filter(hit)
    return joined.select(
        *[
            F.when(hit, values[c].cast(state.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c in values else F.col(c)
            for c in state.columns
        ]
    )


def changed_rows(rows: DataFrame, stored: str, values: Mapping[str, Column]) -> DataFrame:
    """New state rows, of rows that hold the stored one as struct ``stored``: ``values`` take the place of its columns."""
    return rows.select(
        *[
            values[f.name].cast(f.dataType).alias(f.name) if f.name in values else F.col(f"{stored}.{f.name}").alias(f.name)
            for f in rows.schema[stored].dataType
        ]
    )


def _claims(changes: DataFrame, keys: Sequence[str], legal: DataFrame) -> DataFrame:
    """Per key and expected status, the legal change that comes first."""
    rest = [c for c in changes.columns if c not in (*keys, "current_status")]
    return (
        changes.join(F.broadcast(legal), ["current_status", "new_status"], "left_semi")
        .groupBy(*keys, "current_status")
        .agg(F.min_by(F.struct(*rest), "seq").alias("claim"))
    )


def compare_and_set(
    state: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    moves: Sequence[tuple[str, str]],
    stamps: Mapping[str, str],
    only_changed: bool = False,
) -> DataFrame:
    """Change ``status`` where it still equals ``current_status`` and the move is legal.

    Of several changes to a key, the lowest ``seq`` that matches the stored status wins.
    ``stamps`` maps state columns to columns of ``changes``; a NULL stamp leaves the column as is.
    """
    claims = _claims(changes, keys, legal_moves(state.sparkSession, moves)).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("current_status").alias("_expected"), "claim"
    )
    match = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("status") == F.col("_expected")]
    joined = state.join(claims, match, "inner" if only_changed else "left")
    new = {"status": F.coalesce(F.col("claim.new_status"), F.col("status"))}
    for column, stamp in stamps.items():
        new[column] = F.coalesce(F.col(f"claim.{stamp}").cast(state.schema[column].dataType), F.col(column))
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in state.columns])


def compare_and_set_outcomes(
    state: DataFrame, changes: DataFrame, keys: Sequence[str], moves: Sequence[tuple[str, str]]
) -> DataFrame:
    """One row per change: applied, illegal_move, not_found, status_differs or superseded."""
    keys = list(keys)
    legal = legal_moves(state.sparkSession, moves).withColumn("_legal", F.lit(True))
    firsts = (
        _claims(changes, keys, legal.drop("_legal"))
        .select(*keys, "current_status", F.col("claim.seq").alias("_first"))
    )
    stored = state.select(*keys, F.col("status").alias("_stored"))
    return (
        changes.join(F.broadcast(legal), ["current_status", "new_status"], "left")
        .join(stored, keys, "left")
        .join(firsts, [*keys, "current_status"], "left")
        .select(
            *changes.columns,
            F.when(F.col("_stored").isNull(), "not_found")
            .when(F.col("_legal").isNull(), "illegal_move")
            .when(F.col("_stored") != F.col("current_status"), "status_differs")
            .when(F.col("seq") == F.col("_first"), "applied")
            .otherwise("superseded")
            .alias("outcome"),
        )
    )


def illegal_moves(pairs: DataFrame, moves: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose (current_status, new_status) is not a legal move."""
    legal = legal_moves(pairs.sparkSession, moves)
    return pairs.join(F.broadcast(legal), ["current_status", "new_status"], "left_anti").select(*pairs.columns)


def delete_matching(state: DataFrame, doomed: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """State without the rows whose key is in ``doomed`` (and that satisfy ``where``, if given)."""
    marks = doomed.select(*keys).distinct()
    if where is None:
        return state.join(marks, list(keys), "left_anti")
    flagged = state.join(marks.withColumn("_hit", F.lit(True)), list(keys), "left")
    gone = F.col("_hit").isNotNull() & F.coalesce(where, F.lit(False))
    return flagged.filter(~gone).select(*state.columns)


def delete_configs(configs: DataFrame, doomed: DataFrame) -> DataFrame:
    """Delete configs by request, but never a provisioned one."""
    may_go = ~F.col("status").eqNullSafe(F.lit(fixed.CONFIG_PROVISIONED))
    return delete_matching(configs, doomed, ["dr_id"], may_go)


def change_expiration(requests: DataFrame, changes: DataFrame, today: str, now: Column) -> DataFrame:
    """Set a new expiration date unless it is in the past, and stamp the change."""
    picked = last_change(changes, ["dr_id"])
    valid = F.col("new_expiration_date") >= F.lit(today).cast("date")
    return set_columns(
        requests, picked, ["dr_id"],
        {"expiration_date": F.col("new_expiration_date"), "last_modified_at": now}, valid,
    )


def stamp(state: DataFrame, changes: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Stamp ``column`` of the changed keys with the ``at`` of their last change."""
    return set_columns(state, last_change(changes, keys), keys, {column: F.col("new_at")})
