"""Plan rows: copies, target schemas, grants, drops, access rows, new ids."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sandboxlake import fixed, schemas
from sandboxlake.functions.checks import is_principal, is_schema_name
from sandboxlake.functions.names import (
    default_strategy, formatted_id, has_three_parts, request_tag, revision_value, schema_of, target_object, target_schema,
)
from sandboxlake.operators.slices import row_numbers
from sandboxlake.session import settle
from sandboxlake.sources.files import step_end
from sandboxlake.sources.state import StateTables


def environments(qa_enabled: Column) -> Column:
    """dev always, qa when it is on."""
    return F.when(F.coalesce(qa_enabled, F.lit(False)), F.array(F.lit("dev"), F.lit("qa"))).otherwise(F.array(F.lit("dev")))


def copy_plan(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """Object rows to be: one per object of a manifest and environment, in state REFRESH_PENDING.

    ``objects`` is (dr_id, fqn, object_type, access_mode, estimated_size_gb, clone_strategy);
    ``requests`` is (dr_id, qa_enabled, target_catalog, rev_mode, rev_version, rev_timestamp), one
    row per request.  Names that do not have three parts are left out.
    """
    settings = requests.select(
        "dr_id", "target_catalog", environments(F.col("qa_enabled")).alias("_envs"), request_tag(F.col("dr_id")).alias("_tag"),
        F.coalesce("rev_mode", F.lit("latest")).alias("clone_revision_mode"),
        revision_value(F.col("rev_mode"), F.col("rev_version"), F.col("rev_timestamp")).alias("clone_revision_value"),
    )
    # these are the names that have a target; asked like this, no target is built twice
    named = objects.filter(has_three_parts(F.col("fqn")))
    wide = named.join(settings.filter(F.col("_tag").isNotNull()), "dr_id").withColumn("target_environment", F.explode("_envs"))
    none = F.lit(None)
    return (
        wide.withColumn(
            "target_fqn",
            target_object(F.col("fqn"), F.col("dr_id"), F.col("target_environment"), F.col("target_catalog"), F.col("_tag")),
        )
        .select(
            "dr_id", F.col("fqn").alias("source_fqn"), "target_fqn", "target_environment",
            F.coalesce("object_type", F.lit("table")).alias("object_type"),
            F.coalesce("access_mode", F.lit(fixed.READ_ONLY)).alias("access_mode"),
            default_strategy(F.coalesce("object_type", F.lit("table")), F.col("clone_strategy")).alias("clone_strategy"),
            "clone_revision_mode", "clone_revision_value",
            none.cast("timestamp_ntz").alias("provisioned_at"), none.cast("timestamp_ntz").alias("last_refreshed_at"),
            F.lit(fixed.REFRESH_PENDING).alias("status"), "estimated_size_gb",
        )
        .select(*schemas.columns(schemas.OBJECTS))
    )


def target_schemas(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """Distinct (dr_id, target_environment, schema_fqn) that a plan needs."""
    settings = requests.select(
        "dr_id", "target_catalog", environments(F.col("qa_enabled")).alias("_envs"), request_tag(F.col("dr_id")).alias("_tag")
    ).filter(F.col("_tag").isNotNull())
    wanted = (
        objects.select("dr_id", schema_of(F.col("fqn")).alias("_schema"))
        .filter(F.col("_schema").isNotNull()).distinct()
    )
    return (
        wanted.join(settings, "dr_id")
        .withColumn("target_environment", F.explode("_envs"))
        .select(
            "dr_id", "target_environment",
            target_schema(
                F.col("_schema"), F.col("dr_id"), F.col("target_environment"), F.col("target_catalog"), F.col("_tag")
            ).alias("schema_fqn"),
        )
        .repartition("dr_id", "schema_fqn")  # by schema, so that the join above may split a large request
        .distinct()
    )


def env_schemas(objects: DataFrame) -> DataFrame:
    """Target schemas of existing objects per environment, without dropped objects."""
    return (
        objects.filter(~F.col("status").eqNullSafe(F.lit(fixed.DROPPED)))
        .select("dr_id", "target_environment", F.substring_index("target_fqn", ".", 2).alias("schema_fqn"))
        .distinct()
    )


def access_rows(requests: DataFrame, now: Column) -> DataFrame:
    """Access rows of new requests: developers on dev, qa users on qa if it is on."""
    def users(names: str, env: str) -> Column:
        return F.transform(
            F.coalesce(F.col(names), F.array().cast("array<string>")),
            lambda u: F.struct(u.alias("user_email"), F.lit(env).alias("environment")),
        )

    qa = F.when(F.coalesce("qa_enabled", F.lit(False)), users("qa_users", "qa")).otherwise(
        F.array().cast("array<struct<user_email:string,environment:string>>")
    )
    return requests.select("dr_id", F.inline(F.concat(users("developers", "dev"), qa))).select(
        "dr_id", "user_email", "environment", F.lit(fixed.READ_WRITE).alias("access_level"), now.alias("granted_at")
    )


def grant_plan(schemas_: DataFrame, requests: DataFrame) -> DataFrame:
    """Grant statements: every target schema, every user of that environment, both privilege sets.

    Schemas meet the one row of their request; users and privileges are unfolded from the arrays in
    that row, so the join itself never multiplies rows.
    """
    def users(names: str) -> Column:
        return F.coalesce(F.col(names), F.array().cast("array<string>"))

    principals = F.when(F.col("target_environment") == "dev", users("developers")).when(
        F.coalesce("qa_enabled", F.lit(False)), users("qa_users")
    )
    people = requests.select("dr_id", "qa_enabled", "developers", "qa_users")
    rows = (
        schemas_.filter(is_schema_name(F.col("schema_fqn")))
        .join(people, "dr_id")
        .select("dr_id", "target_environment", "schema_fqn", F.explode(principals).alias("principal"))
        .filter(is_principal(F.col("principal")))
    )
    return rows.select(
        "*", F.explode(F.array(_statement(fixed.GRANT_USAGE), _statement(fixed.GRANT_READ_WRITE))).alias("statement")
    )


PEOPLE_PER_ROW = 1000


def _folded(people: DataFrame, keys: Sequence[str], fields: Sequence[str], per_row: int = PEOPLE_PER_ROW) -> DataFrame:
    """Distinct people per key as arrays of about ``per_row``: a key has as many rows as its number of people asks for.

    They are counted with a map-side step, and spread over the parts of their key before they are gathered.
    """
    counted = people.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per_row).alias("_parts"))
    parted = people.join(counted, list(keys)).withColumn("_part", F.pmod(F.xxhash64(*fields), F.col("_parts")))
    return parted.repartition(*keys, "_part").groupBy(*keys, "_part").agg(F.collect_set(F.struct(*fields)).alias("_people")).drop("_part")


def user_grant_plan(schemas_: DataFrame, changes: DataFrame) -> DataFrame:
    """Grant and revoke statements for user changes (dr_id, environment, action, principal)."""
    people = _folded(
        changes.withColumnRenamed("environment", "target_environment").filter(is_principal(F.col("principal"))),
        ["dr_id", "target_environment"], ["action", "principal"],
    )
    rows = (
        schemas_.filter(is_schema_name(F.col("schema_fqn")))
        .join(people, ["dr_id", "target_environment"])
        .select("dr_id", "target_environment", "schema_fqn", F.inline("_people"))
    )
    statements = F.when(
        F.col("action") == "grant", F.array(_statement(fixed.GRANT_USAGE), _statement(fixed.GRANT_READ_WRITE))
    ).otherwise(F.array(_statement(fixed.REVOKE_ALL)))
    return rows.select("*", F.explode(statements).alias("statement"))


def revoke_plan(objects: DataFrame, access: DataFrame) -> DataFrame:
    """Revoke statements of a cleanup: every schema of the request's objects, every user with access."""
    wanted = (
        objects.select("dr_id", schema_of(F.col("target_fqn")).alias("schema_fqn"))
        .filter(is_schema_name(F.col("schema_fqn"))).distinct()
    )
    people = access.select("dr_id", F.col("user_email").alias("principal")).filter(is_principal(F.col("principal")))
    return (
        wanted.join(_folded(people, ["dr_id"], ["principal"]), "dr_id")
        .select("dr_id", "schema_fqn", F.inline("_people"))
        .select("*", _statement(fixed.REVOKE_ALL).alias("statement"))
    )


def _statement(text: str) -> Column:
    return F.format_string(text, "schema_fqn", "principal")


def drop_plan(objects: DataFrame) -> DataFrame:
    """Objects to drop, views (rank 0) before tables (rank 1); dropped ones are marked as skipped."""
    return objects.select(
        "dr_id", "target_environment", "source_fqn", "target_fqn", "object_type", "clone_strategy", "status",
        F.when(F.col("object_type") == "view", 0).otherwise(1).alias("drop_rank"),
        F.when(F.col("status").eqNullSafe(F.lit(fixed.DROPPED)), "skip").otherwise("drop").alias("action"),
    )


def removal_plan(objects: DataFrame, removed: DataFrame) -> DataFrame:
    """Objects named in ``removed`` (dr_id, source_fqn) that are not dropped yet, with what to drop."""
    return (
        objects.filter(~F.col("status").eqNullSafe(F.lit(fixed.DROPPED)))
        .join(removed.select("dr_id", "source_fqn").distinct(), ["dr_id", "source_fqn"], "left_semi")
        .select(
            "dr_id", "target_environment", "source_fqn", "target_fqn", "object_type", "clone_strategy", "status",
            F.when(F.col("clone_strategy") == "view", "VIEW").otherwise("TABLE").alias("drop_kind"),
        )
    )


def net_new_objects(discovered: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects found for added streams that the request has no row for, whatever its status."""
    have = objects.select("dr_id", F.col("source_fqn").alias("fqn")).distinct()
    return discovered.join(have, ["dr_id", "fqn"], "left_anti").select(*discovered.columns)


def allocate_ids(
    waiting: DataFrame, order: Sequence[str], prefix: str, last_value: int, width: int = 5
) -> DataFrame:
    """Give every waiting row the next id: prefix plus running number after ``last_value``."""
    numbered = row_numbers(waiting, order, "_no")
    return numbered.withColumn("counter", F.col("_no") + F.lit(last_value)).withColumn(
        "dr_id", formatted_id(prefix, F.col("counter"), width)
    ).drop("_no")


def next_counter(allocated: DataFrame, prefix: str, now: Column) -> DataFrame:
    """The counter row to store after an allocation."""
    return allocated.agg(F.max("counter").alias("last_value")).select(
        F.lit(prefix).alias("prefix"), "last_value", now.alias("updated_at")
    )


# ---- ids from the stored counter -----------------------------------------------------------------

CLAIM_RETRIES = 20


def lease_range(state: StateTables, prefix: str, n: int, now: str) -> int:
    """Take the next ``n`` values of a stored counter; returns the value before the first of them.

    A compare-and-set: whoever first claims the step that leads on from the stored value has it, and the step's end is
    part of the claim's name.  Others, and a caller after one that broke off before it stored the value, find the
    claim, store its end themselves and try again from there.  An unknown prefix starts at 0.
    """
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9]{0,7}", prefix):
        raise ValueError(f"not a prefix of ids: {prefix!r}")
    if n < 1:
        raise ValueError("lease at least one value")
    spark, steps = state.spark, f"{state.path('counters')}/_steps/{prefix}"

    def store(value: int) -> None:
        row = spark.range(1).select(F.lit(prefix).alias("prefix"), F.lit(value).cast("bigint").alias("last_value"), F.lit(now).cast("timestamp_ntz").alias("updated_at"))
        state.append("counters", row, now)

    for _ in range(CLAIM_RETRIES):
        stored = state.current("counters").filter(F.col("prefix") == prefix).agg(F.max("last_value")).first()[0] or 0
        end = step_end(spark, steps, stored, stored + n)
        if end == (stored + n, True):
            store(stored + n)
            return stored
        store(end[0])
    raise RuntimeError(f"no range of {prefix} after {CLAIM_RETRIES} tries")


def allocate_stored(state: StateTables, waiting: DataFrame, order: Sequence[str], prefix: str, now: str, width: int = 5) -> DataFrame:
    """``allocate_ids`` from the stored counter, which it moves on by the number of waiting rows."""
    rows = settle(waiting)
    n = rows.count()
    first = lease_range(state, prefix, n, now) if n else 0
    return allocate_ids(rows, order, prefix, first, width)


def target_conflicts(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """Targets that more than one source object would be copied to: (target_fqn, owners, dr_ids).

    Planned rows replace the stored ones of the same key; dropped ones count no more.  Owners are counted, not listed,
    and names are compared without case, as catalogs do.
    """
    key = schemas.STATE_KEYS["objects"]
    live = stored.filter(~F.col("status").eqNullSafe(F.lit(fixed.DROPPED)))
    sides = [rows.select(*key, "target_fqn", F.lit(side).alias("_planned")) for rows, side in ((planned, True), (live, False))]
    # both sides meet at their request: a plan has come there to meet its settings, so its names need not move again
    tasks = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = sides[0].unionByName(sides[1].repartition(tasks, "dr_id"))
    own = [*key[:1], F.xxhash64(*key), *key[1:]]  # numbers are sorted faster than texts
    again = F.row_number().over(W.partitionBy(*own, "target_fqn").orderBy(F.desc("_planned"))) > 1
    replaced = ~F.col("_planned") & F.bool_or("_planned").over(W.partitionBy(*own))
    known = F.lit(True)
    for column in key:
        known = known & F.col(column).isNotNull()  # a key with a NULL is nobody's
    owners = both.withColumn("_again", again).withColumn("_replaced", replaced & known).filter(~F.col("_again") & ~F.col("_replaced"))
    # owners of one id are counted before names move, so the id stays behind
    named = owners.groupBy("dr_id", F.lower("target_fqn").alias("target_fqn")).agg(F.count(F.lit(1)).alias("_owners"))
    return (
        named.select("target_fqn", "_owners", F.col("dr_id").isNotNull().cast("long").alias("_ids")).repartition(tasks, "target_fqn")
        .groupBy("target_fqn").agg(F.sum("_owners").alias("owners"), F.sum("_ids").alias("dr_ids"))
        .filter(F.col("owners") > 1)
    )
