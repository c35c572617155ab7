"""Checks on names, principals and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sandboxlake import fixed


def is_object_name(fqn: Column) -> Column:
    """Three parts, each made of letters, digits and underscores."""
    return F.coalesce(fqn.rlike(fixed.THREE_PART_NAME), F.lit(False))


def is_schema_name(fqn: Column) -> Column:
    """Two parts, each made of letters, digits and underscores."""
    return F.coalesce(fqn.rlike(fixed.TWO_PART_NAME), F.lit(False))


def is_catalog_name(name: Column) -> Column:
    return F.coalesce(name.rlike(fixed.CATALOG_NAME), F.lit(False))


def is_principal(principal: Column) -> Column:
    """A mail address, a group name or an application id."""
    return F.coalesce(principal.rlike(fixed.PRINCIPAL), F.lit(False))


def is_email(principal: Column) -> Column:
    return F.coalesce(principal.rlike(fixed.EMAIL), F.lit(False))


def is_legacy_id(dr_id: Column) -> Column:
    return F.coalesce(dr_id.rlike(fixed.LEGACY_ID), F.lit(False))


def is_generated_id(dr_id: Column) -> Column:
    return F.coalesce(dr_id.rlike(fixed.GENERATED_ID), F.lit(False))


def is_request_id(dr_id: Column) -> Column:
    return is_legacy_id(dr_id) | is_generated_id(dr_id)
