"""Users and groups: who is known, and what changed between two lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grantable(plan: DataFrame, known: DataFrame) -> DataFrame:
    """Grant rows whose principal exists."""
    return plan.join(known.select("principal").distinct(), "principal", "left_semi").select(*plan.columns)


def unknown_principals(plan: DataFrame, known: DataFrame) -> DataFrame:
    """Principals that do not exist, each listed once per request."""
    return (
        plan.select("dr_id", "principal").distinct()
        .join(known.select("principal").distinct(), "principal", "left_anti")
        .select("dr_id", "principal")
    )


def _list(names: Column) -> Column:
    return F.coalesce(names, F.array().cast("array<string>"))


def edited_list(old: Column, added: Column, removed: Column) -> Column:
    """The old list without the removed and with the added names; sorted, each name once."""
    return F.array_sort(F.array_union(F.array_except(_list(old), _list(removed)), _list(added)))


def names_added(old: Column, new: Column) -> Column:
    return F.array_sort(F.array_except(_list(new), _list(old)))


def names_removed(old: Column, new: Column) -> Column:
    return F.array_sort(F.array_except(_list(old), _list(new)))
