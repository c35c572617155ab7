"""Names and values of columns, shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores in front until no column is called so."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes of a text; null for null."""
    return F.crc32(text.cast("binary"))
