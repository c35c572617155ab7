"""Reading JSON texts once per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_parsed(
    df: DataFrame, name: str, schemas: dict[str, tuple[str, str]], options: dict[str, str] | None = None
) -> DataFrame:
    """Add struct ``name`` with one field per entry of ``schemas``: field -> (text column, schema).

    A plain ``from_json`` column is put into every filter that mentions one of its fields, and the
    text is parsed again for each.  A one-element ``explode`` keeps filters above it, so each text
    is parsed once.
    """
    parsed = [F.from_json(text, schema, options or {}).alias(field) for field, (text, schema) in schemas.items()]
    return df.withColumn(name, F.explode(F.array(F.struct(*parsed))))
