"""Table sizes from the metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandboxlake import fixed
from sandboxlake.functions.checks import is_catalog_name


def table_sizes(metadata: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(fqn, size_gb) of the named tables, or of all; tables without a size are left out.

    ``metadata`` is (table_catalog, table_schema, table_name, data_size_in_bytes).
    """
    known = metadata.filter(
        F.col("data_size_in_bytes").isNotNull() & is_catalog_name(F.col("table_catalog")) & (F.col("table_name") != "")
    ).select(
        F.concat_ws(".", "table_catalog", "table_schema", "table_name").alias("fqn"),
        F.round(F.col("data_size_in_bytes") / F.lit(float(fixed.BYTES_PER_GB)), 6).alias("size_gb"),
    )
    if names is None:
        return known
    three = names.select("fqn").filter(F.size(F.split("fqn", r"\.")) == 3).distinct()
    return known.join(three, "fqn", "left_semi")
