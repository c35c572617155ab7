"""Spark-native operators for isolated, expiring development copies of production tables.

Layout
    functions/   column expressions (naming, checks, revisions)
    sources/     scans and sinks (lineage, sizes, inventories, documents, state tables)
    operators/   DataFrame -> DataFrame operators (classify, as-of, updates, lifecycle, ...)
    plans/       copy, grant and drop plans, and the runs that carry them out

Every operator works on all requests at once.  "Today" and "now" are always arguments.
"""

__version__ = "0.1.0"
