"""Line dedup by overlapping windows of three lines.

Texts are cut at line breaks.  Every three consecutive lines of which one has a word are a window, known
by two 64-bit hashes.  Of the windows that occur more than once anywhere, all but the first occurrence
cover their three lines; covered positions merge, and covered lines are removed.  The first occurrence is
the one in the document with the smallest id, and there the one nearest to the top.  So every line that is
removed stays somewhere: its first occurrence in any repeated window is covered by no later one.

Windows are counted with a map-side step (a window may occur in a third of all documents), and what
comes back to a document is bounded by its own lines.  Both joins shuffle whatever the size: what they join
grows with the corpus, so a plan that broadcasts it while it is small is no measure of larger inputs.

Defined results: null texts stay null and empty ones empty; texts of fewer than three lines stay as they
are; rows that repeat id and text count once and are cleaned alike; of documents with one id and different
texts the one with the smaller hash comes first; null ids come last; an empty table gives an empty result;
other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sandboxlake.llm.columns import fresh, let
from sandboxlake.session import settle

WINDOW_LINES = 3
_HAS_WORD = r"[^\x20\x09-\x0D]"


def later_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, mark, ats): for each document the positions at which a window begins that has occurred before."""
    lines = docs.filter(F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{key}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.split(F.col(f"`{text}`"), "\n").alias("lines")
    ).filter(F.size("lines") >= WINDOW_LINES)
    starts = F.sequence(F.lit(0), F.size("lines") - WINDOW_LINES)
    cut = lines.select("doc", "mark", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("lines", i + 1, WINDOW_LINES), "\n"))).alias("at", "window"))
    hashed = cut.filter(F.regexp_like("window", F.lit(_HAS_WORD))).select(
        F.xxhash64("window").alias("h"), F.xxhash64(F.lit(WINDOW_LINES), "window").alias("g"), F.col("doc").isNull().alias("last"), "doc", "mark", "at"
    )
    windows = settle(hashed)
    order = F.struct("last", "doc", "mark", "at")
    repeated = settle(
        windows.groupBy("h", "g").agg(F.min(order).alias("first"), F.max(order).alias("final"))
        .filter(F.col("first") < F.col("final")).select("h", "g", "first")
    )
    later = windows.join(repeated.hint("merge"), ["h", "g"]).filter(F.col("first") < order)
    return later.groupBy("doc", "mark").agg(F.collect_set("at").alias("ats"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """``docs`` without the lines that later occurrences cover; ``removed`` names a column for their number."""
    names = {n: fresh(n, docs.columns) for n in ("mark", "ats", "found_doc", "found_mark", "kept", "lines")}
    found = settle(later_windows(docs, key, text)).select(
        F.col("doc").alias(names["found_doc"]), F.col("mark").alias(names["found_mark"]), F.array_sort("ats").alias(names["ats"])
    )
    content = F.col(f"`{text}`")
    marked = docs.withColumn(names["mark"], F.xxhash64(content))
    same = F.col(f"`{key}`").eqNullSafe(F.col(names["found_doc"])) & (F.col(names["mark"]) == F.col(names["found_mark"]))
    joined = marked.join(found.hint("merge"), same, "left")
    cut = joined.withColumn(names["lines"], F.when(F.col(names["ats"]).isNotNull(), F.split(content, "\n")))
    kept = let(F.struct(F.col(names["lines"]).alias("lines"), F.col(names["ats"]).alias("ats")), _uncovered)
    thinned = cut.withColumn(names["kept"], F.when(F.col(names["ats"]).isNotNull(), kept))
    lines, stays = F.col(names["lines"]), F.col(names["kept"])
    cleaned = F.when(stays.isNotNull(), F.array_join(stays, "\n")).otherwise(content)
    columns = [(cleaned if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns]
    number = F.coalesce(F.size(lines) - F.size(stays), F.lit(0)).cast("long")
    return thinned.select(*columns, *([F.when(stays.isNotNull(), number).otherwise(F.lit(0).cast("long")).alias(removed)] if removed else []))


def _uncovered(s: Column) -> Column:
    """The lines that no later window covers: what lies between a window's last line and the next one's first, in one walk."""
    def between(k: Column) -> Column:
        start = F.coalesce(F.get(s["ats"], k - 1) + WINDOW_LINES, F.lit(0))
        end = F.coalesce(F.get(s["ats"], k), F.size(s["lines"]))
        return F.slice(s["lines"], start + 1, F.greatest(end - start, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["ats"])), between))
