"""Secrets in texts: three fixed patterns, and tokens that a battery of randomness tests takes for generated ones.

A token is a run of 16 or more letters, digits and + / _ -, with up to two = behind it.  Its encoding is the smallest of
hex, base 32, 36, 62, 64 (both alphabets) and their union that holds all its characters.  Four tests ask whether its
characters are drawn evenly and independently from that alphabet: chi-squared over the characters, chi-squared over the
classes of characters (lower, upper, digit, other), the number of runs above and below the middle of the alphabet, and
the correlation of neighbours.  Fisher's method combines their p-values into one degree of randomness.

Tokens of letters only are ordinary words, by assumption, and are the reference: the p-value of another token is the share
of the reference at least as random.  Words of the same band of lengths or of shorter bands are its reference, as shorter
words look more random; so long tokens, of which few are words, still have one.  In each band of lengths, Benjamini and
Hochberg's rule at FALSE_DISCOVERIES decides which tokens are secrets.  A token counts once, however often it is copied.
Degrees are rounded to 1/1000, so the table that the rule works on has at most BANDS * 1001 rows, and one row a band
goes back to the tokens.

Positions are in code points.  They are the running sums of the lengths of matches and of what lies between them, as a
window over the matches of one text; texts themselves are not shuffled.

Defined results: a null text is an empty one and has no spans; spans of different kinds may overlap; tokens of digits only
are numbers, not secrets; without any word of 16 letters there is no reference and no token is added; repeated rows are
scanned alike; rows without an id are rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sandboxlake.llm.columns import let
from sandboxlake.session import settle

# Kinds in order, their patterns, and the least length of what must match
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16, "random": 16}

TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
FALSE_DISCOVERIES = 0.05
BANDS = 41  # a band is a fourth of a doubling of the length, from 16 on; the last one is open
STEPS = 1000

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# name, alphabet as classes of characters; a token has the first alphabet that holds it
ENCODINGS = (
    ("hex", (_DIGITS, "abcdef")),
    ("HEX", (_DIGITS, "ABCDEF")),
    ("base32", (_UPPER, "234567")),
    ("base36", (_DIGITS, _LOWER)),
    ("BASE36", (_DIGITS, _UPPER)),
    ("base62", (_DIGITS, _UPPER, _LOWER)),
    ("base64", (_UPPER, _LOWER, _DIGITS, "+/")),
    ("base64url", (_UPPER, _LOWER, _DIGITS, "-_")),
    ("any", (_UPPER, _LOWER, _DIGITS, "+/-_")),
)
_SMALLEST_P = 1e-12


def _upper_tail(z: Column) -> Column:
    """Probability that a normal number exceeds z, by a rational approximation (error below 1e-7)."""

    def tail(z: Column) -> Column:
        x = F.abs(z)
        poly = let(1 / (1 + 0.2316419 * x), lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
        beyond = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
        return let(beyond, lambda b: F.when(z >= 0, b).otherwise(1 - b))

    return let(z, tail)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def _moments(values: Column) -> Column:
    """Of the numbers of a token: sums of x, x * x and x * next x, and the first and last x."""
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("sum", "squares", "cross")], F.lit(None).cast("double").alias("last"))
    return F.aggregate(values, start, lambda a, x: F.struct(
        (a["sum"] + x).alias("sum"), (a["squares"] + x * x).alias("squares"),
        (a["cross"] + x * F.coalesce(a["last"], F.lit(0.0))).alias("cross"), x.alias("last"),
    ))


def _runs(values: Column, middle: Column) -> Column:
    """How many numbers are at or above the middle, and how many runs there are on either side."""
    start = F.struct(F.lit(0.0).alias("high"), F.lit(0.0).alias("runs"), F.lit(None).cast("boolean").alias("last"))
    return F.aggregate(values, start, lambda a, x: F.struct(
        (a["high"] + (x >= middle).cast("double")).alias("high"),
        (a["runs"] + (~(x >= middle).eqNullSafe(a["last"])).cast("double")).alias("runs"), (x >= middle).alias("last"),
    ))


def _square_counts(values: Column) -> Column:
    """Sum over the characters of the square of their number, by the runs of equal numbers in order."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("run"), F.lit(-1.0).alias("last"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x == a["last"], a["run"] + 1).otherwise(1.0)
        return F.struct((a["sum"] + 2 * run - 1).alias("sum"), run.alias("run"), x.alias("last"))

    return F.aggregate(F.sort_array(values), start, step)["sum"]


def randomness(token: Column) -> Column:
    """Degree of randomness of a token from 0 to 1: the combined p-value of the four tests; null if no encoding holds it."""
    body = F.translate(token, "=", "")
    by_encoding = F.lit(None).cast("struct<alphabet:string,classes:array<string>>")
    for _, classes in reversed(ENCODINGS):
        alphabet = "".join(classes)
        holds = F.length(F.translate(body, alphabet, "")) == 0
        known = F.struct(F.lit(alphabet).alias("alphabet"), F.array(*[F.lit(c) for c in classes]).alias("classes"))
        by_encoding = F.when(holds, known).otherwise(by_encoding)

    def tests(t: Column) -> Column:
        n, k, values = t["n"], t["k"], t["values"]
        symbols = (k / n * _square_counts(values) - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        df = t["classes"] - 1
        kinds = F.pow(t["spread"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))
        runs = let(_runs(values, k / 2), lambda r: let(
            2 * r["high"] * (n - r["high"]) / n + 1,
            lambda mean: F.when((mean > 2) & (n > 1), (r["runs"] - mean) / F.sqrt((mean - 1) * (mean - 2) / (n - 1))).otherwise(F.lit(0.0)),
        ))
        serial = let(_moments(values), lambda m: let(
            F.struct((m["squares"] - m["sum"] * m["sum"] / n).alias("var"), (m["sum"] / n).alias("mean"), m.alias("m")),
            lambda s: F.when(
                s["var"] > 0,
                ((s["m"]["cross"] - s["mean"] * (2 * s["m"]["sum"] - values[0] - s["m"]["last"]) + (n - 1) * s["mean"] * s["mean"]) / s["var"] + 1 / n) * F.sqrt(n),
            ).otherwise(F.lit(0.0)),
        ))
        found = (_upper_tail(symbols), _upper_tail(kinds / F.sqrt(2 / (9 * df))), _two_sided(runs), _two_sided(serial))
        half = -sum((F.log(F.greatest(p, F.lit(_SMALLEST_P))) for p in found), F.lit(0.0))
        return let(half, lambda h: F.least(F.lit(1.0), F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)))

    def prepared(e: Column) -> Column:
        n, k = F.length(body).cast("double"), F.length(e["alphabet"]).cast("double")
        counts = F.transform(e["classes"], lambda c: F.struct(
            (n - F.length(F.call_function("translate", body, c, F.lit(""))).cast("double")).alias("seen"), (n * F.length(c) / k).alias("expected")
        ))
        spread = F.aggregate(counts, F.lit(0.0), lambda a, c: a + (c["seen"] - c["expected"]) * (c["seen"] - c["expected"]) / c["expected"])
        values = F.transform(F.split(body, "(?!^)(?!$)"), lambda c: (F.position(c, e["alphabet"]) - 1).cast("double"))
        return F.struct(n.alias("n"), k.alias("k"), F.size(e["classes"]).cast("double").alias("classes"), spread.alias("spread"), values.alias("values"))

    return let(by_encoding, lambda e: F.when(e.isNotNull(), let(prepared(e), tests)))


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """(kind, gap, length, value) of each match, in order; the gap is what lies between it and the match before."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def entry(match: Column, before: Column) -> Column:
        value = F.regexp_extract(match, pattern, 1) if KINDS[kind] == "assign" else match
        return F.when(match.isNotNull(), F.struct(
            F.lit(kind).alias("kind"), F.length(before).cast("long").alias("gap"), F.length(match).cast("long").alias("length"), value.alias("value")
        ))

    return F.zip_with(whole, F.split(text, pattern, -1), entry)


def _at_least(pattern: str, kind: str, fixed: int = 0) -> str:
    """The pattern with its last + as a least number, which finds the same matches where all of them lie in one run."""
    return f"{pattern[:-1]}{{{LEAST[kind] - fixed},}}"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All matches, one row each: row, key, kind, start, end, value, and for tokens band, word and degree.

    ``row`` tells the rows of ``docs`` apart.  A row without a match is there once, with a null kind.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    patterns = (ASSIGN, _at_least(ACCESS, "access", len("AKIA")), _at_least(HEX, "hex"), TOKEN)
    found = F.filter(F.concat(*[_matches(body, k, p) for k, p in enumerate(patterns)]), lambda m: m.isNotNull())
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.monotonically_increasing_id().alias("row"), found.alias("found"))
    flat = rows.select("row", "key", F.posexplode_outer("found").alias("at", "m")).select("row", "key", "at", "m.*")
    is_token = F.col("kind") == KINDS.index("random")
    band = F.least(F.lit(BANDS - 1), F.floor(4 * F.log2(F.col("length") / LEAST["random"]))).cast("int")
    listed = settle(flat.select(
        "*", F.when(is_token, band).alias("band"),
        F.when(is_token, F.regexp_like("value", F.lit("^[A-Za-z]+$"))).alias("word"),
        F.when(is_token & ~F.regexp_like("value", F.lit("^[0-9]+$")), F.floor(randomness(F.col("value")) * STEPS).cast("int")).alias("degree"),
    ))
    end = F.sum(F.col("gap") + F.col("length")).over(W.partitionBy("row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return listed.repartition("row").withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).drop("gap", "length", "at")


def thresholds(spans: DataFrame, level: float = FALSE_DISCOVERIES) -> DataFrame:
    """(band, least): the least degree at which tokens of a band are secrets; at most BANDS rows."""
    tokens = spans.filter(F.col("degree").isNotNull()).groupBy(F.xxhash64("value").alias("h"), F.length("value").alias("n")).agg(
        F.first("band").alias("band"), F.first("word").alias("word"), F.first("degree").alias("degree")
    )
    # from here on at most BANDS * (STEPS + 1) * 2 rows
    counted = tokens.groupBy("band", "degree").agg(F.count_if("word").alias("words"), F.count_if(~F.col("word")).alias("others"))
    bands = counted.select("band").distinct()
    reference = counted.filter(F.col("words") > 0).select(F.col("band").alias("low"), F.col("degree").alias("degree"), F.col("words"))
    pooled = bands.join(reference, F.col("low") <= F.col("band")).groupBy("band", "degree").agg(F.sum("words").alias("words"))
    merged = pooled.select("band", "degree", "words", F.lit(0).cast("long").alias("others")).unionByName(
        counted.select("band", "degree", F.lit(0).cast("long").alias("words"), "others")
    ).groupBy("band", "degree").agg(F.sum("words").alias("words"), F.sum("others").alias("others"))
    down = W.partitionBy("band").orderBy(F.desc("degree"))
    whole = W.partitionBy("band")
    ranked = merged.select(
        "band", "degree", F.sum("words").over(down).alias("as_random"), F.sum("words").over(whole).alias("reference"),
        F.sum("others").over(down).alias("rank"), F.sum("others").over(whole).alias("tokens"),
    )
    p = (F.col("as_random") + 1) / (F.col("reference") + 1)
    return ranked.filter(F.col("rank") > 0).filter(p * F.col("tokens") <= level * F.col("rank")).groupBy("band").agg(F.min("degree").alias("least"))


def _judged(docs: DataFrame, key: str, text: str, level: float) -> DataFrame:
    """(row, key, order, kind, start, end, value); of matches that are no secrets order and kind are null."""
    spans = settle(scan(docs, key, text))
    judged = spans.join(F.broadcast(thresholds(spans, level)), "band", "left")
    token = F.col("kind") == KINDS.index("random")
    least = F.element_at(F.array(*[F.lit(LEAST[k]) for k in KINDS]), F.col("kind") + 1)
    secret = F.when(token, ~F.col("word") & F.coalesce(F.col("degree") >= F.col("least"), F.lit(False))).otherwise(F.length("value") >= least)
    names = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    return judged.select("row", "key", F.when(secret, F.col("kind")).alias("order"), F.when(secret, names).alias("kind"), "start", "end", "value")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", level: float = FALSE_DISCOVERIES) -> DataFrame:
    """(row, key, kind, start, end, value) of all secrets; ``row`` tells the rows of ``docs`` apart."""
    return _judged(docs, key, text, level).filter(F.col("kind").isNotNull()).drop("order")


def secrets_by_row(docs: DataFrame, key: str = "doc_id", text: str = "text", level: float = FALSE_DISCOVERIES) -> DataFrame:
    """One row per row of ``docs``: its key, the numbers of base spans by kind, their digest, and all spans as text."""
    span = F.struct("start", "order", F.concat_ws(":", "kind", "start", "end").alias("name"))
    per_row = _judged(docs, key, text, level).groupBy("row").agg(
        F.first("key").alias(key), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS[:-1]],
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("spans"),
    )

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: s["name"]), ",")

    base = F.filter("spans", lambda s: s["order"] < KINDS.index("random"))
    return per_row.select(
        key, *[f"n_{k}" for k in KINDS[:-1]], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
