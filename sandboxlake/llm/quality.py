"""Quality rules at host level: rule failures by host, shrunk by an empirical beta prior, joined back to documents.

Measures of a text are taken in Arrow batches; failures are summed per host before any shuffle, and only
sums over all hosts (one row) reach the driver, to fit the prior.

Defined results: a null or empty text has measures of 0 and fails the base rule; a document without a
host is judged by the base rule alone; repeated rows are judged alike and each counts for its host; an
empty table gives an empty result; other columns, whatever their names, are passed on untouched.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sandboxlake.llm import texts
from sandboxlake.llm.columns import fresh
from sandboxlake.session import settle

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in MEASURES])

MAX_HOST_FAILURE = 0.5  # a host whose shrunk failure rate of any rule is above this is rejected
STRONGEST_PRIOR = 1e6  # pseudo-documents, where hosts do not differ at all


@F.arrow_udf(_TYPE)
def measure(column: pa.Array) -> pa.Array:
    parts = [texts.measures(data, bounds) for data, bounds in texts.chunks(column)]
    columns = [np.concatenate([np.zeros(0, np.int64), *(p[name] for p in parts)]).astype(np.int64) for name in MEASURES]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=[pa.field(n, pa.int64()) for n in MEASURES])


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def rules(m: Column) -> dict[str, Column]:
    """The rules whose failures are summed by host."""
    return {
        "base": base_failed(m),
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "dup_lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"],
        "word_length": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]),
    }


def host_rates(measured: DataFrame, host: str, m: str, name: str) -> DataFrame:
    """One row per host: ``name`` holds the largest shrunk failure rate among the rules.

    The rate of a rule at a host is (failures + a) / (documents + a + b).  Mean and spread of the beta
    prior are those of the rates of all hosts, weighted by documents and without the spread that counting
    alone would cause.
    """
    checks = rules(F.col(m))
    hosts = settle(
        measured.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(r) for r, c in checks.items()])
    )
    total = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"),
        *[F.sum(r).alias(r) for r in checks], *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_sq") for r in checks],
    ).first()
    shrunk = []
    for rule in checks:
        if not total["n"]:
            break
        mean = total[rule] / total["n"]
        chance = mean * (1 - mean)
        spread = total[f"{rule}_sq"] / total["n"] - mean * mean - chance * total["hosts"] / total["n"]
        strength = min(max(chance / spread - 1, 0.0), STRONGEST_PRIOR) if spread > 0 else STRONGEST_PRIOR
        shrunk.append((F.col(rule) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))
    rate = reduce(lambda a, b: F.greatest(a, b), shrunk) if shrunk else F.lit(0.0)
    return hosts.select(F.col("host").alias(f"{name}_host"), rate.alias(name))


def judge(measured: DataFrame, host: str, m: str, verdict: str, max_rate: float = MAX_HOST_FAILURE) -> DataFrame:
    """Add column ``verdict``: false if the document or its host is rejected.

    Documents stay on the side of the join that runtime re-planning can split, as one host may hold a
    third of them.
    """
    rate = fresh("host_rate", measured.columns)
    rates = host_rates(measured, host, m, rate)
    joined = measured.join(rates, F.col(host) == F.col(f"{rate}_host"), "left")
    fine = F.coalesce(F.col(rate) <= max_rate, F.lit(True))
    return joined.select(*[F.col(f"`{c}`") for c in measured.columns], (~base_failed(F.col(m)) & fine).alias(verdict))


def with_measures(docs: DataFrame, text: str, m: str) -> DataFrame:
    return docs.withColumn(m, measure(F.col(text).cast("string")))


def quality_verdicts(docs: DataFrame, keep: list[str], text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: ``keep``, the measures, base_failed and kept.  The measures are worked out once."""
    measured = settle(
        docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(host).alias("_host"), measure(F.col(text).cast("string")).alias("_m"))
    )
    judged = judge(measured, "_host", "_m", "_kept")
    return judged.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        *[F.col("_m")[c].alias(c) for c in MEASURES],
        base_failed(F.col("_m")).alias("base_failed"), F.col("_kept").alias("kept"),
    )


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with their columns.

    Texts are measured twice, for the hosts and for the verdict: reading again is cheaper than a written
    copy of all texts.
    """
    m = fresh("measures", docs.columns)
    verdict = fresh("kept", docs.columns)
    rate = fresh("host_rate", docs.columns)
    rates = host_rates(with_measures(docs.select(text, host), text, m), host, m, rate)
    fine = docs.join(rates, F.col(host) == F.col(f"{rate}_host"), "left").filter(F.coalesce(F.col(rate) <= MAX_HOST_FAILURE, F.lit(True)))
    judged = with_measures(fine, text, m).withColumn(verdict, ~base_failed(F.col(m)))
    return judged.filter(F.col(verdict)).select(*[F.col(f"`{c}`") for c in docs.columns])
