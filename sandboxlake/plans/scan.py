"""The scan of many requests at once: from stream names to manifest rows."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandboxlake.operators.classify import edge_facts, from_facts, gathered_facts, listed_facts, merge_facts
from sandboxlake.operators.manifest import manifest_headers, non_prod_additional, with_known_sizes, with_sizes
from sandboxlake.operators.resolve import resolve_streams, scannable_requests
from sandboxlake.plans.copy_plan import net_new_objects
from sandboxlake.session import settle
from sandboxlake.sources.lineage import edge_counts, enrichment_edges, first_edges, lineage_scan
from sandboxlake.sources.sizes import table_sizes

# What facts hang on: an automatic edge's entity, a curated edge's key, or a request itself.
EDGE, CURATED, REQUEST = 0, 1, 2
FACTS_PER_TASK = 500_000  # about; a task folds them in memory


@dataclass
class Scan:
    """Manifest rows of all scanned requests."""

    objects: DataFrame
    headers: DataFrame
    streams: DataFrame
    listed: DataFrame

    @cached_property
    def non_prod(self) -> DataFrame:
        """Listed objects away from the others; worked out for who asks for them, as it reads all objects once more."""
        return non_prod_additional(self.objects, self.listed)


def members_of(streams: DataFrame, inventory: DataFrame) -> DataFrame:
    """(dr_id, name, resource_id, task_keys) of the requests whose streams all resolve.  Settled."""
    resolved = resolve_streams(streams, inventory)
    go = scannable_requests(resolved)
    return settle(resolved.join(go, "dr_id", "left_semi").select("dr_id", "name", "resource_id", "task_keys"))


def _keyed(rows: DataFrame, kind: int, key: str) -> DataFrame:
    return rows.withColumnsRenamed({key: "key"}).withColumn("kind", F.lit(kind))


def edge_facts_of(lineage: DataFrame, members: DataFrame, row_limit: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folded edges by (kind, key), links (dr_id, kind, key) of the requests that have them, and (dr_id, row_limit_hit).

    Edges are folded per entity before they meet the requests that share the entity; first edges of a request over the
    limit are its own.
    """
    ids = members.select("dr_id", F.col("resource_id").alias("entity_id")).distinct()
    if row_limit is None:
        folded = edge_facts(lineage_scan(lineage, ids), ["entity_id"])
        hits = ids.select("dr_id", F.lit(False).alias("row_limit_hit")).distinct()
        links = members.select("dr_id", F.col("resource_id").alias("entity_id"))  # a link that comes twice does no harm
        return _keyed(folded, EDGE, "entity_id"), _keyed(links, EDGE, "entity_id"), hits
    marked = settle(ids.join(edge_counts(lineage, ids, row_limit).select("dr_id", "row_limit_hit"), "dr_id"))
    within = marked.filter(~F.col("row_limit_hit")).drop("row_limit_hit")
    folded = edge_facts(lineage_scan(lineage, within), ["entity_id"])
    over = edge_facts(first_edges(lineage, marked.filter("row_limit_hit"), row_limit), ["dr_id"])
    facts = _keyed(folded, EDGE, "entity_id").unionByName(_keyed(over, REQUEST, "dr_id"))
    own = marked.filter("row_limit_hit").select("dr_id", F.col("dr_id").alias("key"), F.lit(REQUEST).alias("kind")).distinct()
    links = _keyed(within, EDGE, "entity_id").unionByName(own)
    return facts, links, marked.select("dr_id", "row_limit_hit").distinct()


def facts_of_requests(facts: DataFrame, links: DataFrame, per_task: int = FACTS_PER_TASK) -> DataFrame:
    """Facts (kind, key, ...) of each request, by links (dr_id, kind, key); a name that two of its keys have comes twice.

    Facts are gathered before they are handed to the requests that share their key, and move once, to their request.
    Only a request with more than ``per_task`` of them is spread over tasks, by name.
    """
    columns = [c for c in facts.columns if c not in ("kind", "key")]
    gathered = settle(gathered_facts(facts, ["kind", "key"]))
    found = {r.kind: r for r in gathered.groupBy("kind").agg(
        F.sum("n").alias("facts"), F.count_if(F.col("chunk") == 0).alias("keys"), (F.max("n") * (F.max("chunk") + 1)).alias("most")).collect()}
    had = links.groupBy("dr_id").agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("kind") == k).alias(f"of_{k}") for k in found])
    had = had.agg(F.max("all").alias("all"), *[F.sum(f"of_{k}").alias(f"of_{k}") for k in found]).first()
    parts = F.lit(1)
    if max((r.most for r in found.values()), default=0) * (had["all"] or 0) > per_task:  # some request may have more
        counted = links.join(gathered.select("kind", "key", "n"), ["kind", "key"]).groupBy("dr_id").agg(F.sum("n").alias("_n"))
        large = counted.filter(F.col("_n") > per_task).select("dr_id", F.ceil(F.col("_n") / per_task).alias("_parts"))
        links, parts = links.join(large, "dr_id", "left"), F.coalesce("_parts", F.lit(1))
    fact = F.arrays_zip(*columns)
    spread = F.transform(fact, lambda f: F.struct(F.pmod(F.xxhash64(f["fqn"]), parts).alias("_part"), *[F.array(f[c]).alias(c) for c in columns]))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("_part"), *columns))
    handed = gathered.join(links, ["kind", "key"]).select("dr_id", F.inline(F.when(parts > 1, spread).otherwise(whole)))
    # as many tasks as their facts ask for, if each link has as many as others of its kind; Spark would go by packed bytes
    tasks = math.ceil(sum(had[f"of_{k}"] * r.facts / r.keys for k, r in found.items() if had[f"of_{k}"]) / per_task)
    tasks = [max(tasks, facts.sparkSession.sparkContext.defaultParallelism)] if tasks > 1 else []
    handed = handed.repartition(*tasks, "dr_id", "_part")
    return handed.select("dr_id", "_part", F.inline(fact))


def scan(
    lineage: DataFrame,
    streams: DataFrame,
    inventory: DataFrame,
    additional: DataFrame,
    metadata: DataFrame,
    enrichment: DataFrame | None = None,
    row_limit: int | None = None,
) -> Scan:
    """Scan every request in ``streams`` (dr_id, name) whose names all resolve.

    ``additional`` is (dr_id, fqn), ``metadata`` the table sizes, ``enrichment`` the curated edges.
    All edges are read unless the caller gives a ``row_limit`` per request; the headers tell who was over it.
    """
    members = members_of(streams, inventory)
    requests = members.select("dr_id").distinct()
    listed = additional.join(requests, "dr_id", "left_semi")
    facts, links, hits = edge_facts_of(lineage, members, row_limit)
    if enrichment is not None:
        keys = members.select("dr_id", F.explode(F.array_distinct(F.array("name", "resource_id"))).alias("entity_id"))
        curated = enrichment_edges(enrichment).withColumn("edge_seq", F.lit(None).cast("bigint"))
        facts = facts.unionByName(_keyed(edge_facts(curated, ["entity_id"]), CURATED, "entity_id"))
        links = links.unionByName(_keyed(keys, CURATED, "entity_id"))
    facts = facts.unionByName(_keyed(listed_facts(listed, ["dr_id"]), REQUEST, "dr_id"))
    links = links.unionByName(requests.select("dr_id", F.col("dr_id").alias("key"), F.lit(REQUEST).alias("kind")))
    # a name has its sizes from the start, so that objects need not be brought together by name
    sized = facts_of_requests(with_known_sizes(facts, table_sizes(metadata)), links)
    objects = from_facts(merge_facts(sized, ["dr_id", "_part", "size", "more_sizes"]), ["dr_id", "size", "more_sizes"])
    return Scan(objects=with_sizes(objects), headers=manifest_headers(objects, hits), streams=members, listed=listed)


def stream_additions(
    lineage: DataFrame, streams: DataFrame, inventory: DataFrame, objects: DataFrame,
    row_limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Objects that added streams (dr_id, name) bring to their requests, and (dr_id, resolved).

    A request with a stream that does not resolve gets nothing.  ``objects`` are the object rows the
    requests have so far.
    """
    members = members_of(streams, inventory)
    facts, links, _ = edge_facts_of(lineage, members, row_limit)
    merged = merge_facts(facts_of_requests(facts, links), ["dr_id", "_part"])
    found = from_facts(merged, ["dr_id"]).select("dr_id", "fqn", "object_type", "access_mode")
    asked = streams.select("dr_id").distinct()
    fine = asked.join(members.select("dr_id", F.lit(True).alias("_ok")).distinct(), "dr_id", "left")
    return net_new_objects(found, objects), fine.select("dr_id", F.col("_ok").isNotNull().alias("resolved"))
