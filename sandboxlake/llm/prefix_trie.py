"""The prefix trie of conversations, by a splitter skeleton.

A conversation is a path: one 16-byte digest of (role, text) a turn.  Conversations are sorted by path and id
into shards whose splitters are rows of a sample.  The members of a node are neighbours in that order, so a
node can have members in two shards only if its path is the beginning of a splitter's path.  The trie of the
splitter paths, the skeleton, is handed to all tasks.  Each task walks its sorted shard once with the open path
as its only state: nodes outside the skeleton are finished there, of a skeleton node it gives partial sums, which
are added up over the shards and then up the skeleton.

Ids that end in a skeleton node leave a shard as texts of bounded length in ascending order; they are hashed in
that order, as a stream.  A group of copies of a conversation, however large, is split by the ids of the splitters.

What reaches the driver and all tasks is bounded: a splitter is a conversation of at most SKELETON_NODES divided by
the number of shards turns, so the skeleton has at most SKELETON_NODES nodes.  The sample decides about the balance
of the shards only.  Texts are not shuffled, only digests and word counts; one conversation's are held by one task.

Defined results: rows without conv_id are left out; a null turn comes first; turns of one number are ordered by their
digests, so repeated rows stay next to each other; null roles and texts are empty; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sandboxlake.llm.mixing import n_words
from sandboxlake.session import settle

DIGEST = 16
SAMPLED_PER_SHARD = 8
SKELETON_NODES = 200_000
IDS_PER_TEXT = 4096
ROWS_PER_BATCH = 4096
FAMILY = 20  # conversations c - c % FAMILY and on start alike
HEADS = 4  # they take over 0 to HEADS - 1 turns

_NODE, _PARTIAL, _ENDS = 0, 1, 2
_SCHEMA = (
    "kind int, shard int, no long, skel int, parent_no long, parent_skel int, conv_id long, depth long, "
    "n_convs long, n_children long, n_leaves long, saved long, words long, ends string"
)
_ARROW = pa.schema([
    ("kind", pa.int32()), ("shard", pa.int32()), ("no", pa.int64()), ("skel", pa.int32()), ("parent_no", pa.int64()),
    ("parent_skel", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("words", pa.int64()), ("ends", pa.string()),
])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of every conversation c: the first h turns of conversation c - c % 20, then c's own
    turns after its first h, with h = crc32(c) % 4."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    conv = F.col("conv_id")
    turns = conversations.filter(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("family"), conv.cast("long").alias("conv_id"), "turn", digest.alias("digest"), n_words(text).alias("words")
    )
    # one exchange, by family, serves the grouping and the window
    own = turns.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("turns"))
    first = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("turns", 1, HEADS - 1))).over(W.partitionBy("family"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    joined = own.withColumn("first", first).withColumn("h", h)
    none = F.slice("turns", 1, 0)
    whole = F.concat(F.coalesce(F.slice("first", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return joined.select("conv_id", whole.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )


class Skeleton:
    """The trie of the splitter paths.  Nodes are numbered so that a parent comes before its children; 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = sorted(splitters)
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent = [-1]
        for path, _ in self.splitters:
            node = 0
            for at in range(0, len(path), DIGEST):
                step = (node, path[at : at + DIGEST])
                node = self.child.get(step, -1)
                if node < 0:
                    node = self.child[step] = len(self.parent)
                    self.parent.append(step[0])

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect.bisect_left(self.splitters, (path, conv_id))


def choose_splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most shards - 1 rows that cut a sample of the rows into equal parts."""
    fits = paths.filter(F.size("words") <= max(SKELETON_NODES // shards, 1)).select("path", "conv_id")
    sample = fits.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLED_PER_SHARD * shards)
    placed = sample.withColumn("at", F.row_number().over(W.orderBy("path", "conv_id")))
    cut = placed.filter((F.col("at") % SAMPLED_PER_SHARD == 0) & (F.col("at") < SAMPLED_PER_SHARD * shards))
    return [(bytes(r["path"]), r["conv_id"]) for r in cut.select("path", "conv_id").collect()]


class _Open:
    """A node whose members are being read."""

    __slots__ = ("buffer", "children", "convs", "digest", "hash", "leaves", "least", "no", "saved", "skel", "words")

    def __init__(self, digest: bytes, words: int, no: int, skel: int | None):
        self.digest, self.words, self.no, self.skel = digest, words, no, skel
        self.least: int | None = None
        self.convs = self.children = self.leaves = self.saved = 0
        self.hash = None
        self.buffer: list[str] = []

    def ends(self, conv_id: int) -> None:
        self.convs += 1
        self.least = conv_id if self.least is None else min(self.least, conv_id)
        if self.skel is not None:
            self.buffer.append(str(conv_id))
        elif self.hash is None:
            self.hash = hashlib.sha256(str(conv_id).encode())
        else:
            self.hash.update(f",{conv_id}".encode())

    def closes(self, parent: _Open) -> None:
        """Add to the parent what it has; a skeleton node is counted as a child, leaf or saving only once all shards are."""
        if self.skel is None:
            self.leaves += self.children == 0
            self.saved += (self.convs - 1) * self.words
            parent.children += 1
        parent.convs += self.convs
        parent.leaves += self.leaves
        parent.saved += self.saved
        parent.least = self.least if parent.least is None else min(parent.least, self.least)


def _walk(shard: int, rows: Iterable[tuple[int, bytes, list[int]]], skeleton: Skeleton) -> Iterator[tuple]:
    """Rows of _SCHEMA of a shard whose rows come sorted by path and id."""
    count = 0
    stack = [_Open(b"", 0, 0, 0)]

    def ids(node: _Open) -> tuple:
        text = ",".join(node.buffer)
        node.buffer.clear()
        return (_ENDS, shard, count, node.skel, None, None, None, None, None, None, None, None, None, text)

    def closed(node: _Open, parent: _Open | None, depth: int) -> Iterator[tuple]:
        if node.buffer:
            yield ids(node)
        if parent is not None:
            node.closes(parent)
        kind = _NODE if node.skel is None else _PARTIAL
        above = (None, None) if parent is None else (parent.no if parent.skel is None else None, parent.skel)
        ends = None if node.skel is not None else (node.hash or hashlib.sha256()).hexdigest()
        yield (kind, shard, node.no, node.skel, *above, node.least, depth, node.convs, node.children, node.leaves, node.saved, node.words, ends)

    for conv_id, path, words in rows:
        depth = len(path) // DIGEST
        same = 0
        while same < depth and same + 1 < len(stack) and stack[same + 1].digest == path[same * DIGEST : (same + 1) * DIGEST]:
            same += 1
        while len(stack) > same + 1:
            node = stack.pop()
            yield from closed(node, stack[-1], len(stack))
        for at in range(same, depth):
            digest, above = path[at * DIGEST : (at + 1) * DIGEST], stack[-1].skel
            count += 1
            stack.append(_Open(digest, words[at], count, None if above is None else skeleton.child.get((above, digest))))
        stack[-1].ends(conv_id)
        count += 1
        if len(stack[-1].buffer) >= IDS_PER_TEXT:
            yield ids(stack[-1])
    while stack[-1].convs or len(stack) > 1:
        node = stack.pop()
        yield from closed(node, stack[-1] if stack else None, len(stack))
        if not stack:
            return


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_PER_BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _placer(skeleton) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, ids = batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()
            shards = [skeleton.value.shard(p, c) for p, c in zip(paths, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), *batch.columns], names=["shard", *batch.schema.names])

    return place


def _walker(skeleton) -> Callable:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[int] = []

        def rows() -> Iterator[tuple[int, bytes, list[int]]]:
            for batch in batches:
                if batch.num_rows and not shard:
                    shard.append(batch.column("shard")[0].as_py())
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "words")), strict=True)

        stream = rows()
        first = next(stream, None)
        if first is None:
            return

        def whole() -> Iterator[tuple[int, bytes, list[int]]]:
            yield first
            yield from stream

        yield from _batches(_walk(shard[0], whole(), skeleton.value), _ARROW)

    return walk


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(skel, ends_sha256) of texts that come sorted by node and place."""
    def rows() -> Iterator[tuple[int, str]]:
        node, running = None, None
        for batch in batches:
            for skel, text in zip(batch.column("skel").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if skel != node:
                    if node is not None:
                        yield node, running.hexdigest()
                    node, running = skel, hashlib.sha256(text.encode())
                else:
                    running.update(b"," + text.encode())
        if node is not None:
            yield node, running.hexdigest()

    yield from _batches(rows(), pa.schema([("skel", pa.int32()), ("ends_sha256", pa.string())]))


def _skeleton_nodes(parts: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Skeleton nodes: partial sums added up over the shards, then up the skeleton, which has a bounded size."""
    summed = parts.filter(F.col("kind") == _PARTIAL).groupBy("skel").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("words").alias("words"),
    )
    found = {r["skel"]: r.asDict() for r in summed.collect()}
    for skel in found:
        if skel:
            found[skeleton.parent[skel]]["n_children"] += 1
    own = {skel: (int(r["n_children"] == 0), (r["n_convs"] - 1) * r["words"]) for skel, r in found.items()}
    for skel in sorted(found, reverse=True):
        leaves, saved = own[skel]
        found[skel]["n_leaves"] += leaves
        found[skel]["saved"] += saved
        if skel:
            above = own[skeleton.parent[skel]]
            own[skeleton.parent[skel]] = (above[0] + leaves, above[1] + saved)
    rows = [
        (skel, r["conv_id"], r["depth"], found[skeleton.parent[skel]]["conv_id"] if skel else None, r["n_convs"], r["n_children"], r["n_leaves"], r["saved"])
        for skel, r in found.items()
    ]
    schema = "skel int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    return parts.sparkSession.createDataFrame(rows, schema)


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of (conv_id, path, words); ``shards`` follows the shuffle partitions if not given."""
    spark = paths.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = settle(paths)
    skeleton = Skeleton(choose_splitters(paths, shards))
    shared = spark.sparkContext.broadcast(skeleton)
    placed = paths.mapInArrow(_placer(shared), "shard int, conv_id long, path binary, words array<long>")
    sorted_shards = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("path", "conv_id")
    parts = settle(sorted_shards.mapInArrow(_walker(shared), _SCHEMA))

    texts = parts.filter(F.col("kind") == _ENDS).select("skel", "shard", "no", "ends")
    hashed = texts.repartition("skel").sortWithinPartitions("skel", "shard", "no").mapInArrow(_hash_ends, "skel int, ends_sha256 string")
    split = settle(_skeleton_nodes(parts, skeleton).join(hashed, "skel", "left").fillna(hashlib.sha256().hexdigest(), ["ends_sha256"]))

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = parts.filter(F.col("kind") == _NODE).withColumnsRenamed({"saved": "saved_tokens", "ends": "ends_sha256"})
    parents = split.select(F.col("skel").alias("parent_skel"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.filter(F.col("parent_skel").isNotNull()).join(F.broadcast(parents), "parent_skel")
    inner = nodes.filter(F.col("parent_no").isNotNull())
    above = nodes.select("shard", F.col("no").alias("parent_no"), F.col("conv_id").alias("parent_conv_id"))
    inside = inner.join(above.hint("merge"), ["shard", "parent_no"])
    return split.select(columns).unionByName(below.select(columns)).unionByName(inside.select(columns))
