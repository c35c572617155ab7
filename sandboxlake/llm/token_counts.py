"""Edit-aware token counts: a segment tree over the pre-tokens of each document, updated where edits touch it.

A document is cut into leaves of LEAF_STRETCHES stretches (see ``tokens``); a leaf knows its length in
characters and its number of tokens, and the inner nodes of the tree are their sums.  The root is the
count of the document.  An edit finds its leaves by going down the tree of lengths, changes their text and
leaves the others alone.  Where it breaks a boundary, so that the next leaf no longer begins with white
space after something else, the two leaves are joined; that is the boundary context.  Only changed leaves
are encoded again, those of a whole batch in one go, and the sums above them are renewed.

Trees are rows (leaf lengths and tree of counts in arrays), so they can be stored with the documents and
the edits of a later day applied without encoding the documents again.

Defined results: a null text is an empty one, with one empty leaf and no tokens; null or empty lists of
edits change nothing; edits apply one after the other, at positions in the text as it is then, cut to its
length; repeated rows are counted each; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sandboxlake.llm import texts, tokens
from sandboxlake.llm.running import small_batches

LEAF_STRETCHES = 32
_BLANK = " \t\n\v\f\r"

TREE = T.StructType([T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])
EDITS = "array<struct<start:bigint,stop:bigint,text:string>>"
CHANGED = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())),
    T.StructField("encoded_chars", T.LongType()),
])


def tree_of(leaves: np.ndarray) -> np.ndarray:
    """Sums in heap order: the root at 1, the leaves in the second half."""
    width = 1 << max(len(leaves) - 1, 0).bit_length()
    tree = np.zeros(2 * width, np.int64)
    tree[width : width + len(leaves)] = leaves
    while width > 1:
        tree[width // 2 : width] = tree[width : 2 * width : 2] + tree[width + 1 : 2 * width : 2]
        width //= 2
    return tree


def put(tree: np.ndarray, leaf: int, value: int) -> None:
    """Set a leaf, and the sums on its way to the root."""
    at = leaf + len(tree) // 2
    step = value - tree[at]
    while at:
        tree[at] += step
        at //= 2


def find(tree: np.ndarray, position: int) -> tuple[int, int]:
    """The leaf that holds a position (the last one for the end of the text), and the position in it."""
    at = 1
    while at < len(tree) // 2:
        at *= 2
        if position > tree[at] or (position == tree[at] and tree[at + 1] > 0):
            position -= int(tree[at])
            at += 1
    return at - len(tree) // 2, position


class EditedText:
    """The leaves of one document, and which of them edits have changed."""

    def __init__(self, text: str, lengths: np.ndarray):
        ends = np.concatenate(([0], np.cumsum(lengths))).tolist()
        self.leaves = [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        self.lengths = tree_of(np.asarray(lengths, np.int64))
        self.changed: set[int] = set()

    def _set(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        self.changed.add(leaf)
        put(self.lengths, leaf, len(text))

    def _neighbour(self, leaf: int, step: int) -> int:
        leaf += step
        while 0 <= leaf < len(self.leaves) and not self.leaves[leaf]:
            leaf += step
        return leaf

    def replace(self, start: int, stop: int, text: str) -> None:
        size = int(self.lengths[1])
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        leaf, at = find(self.lengths, start)
        last, end = find(self.lengths, stop)
        if last < leaf:
            last, end = leaf, at
        tail = self.leaves[last][end:]
        head = self.leaves[leaf][:at]
        for other in range(leaf + 1, last + 1):
            self._set(other, "")
        self._set(leaf, head + text + tail)
        after = self._neighbour(leaf, 1)
        if after < len(self.leaves):
            self._join(leaf, after)
        before = self._neighbour(leaf, -1)
        if before >= 0 and self.leaves[leaf]:
            self._join(before, leaf)

    def _join(self, left: int, right: int) -> None:
        """Make one leaf of two whose boundary is none between stretches."""
        a, b = self.leaves[left], self.leaves[right]
        if a and (a[-1].isspace() or b[0] not in _BLANK):
            self._set(left, a + b)
            self._set(right, "")


def _leaf_sizes(data: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each text the lengths of its leaves in characters; byte bounds of all leaves, and the leaves before each text."""
    starts, first = tokens.stretches(data, bounds)
    begins = np.cumsum(np.concatenate(([0], (data & 0xC0) != 0x80)))
    leaf_starts, lengths, leaves = [], [], [0]
    for low, high, end in zip(first[:-1].tolist(), first[1:].tolist(), bounds[1:].tolist(), strict=True):
        own = starts[low:high:LEAF_STRETCHES] if high > low else np.array([end])
        # a text may hold white space beyond ASCII, which no leaf may part from its neighbours
        edges = np.append(own, end)
        leaf_starts.append(own)
        lengths.append(np.diff(begins[edges]))
        leaves.append(leaves[-1] + len(own))
    return lengths, np.append(np.concatenate(leaf_starts), len(data)), np.array(leaves)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)))


@F.arrow_udf(TREE)
def _trees(column: pa.Array) -> pa.Array:
    lengths, counts = [], []
    for data, bounds in texts.chunks(column):
        odd = set(tokens._odd_texts(data, bounds))
        own, leaf_bounds, leaves = _leaf_sizes(data, bounds)
        _, at = tokens.encode(data, leaf_bounds)
        per_leaf = np.diff(at)
        for text in range(len(bounds) - 1):
            counts_here, lengths_here = per_leaf[leaves[text] : leaves[text + 1]], own[text]
            if text in odd:  # one leaf, as its stretches need not fall apart
                whole = data[bounds[text] : bounds[text + 1]].tobytes().decode()
                lengths_here, counts_here = np.array([len(whole)]), np.array([len(tokens.encode_whole(whole))])
            lengths.append(lengths_here)
            counts.append(tree_of(counts_here))
    return pa.StructArray.from_arrays([_lists(lengths), _lists(counts)], names=["lengths", "counts"])


@F.arrow_udf(CHANGED)
def _changed(text: pa.Array, lengths: pa.Array, counts: pa.Array, edits: pa.Array) -> pa.Array:
    rows, encoded, pieces, where = [], [], [], []
    for content, sizes, tree, todo in zip(text.to_pylist(), lengths.to_pylist(), counts.to_pylist(), edits.to_pylist(), strict=True):
        own = EditedText(content or "", np.array(sizes, np.int64))
        for edit in todo or []:
            own.replace(edit["start"], edit["stop"], edit["text"] or "")
        rows.append((own, np.array(tree, np.int64)))
        for leaf in sorted(own.changed):
            pieces.append(own.leaves[leaf])
            where.append((len(rows) - 1, leaf))
        encoded.append(sum(len(own.leaves[leaf]) for leaf in own.changed))
    new = [len(ids) for part, at in tokens.encode_column(pa.array(pieces, pa.string())) for ids in np.split(part, at[1:-1])]
    for (row, leaf), count in zip(where, new, strict=True):
        put(rows[row][1], leaf, count)
    arrays = [
        pa.array(["".join(own.leaves) for own, _ in rows], pa.string()),
        _lists([own.lengths[len(own.lengths) // 2 :][: len(own.leaves)] for own, _ in rows]), _lists([tree for _, tree in rows]), pa.array(encoded, pa.int64()),
    ]
    return pa.StructArray.from_arrays(arrays, names=["text", "lengths", "counts", "encoded_chars"])


def with_trees(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a tree per row in column ``name``."""
    small_batches(docs.sparkSession)
    return docs.withColumn(name, _trees(F.col(text).cast("string")))


def n_tokens(tree: Column) -> Column:
    """The root of a tree."""
    return tree["counts"][1]


def apply_edits(trees: DataFrame, edits: str | Column, tree: str, name: str, text: str = "text") -> DataFrame:
    """Adds ``name``: the changed text, its tree, and how many characters had to be encoded again."""
    todo = (F.col(edits) if isinstance(edits, str) else edits).cast(EDITS)
    return trees.withColumn(name, _changed(F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(tree)["lengths"], F.col(tree)["counts"], todo))


def clean_up_edits(text: Column) -> Column:
    """Edits as a cleaning step makes them: the first number of six digits or more is masked, a first line is dropped
    if others follow, and a closing line is added.  Positions are those at the time of each edit."""
    number = r"[0-9]{6,}"
    mask = "<NUM>"
    at = F.regexp_instr(text, F.lit(number))
    length = F.length(F.regexp_substr(text, F.lit(number)))
    masked = F.when(at > 0, F.length(text) - length + len(mask)).otherwise(F.length(text))
    first_line = F.instr(F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(mask), F.substr(text, at + length))).otherwise(text), "\n")

    def edit(start: Column, stop: Column, new: str) -> Column:
        return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(new).alias("text"))

    left = masked - first_line
    return F.array_compact(F.array(
        F.when(at > 0, edit(at - 1, at - 1 + length, mask)),
        F.when(first_line > 0, edit(F.lit(0), first_line, "")),
        F.when(text.isNotNull(), edit(left, left, "\nEND OF TEXT")),
    ))
