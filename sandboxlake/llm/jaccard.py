"""N-gram Jaccard join: pairs of documents whose sets of five-word shingles overlap by 80 % or more.

Documents with the same set are one class.  Classes meet in tiles: a tile holds the classes that share a
shingle among their first ones (in one order of all shingles, a fifth of a set and one more is enough for
every pair that links to meet) and whose sizes lie in the same or the next band of sizes.  Inside a tile,
hashed bitmaps are compared first: each differing bit stands for at least one shingle that only one of the
sets has, so counting bits bounds the overlap from above.  What passes is decided by intersecting the
sorted sets.

Groups of near copies would make a tile quadratic.  So each class is first linked with the one it shares
most tiles with among the first ones of its tiles, then, where tiles still hold several components, with those
by six other orders; afterwards only pairs between different components are examined, as any other pair
cannot change a component.  Shingles that a 64th of the
documents shows to be very frequent come last in the order.  Every order finds every link, so that sample
decides about time only.

Sets are compared by 64-bit hashes of shingles, and classes are told apart by a 64-bit sum over the set.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing;
shorter texts than five words have one shingle; repeated rows are one class; a component of documents
that all lack an id has the id null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sandboxlake.llm import texts
from sandboxlake.llm.columns import fresh
from sandboxlake.llm.components import connected
from sandboxlake.llm.running import release_shuffles, small_batches
from sandboxlake.session import settle

MIN_PERCENT = 80
_HAS_WORD = r"[^\x20\x09-\x0D]"
SAMPLE = 64  # one in so many distinct texts is looked at for the order of shingles
FREQUENT = 4  # a shingle in so many of them comes last
MOST_FREQUENT = 500_000  # of those, as many are told to the tasks: four megabytes; the others keep their place
BITS_PER_KEY = 16
MOST_BITS = 1 << 29  # 64 megabytes
_SUMMARY_WORDS = 8
_LEAST_BITS = 64 * _SUMMARY_WORDS
_ORDERS = [int(v) for v in texts.mix(np.arange(7, dtype=np.uint64)).view(np.int64)]  # the first changes nothing
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _sets(column: pa.Array):
    for data, bounds in texts.chunks(column):
        yield texts.shingle_sets(data, bounds)


def _class_of(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    running = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(texts.mix(sets ^ _SALT), out=running[1:])
    return _signed(texts.mix(running[bounds[1:]] - running[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))


def _bitmap(own: np.ndarray) -> bytes:
    """Parities of the shingles per bit; as many bits as shingles at least, a power of two from 512 on."""
    bits = max(_LEAST_BITS, 1 << max(len(own) - 1, 0).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _summary(bitmap: bytes) -> list[int]:
    """The bitmap folded to 512 bits, as eight numbers."""
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, np.int64).reshape(-1, _SUMMARY_WORDS), axis=0).tolist()


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("bits", T.BinaryType())]))
def _sketch(column: pa.Array) -> pa.Array:
    sizes, classes, bitmaps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for sets, bounds in _sets(column):
        sizes.append(np.diff(bounds))
        classes.append(_class_of(sets, bounds))
        bitmaps += [_bitmap(sets[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    arrays = [pa.array(np.concatenate(sizes)), pa.array(np.concatenate(classes)), pa.array(bitmaps, pa.binary())]
    return pa.StructArray.from_arrays(arrays, names=["n", "cls", "bits"])


_CLASS_AND_LIST = T.StructType([T.StructField("cls", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))])


def _with_lists(classes: list[np.ndarray], sizes: list[np.ndarray], values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes])))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate([np.zeros(0, np.uint64), *values]))))
    return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *classes])), lists], names=["cls", "items"])


@F.arrow_udf(_CLASS_AND_LIST)
def _shingles(column: pa.Array) -> pa.Array:
    parts = [(_class_of(s, b), np.diff(b), s) for s, b in _sets(column)]
    return _with_lists(*([p[k] for p in parts] for k in range(3)))


_CLASS_AND_FIRST = T.StructType([*_CLASS_AND_LIST.fields, T.StructField("late", T.ArrayType(T.BooleanType()))])


def _first_shingles(last: np.ndarray):
    """A function of a text that gives its first shingles, and which of them are in ``last`` (sorted): they come after all others."""

    @F.arrow_udf(_CLASS_AND_FIRST)
    def first(column: pa.Array) -> pa.Array:
        classes, sizes, values, marks = [], [], [], [np.zeros(0, bool)]
        for sets, bounds in _sets(column):
            n = np.diff(bounds)
            late = last[np.minimum(np.searchsorted(last, sets), len(last) - 1)] == sets if len(last) else np.zeros(len(sets), bool)
            early = np.concatenate(([0], np.cumsum(~late)))
            behind = np.concatenate(([0], np.cumsum(late)))
            base, back = np.repeat(early[bounds[:-1]], n), np.repeat(behind[bounds[:-1]], n)
            total = np.repeat(early[bounds[1:]] - early[bounds[:-1]], n)
            place = np.where(late, total + behind[:-1] - back, early[:-1] - base)
            keep = place < np.repeat(n - (n * MIN_PERCENT + 99) // 100 + 1, n)
            classes.append(_class_of(sets, bounds))
            sizes.append(texts.per_text(keep, bounds))
            values.append(sets[keep])
            marks.append(late[keep])
        found = _with_lists(classes, sizes, values)
        lists = found.field("items")
        late = pa.ListArray.from_arrays(lists.offsets, pa.array(np.concatenate(marks)))
        return pa.StructArray.from_arrays([found.field("cls"), lists, late], names=["cls", "items", "late"])

    return first


@F.arrow_udf(T.BooleanType())
def _may_link(n_a: pa.Array, n_b: pa.Array, bits_a: pa.Array, bits_b: pa.Array) -> pa.Array:
    """Whether the bitmaps leave room for enough overlap."""
    out = []
    for n, m, x, y in zip(n_a.to_pylist(), n_b.to_pylist(), bits_a.to_pylist(), bits_b.to_pylist(), strict=True):
        if len(x) < len(y):
            x, y = y, x
        bits, wide, narrow = 8 * len(x), int.from_bytes(x, "little"), int.from_bytes(y, "little")
        while bits > 8 * len(y):
            bits //= 2
            wide = (wide >> bits) ^ (wide & ((1 << bits) - 1))
        out.append((100 + MIN_PERCENT) * (n + m - (wide ^ narrow).bit_count()) >= 2 * MIN_PERCENT * (n + m))
    return pa.array(out, pa.bool_())


@F.arrow_udf(T.LongType())
def _overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """Size of the intersection of two sorted sets."""
    out = []
    a_at, b_at = a.offsets.to_numpy(), b.offsets.to_numpy()
    a_all, b_all = (x.values.to_numpy(zero_copy_only=False) for x in (a, b))
    for i in range(len(a)):
        both = np.concatenate((a_all[a_at[i] : a_at[i + 1]], b_all[b_at[i] : b_at[i + 1]]))
        both.sort(kind="stable")
        out.append(int(np.count_nonzero(both[1:] == both[:-1])))
    return pa.array(out, pa.int64())


@F.arrow_udf(T.ArrayType(T.LongType()))
def _summaries(bits: pa.Array) -> pa.Array:
    return pa.array([_summary(b) for b in bits.to_pylist()], pa.list_(pa.int64()))


def _frequent(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles that many distinct texts of the sample share, at most MOST_FREQUENT of them."""
    sample = docs.select(text).filter(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0)
    sets = sample.groupBy(F.xxhash64(text).alias("_h")).agg(F.first(text).alias("_t")).select(F.explode(_shingles("_t")["items"]).alias("shingle"))
    found = sets.groupBy("shingle").count().filter(F.col("count") >= FREQUENT)
    rows = found.orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).select("shingle").toArrow()
    return np.sort(rows["shingle"].to_numpy().view(np.uint64))


def _among(keys: DataFrame, key: str):
    """A function of a column of 64-bit hashes: whether a hash may be one of ``keys``.  It may let others through, never
    loses one.

    A bit array, as large as the number of keys asks for but at most MOST_BITS; with more keys than that it lets more
    through.  Its words are put together by a grouping; only they reach the driver and the tasks.
    """
    bits = min(MOST_BITS, max(_LEAST_BITS, 1 << (BITS_PER_KEY * keys.count()).bit_length()))
    place = F.col(key).bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast({key} & 63 AS int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found["at"].to_numpy()] = found["word"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf(T.BooleanType())
    def may(hashes: pa.Array) -> pa.Array:
        at = hashes.to_numpy() & (bits - 1)
        return pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1, pa.bool_())

    return may.asNondeterministic()  # so that a filter on it is not moved to where its arguments come from


class _Corpus:
    """Documents with their classes; sets are worked out anew for the few classes that need comparing.

    A text is known by its document's id and a hash of the text, so rows without an id are as good as others.
    """

    def __init__(self, docs: DataFrame, key: str, text: str):
        small_batches(docs.sparkSession)
        plain = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
        self.docs = plain.select("doc", "text", F.xxhash64("doc", "text").alias("row"))
        self.members = settle(self.docs.select("doc", "row", _sketch("text").alias("s")).select("doc", "row", "s.*"))
        first = F.min_by(F.struct("doc", "row"), F.struct(F.col("doc").isNull(), "doc", "row")).alias("first")
        self.classes = settle(
            self.members.filter(F.col("n") > 0).groupBy("cls").agg(first, F.max("n").alias("n"), F.first("bits").alias("bits"))
            .select("cls", F.col("first.doc").alias("doc"), F.col("first.row").alias("row"), "n", "bits")
        )

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that link.

        Only texts of classes that the bitmaps leave open are fetched: the others are left out before the exchange.
        Texts and classes are both shuffled whatever the size, so that the plan does not change where the list of
        classes outgrows a broadcast, and no task runs two Python workers; texts stream by the classes of their
        partition unsorted.
        """
        sized = self.classes.select("cls", "row", "n", "bits")
        a, b = (sized.select(*[F.col(c).alias(f"{c}_{x}") for c in sized.columns]) for x in "ab")
        close = pairs.join(a, F.col("a") == F.col("cls_a")).join(b, F.col("b") == F.col("cls_b"))
        possible = settle(close.filter(_may_link("n_a", "n_b", "bits_a", "bits_b")).select("a", "b", "row_a", "row_b", "n_a", "n_b"))
        named = settle(  # its size is then known to the join
            possible.select(F.col("a").alias("cls"), F.col("row_a").alias("row")).unionByName(possible.select(F.col("b").alias("cls"), F.col("row_b").alias("row"))).distinct()
        )
        wanted = self.docs.select("row", "text", _among(named, "row")("row").alias("may")).filter("may").select("row", "text")
        own = wanted.join(named.hint("shuffle_hash"), "row")
        # no filter on what the function gives: it would be worked out once for the filter and once more behind it;
        # sets are known by the row they come from, so they stay where the join has brought their texts
        sets = own.select("row", "cls", _shingles("text").alias("s")).groupBy("row").agg(F.max_by("s.items", F.col("s.cls") == F.col("cls")).alias("items"))
        a, b = (sets.select(F.col("row").alias(f"row_{x}"), F.col("items").alias(f"items_{x}")) for x in "ab")
        both = possible.join(a, "row_a").join(b, "row_b")
        shared = both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("sum"), _overlap("items_a", "items_b").alias("shared"))
        return settle(shared.filter(100 * F.col("shared") >= MIN_PERCENT * (F.col("sum") - F.col("shared"))).select("a", "b"))


def _may_link_by_summary(x: str, y: str) -> Column:
    differing = sum(
        (F.bit_count(F.col(f"{x}.summary")[k].bitwiseXOR(F.col(f"{y}.summary")[k])) for k in range(_SUMMARY_WORDS)), F.lit(0)
    )
    total = F.col(f"{x}.n") + F.col(f"{y}.n")
    return (100 + MIN_PERCENT) * (total - differing) >= 2 * MIN_PERCENT * total


def _across(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes of different components that meet in a tile and whose summaries leave room for a link."""
    sized = classes.select("cls", "n", _summaries("bits").alias("summary"))
    band = F.floor(F.log("n") / F.log(F.lit(100 / MIN_PERCENT)))
    full = settle(rows.join(sized, "cls").withColumn("band", band))
    home = full.alias("y")
    guest = full.withColumn("band", F.explode(F.array("band", F.col("band") + 1))).alias("x")
    ordered = F.struct(F.col("x.n"), F.col("x.cls")) < F.struct(F.col("y.n"), F.col("y.cls"))
    fits = (100 * F.col("x.n") >= MIN_PERCENT * F.col("y.n")) & (F.col("x.comp") != F.col("y.comp")) & ordered
    tiles = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.band") == F.col("y.band"))
    met = guest.join(home, tiles & fits & _may_link_by_summary("x", "y"))
    return settle(met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct())


def _partners(met: DataFrame, orders: list[int]) -> DataFrame:
    """(a, b): for each class and order of classes, the first class of a tile that it shares most tiles with.

    An order is that of the class ids with some bits flipped, so that the first of a tile is a minimum of numbers
    with a map-side step.
    """
    firsts = met.groupBy("shingle").agg(*[F.min(F.col("cls").bitwiseXOR(F.lit(o))).alias(f"h{k}") for k, o in enumerate(orders)])
    heads = F.array(*[F.struct(F.lit(k).alias("order"), F.col(f"h{k}").bitwiseXOR(F.lit(o)).alias("b")) for k, o in enumerate(orders)])
    both = met.join(settle(firsts.select("shingle", heads.alias("heads"))), "shingle").select(F.col("cls").alias("a"), F.explode("heads").alias("h"))
    counted = both.select("a", "h.*").filter(F.col("a") != F.col("b")).groupBy("a", "order", "b").count()
    return settle(counted.groupBy("a", "order").agg(F.max_by("b", F.struct("count", "b")).alias("b")).select("a", "b").distinct())


def _open_tiles(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(shingle, cls, comp) of the tiles in which classes of different components meet."""
    placed = met.select("shingle", "cls").join(roots, F.col("cls") == F.col("node"), "left")
    placed = settle(placed.select("shingle", "cls", F.coalesce("root", "cls").alias("comp")).distinct())
    mixed = placed.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter(F.col("low") < F.col("high"))
    return placed.join(mixed.select("shingle"), "shingle")


def _components(corpus: _Corpus) -> DataFrame:
    """(node, root) of the classes that link with another one."""
    spark = corpus.docs.sparkSession
    first = _first_shingles(_frequent(corpus.docs, "text"))
    # shingles go through one exchange, in which those of a single class are dropped; frequent ones are kept
    # unseen, and spread over it
    each = F.arrays_zip(F.col("s.items").alias("shingle"), F.col("s.late").alias("late"))
    listed = corpus.docs.select(first("text").alias("s")).select("s.cls", F.inline(each))
    spread = F.when(F.col("late"), F.col("cls").bitwiseAND(F.lit(1023))).otherwise(F.lit(0).cast("bigint"))
    same = W.partitionBy("shingle", "spread")
    shared = F.col("late") | (F.min("cls").over(same) < F.max("cls").over(same))
    copy = F.coalesce(F.lag("cls").over(same.orderBy("cls")) == F.col("cls"), F.lit(False))
    marked = listed.withColumn("spread", spread).select("cls", "shingle", shared.alias("shared"), copy.alias("copy"))
    met = settle(marked.filter("shared AND NOT copy").select("cls", "shingle"))
    release_shuffles(spark)
    pairs = _partners(met, _ORDERS[:1])
    release_shuffles(spark)
    links = corpus.verified(pairs)
    release_shuffles(spark)
    # a group of near copies may still be in many components: other partners join most of them
    tiles = settle(_open_tiles(met, connected(links)))
    pairs = _partners(tiles, _ORDERS[1:])
    release_shuffles(spark)
    links = settle(links.unionByName(corpus.verified(pairs)))
    release_shuffles(spark)
    rows = _open_tiles(tiles, connected(links))
    more = corpus.verified(_across(rows, corpus.classes))
    return connected(links.unionByName(more))


def _labelled(corpus: _Corpus) -> DataFrame:
    """(cls, root) for every class with shingles."""
    roots = _components(corpus)
    return settle(
        corpus.classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "doc", "row", F.coalesce("root", "cls").alias("root"))
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, and component_id, the smallest key reachable by links."""
    corpus = _Corpus(docs, key, text)
    labels = _labelled(corpus)
    smallest = labels.groupBy("root").agg(F.min("doc").alias("component_id"))
    by_class = settle(labels.join(smallest, "root").select(F.col("cls").alias("_cls"), "component_id"))
    joined = corpus.members.join(by_class, (F.col("cls") == F.col("_cls")) & (F.col("n") > 0), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    return joined.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the document with the smallest key, and all documents without shingles, with their columns.

    Rows that repeat both the key and the set of shingles stay once.
    """
    corpus = _Corpus(docs, key, text)
    names = {n: fresh(n, docs.columns) for n in ("keep_doc", "keep_row", "row", "place")}
    first = F.min_by(F.struct("doc", "row"), F.struct(F.col("doc").isNull(), "doc", "row")).alias("k")
    keepers = settle(
        _labelled(corpus).groupBy("root").agg(first).select(F.col("k.doc").alias(names["keep_doc"]), F.col("k.row").alias(names["keep_row"]))
    )
    own = [F.col(f"`{c}`") for c in docs.columns]
    doc, content, row, place = F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"), F.col(names["row"]), F.col(names["place"])
    known = docs.withColumn(names["row"], F.xxhash64(doc, content))
    kept = known.join(keepers, doc.eqNullSafe(F.col(names["keep_doc"])) & (row == F.col(names["keep_row"])), "left_semi")
    single = kept.withColumn(names["place"], F.row_number().over(W.partitionBy(doc, row).orderBy(row))).filter(place == 1)
    wordless = docs.filter(~F.coalesce(F.regexp_like(content, F.lit(_HAS_WORD)), F.lit(False)))
    return single.select(*own).unionByName(wordless.select(*own))
