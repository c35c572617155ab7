"""Spelling variants: words one edit apart, found by search schemes on a bidirectional FM-index.

Of two words one edit apart, the longer one of M code points, either the first M // 2 code points are equal or the last
M - M // 2.  So every word is filed under both halves, as the longer one (M its length) and as the shorter
one (M its length and one), and near words meet under a half that they share.  Groups of words under one half are
gathered in shards.  A shard concatenates its words with delimiters, ``$word$word$``, and indexes that text and its
reverse (suffix order, its transform and rank queries).  Every word of the shard then searches it: the exact half from its
delimiter inwards, on from there with one error (another code point, or one left out), and to the other delimiter
without.  A search is an interval of suffix ranks; all searches of a shard go on together as arrays.

A half may be shared by very many words.  Such a group is filed anew, under the shared half and half of what lies between
the halves, by the same rule, until every group is small; at the end of that road stand words that are equal but
for one place, of which there are only as many as code points.  So no word or pair is left out, whatever the group's size.

Defined results: a null text has no words; a null id is empty in the text that is hashed; runs are the maximal ones of the
given code points; a table without words gives an empty result; repeated rows count each; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sandboxlake.session import settle

LETTERS = r"[a-z\u00C0-\u00FF]"  # of texts whose A-Z are lower case already
LEAST_CHARS = 5
LEAST_COUNT = 3
TYPO_RATE = 97
WORDS_PER_GROUP = 5_000  # larger groups are filed anew
WORDS_PER_SHARD = 20_000
STATES_AT_ONCE = 200_000
_DELIMITER = 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of all texts.  Of one in TYPO_RATE runs, by a hash of id and run, one code point is deleted."""
    # a run and its word have the least length at least, so shorter runs need not be taken out of their texts
    lowered = F.translate(F.col(f"`{text}`").cast("string"), _UPPER, _LOWER)
    runs = F.regexp_extract_all(lowered, F.lit(f"{LETTERS}{{{LEAST_CHARS},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = each.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.col("h") % F.length("run")
    shorter = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
    word = F.when(F.col("h") % TYPO_RATE == 0, shorter).otherwise(F.col("run"))
    return (
        hashed.select(word.alias("word")).filter(F.length("word") >= LEAST_CHARS)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)
    )


def _halves(longer: Column, head: Column, tail: Column) -> Column:
    """Two ways on from words whose first ``head`` and last ``tail`` code points are shared: more of either end."""
    between = longer - head - tail
    first = F.floor(between / 2).cast("int")
    return F.array(F.struct((head + first).alias("head"), tail.alias("tail")), F.struct(head.alias("head"), (tail + between - first).alias("tail")))


def _filed(words: DataFrame) -> DataFrame:
    """(word, longer, head, tail): both halves of each word, as the longer and as the shorter of a pair."""
    lengths = F.array(F.length("word"), F.length("word") + 1)
    sized = words.select("word", F.explode(lengths).alias("longer"))
    return sized.select("word", "longer", F.explode(_halves(F.col("longer"), F.lit(0), F.lit(0))).alias("h")).select("word", "longer", "h.head", "h.tail")


_GROUP = ("longer", "head", "tail", "first", "last")


def _with_ends(filed: DataFrame) -> DataFrame:
    ends = F.substring("word", F.lit(1), F.col("head")), F.substring("word", F.length("word") - F.col("tail") + 1, F.col("tail"))
    return filed.withColumn("first", ends[0]).withColumn("last", ends[1])


def small_groups(words: DataFrame, most: int = WORDS_PER_GROUP) -> DataFrame:
    """(word, longer, head, tail, group): every word under its halves, refined until no group has more than ``most`` words.

    Groups are counted with a map-side step.  A group whose halves leave a single place between them has only as
    many words as there are code points, and is not refined.
    """
    done: list[DataFrame] = []
    filed = settle(_with_ends(_filed(words)))
    while True:
        large = settle(
            filed.filter(F.col("longer") - F.col("head") - F.col("tail") > 1).groupBy(*_GROUP).count().filter(F.col("count") > most).select(*_GROUP)
        )
        if large.isEmpty():
            done.append(filed)
            break
        done.append(filed.join(large.hint("merge"), list(_GROUP), "left_anti"))
        again = filed.join(large.hint("merge"), list(_GROUP), "left_semi")
        parts = F.explode(_halves(F.col("longer"), F.col("head"), F.col("tail"))).alias("h")
        filed = settle(_with_ends(again.select("word", "longer", parts).select("word", "longer", "h.head", "h.tail")))
    union = done[0]
    for part in done[1:]:
        union = union.unionByName(part)
    return union.select("word", "longer", "head", "tail", F.xxhash64(*_GROUP).alias("group"))


class Ranks:
    """Suffix order of a text of numbers from 1 on, and rank queries on its transform.  A 0 marks the end of the text.

    An interval [low, high) holds the ranks of the suffixes that begin with a pattern; ``extend`` gives that of
    the pattern with one more character in front.
    """

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0)
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while True:
            behind = np.zeros(n, np.int64)
            behind[: n - step] = rank[step:] + 1
            both = rank * (max(int(behind.max()), 1) + 1) + behind
            self.order = np.argsort(both, kind="stable")
            ordered = both[self.order]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            step *= 2
            if rank.max() == n - 1 or step >= n:
                break
        before = text[self.order - 1].astype(np.int64)
        self.n = n
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        # places of each symbol in the transform, as one sorted array: a rank is a difference of two searches
        self.places = np.sort(before * (n + 1) + np.arange(n))

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = symbol * (self.n + 1)
        return np.searchsorted(self.places, base + low), np.searchsorted(self.places, base + high)


class Index:
    """Bidirectional index of the words of a shard; code points are numbered from 2 in their order, 1 is the delimiter."""

    def __init__(self, words: list[str]):
        lengths = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        known, numbers = np.unique(points, return_inverse=True)
        self.symbols = len(known) + 2
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1))) + 1  # of each word in the text
        text = np.ones(self.starts[-1], np.int64)
        self.word_at = np.repeat(np.arange(len(words) + 1), np.concatenate((lengths + 1, [1])))
        text[np.arange(len(points)) + np.repeat(np.arange(1, len(words) + 1), lengths)] = numbers + 2
        self.text = text
        self.leftward, self.rightward = Ranks(text, self.symbols), Ranks(text[::-1].copy(), self.symbols)

    def near(self, asked: np.ndarray, lengths: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked word, word found): words one replaced or left out code point from an asked one, whose first ``heads`` and
        last ``tails`` code points are the asked one's; the larger of the two is the half that is matched exactly."""
        found = []
        for forward, part in ((True, heads >= tails), (False, heads < tails)):
            which = np.flatnonzero(part)
            for at in range(0, len(which), max(STATES_AT_ONCE // self.symbols, 1)):
                some = which[at : at + max(STATES_AT_ONCE // self.symbols, 1)]
                exact, rest = (heads, tails) if forward else (tails, heads)
                found.append(self._search(forward, asked[some], lengths[some], exact[some], rest[some]))
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))

    def _search(self, forward: bool, asked: np.ndarray, lengths: np.ndarray, exact: np.ndarray, rest: np.ndarray):
        """One direction of the scheme.  ``forward`` goes rightwards from a word's front, on the index of the reversed text."""
        ranks = self.rightward if forward else self.leftward
        starts = self.starts[asked]

        def symbol(query: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The code point of a word that is ``at`` steps inwards; beyond its last one stands the delimiter."""
            return self.text[starts[query] + at if forward else starts[query] + lengths[query] - 1 - at]

        query = np.arange(len(asked))
        low, high = (np.full(len(asked), ranks.first[symbol]) for symbol in (_DELIMITER, _DELIMITER + 1))
        pairs = [np.zeros((2, 0), np.int64)]
        # states that have made their error wait by the number of code points they have read
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for at in range(int(lengths.max(initial=0)) + 2):
            if at in waiting:
                # errors at different places may have led to the same interval
                q, lo, hi = (np.concatenate(part) for part in zip(*waiting.pop(at), strict=True))
                order = np.lexsort((hi, lo, q))
                q, lo, hi = q[order], lo[order], hi[order]
                new = np.append(True, (q[1:] != q[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
                q, lo, hi = q[new], lo[new], hi[new]
                end = lengths[q] == at
                lo, hi = ranks.extend(lo, hi, symbol(q, np.full(len(q), at)))
                alive = lo < hi
                done = alive & end
                if done.any():
                    place = ranks.order[lo[done]]
                    # a match ends with both delimiters, so it is one word; its place is that of the last one read
                    place = len(self.text) - 1 - place if forward else place
                    word = self.word_at[place] - 1 if forward else self.word_at[place]
                    pairs.append(np.stack((asked[q[done]], word)))
                go = alive & ~end
                if go.any():
                    waiting.setdefault(at + 1, []).append((q[go], lo[go], hi[go]))
            if not len(query):
                continue
            # an error may be made at this code point: it is left out, or any other one stands in its place
            may = (at >= exact[query]) & (at < lengths[query] - rest[query])
            if may.any():
                q, lo, hi = query[may], low[may], high[may]
                waiting.setdefault(at + 1, []).append((q, lo, hi))
                own = symbol(q, np.full(len(q), at))
                any_symbol = np.tile(np.arange(_DELIMITER + 1, self.symbols), len(q))
                q, lo, hi, own = (np.repeat(x, self.symbols - 1 - _DELIMITER) for x in (q, lo, hi, own))
                other = any_symbol != own
                q, lo, hi, any_symbol = q[other], lo[other], hi[other], any_symbol[other]
                lo, hi = ranks.extend(lo, hi, any_symbol)
                alive = lo < hi
                if alive.any():
                    waiting.setdefault(at + 1, []).append((q[alive], lo[alive], hi[alive]))
            go = at < lengths[query] - rest[query]
            query, low, high = query[go], low[go], high[go]
            if len(query):
                low, high = ranks.extend(low, high, symbol(query, np.full(len(query), at)))
        return np.concatenate(pairs, axis=1)


def _near_in_shard(table: pa.Table) -> pa.Table:
    """(word, near) of the words that are filed together, both ways round; a pair may come more than once."""
    words = table.column("word").to_pylist()
    distinct = sorted(set(words))
    number = {w: i for i, w in enumerate(distinct)}
    ids = np.array([number[w] for w in words], np.int64)
    longer, heads, tails = (table.column(c).to_numpy().astype(np.int64) for c in ("longer", "head", "tail"))
    lengths = np.array([len(w) for w in distinct], np.int64)[ids]
    asks = longer == lengths  # the shorter words of pairs are only looked for
    a, b = Index(distinct).near(ids[asks], lengths[asks], heads[asks], tails[asks])
    both = np.unique(np.concatenate((np.stack((a, b)), np.stack((b, a))), axis=1), axis=1)
    both = both[:, both[0] != both[1]]
    return pa.table({"word": pa.array([distinct[i] for i in both[0]], pa.string()), "near": pa.array([distinct[i] for i in both[1]], pa.string())})


def near_words(words: DataFrame, most: int = WORDS_PER_GROUP, shard: int = WORDS_PER_SHARD) -> DataFrame:
    """(word, near): all pairs of distinct words that one inserted, deleted or replaced code point tells apart, both ways round."""
    filed = small_groups(words, most)
    shards = max(1, -(-filed.count() // shard))
    placed = filed.withColumn("shard", F.pmod("group", F.lit(shards)))
    found = placed.groupBy("shard").applyInArrow(_near_in_shard, "word string, near string")
    return found.distinct()


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n): the form is the most frequent near word, if it is at least
    twice as frequent; the root is where following forms ends.

    Counts at least double from form to form, so roots are found in a number of rounds that grows with the logarithm
    of that of doublings; each round follows twice as many forms as the one before.
    """
    words = settle(words)
    pairs = settle(near_words(words.select("word")))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    found = pairs.join(counts.hint("merge"), "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(found.hint("merge"), "word", "left")
    likely = -F.col("best.less") >= 2 * F.col("n")
    formed = settle(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("best.form")).alias("form"),
        F.when(likely, -F.col("best.less")).alias("form_n"),
    ))
    roots = formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        roots = settle(roots)
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = roots.join(onward.hint("merge"), "root")
        if moved.isEmpty():
            break
        roots = roots.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("onward", "root").alias("root"))
    return formed.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
