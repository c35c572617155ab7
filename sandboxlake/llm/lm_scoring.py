"""Masked pseudo-likelihood: a window network predicts every word from both sides; the summed log-probabilities score a document.

Words (A-Z in lower case) are the most frequent ones of the whole corpus, each with a number of its own,
and hash buckets for all others.  The network sees two words on either side, never the word itself: a
vector per neighbour and place, their sum through tanh, and a softmax in two levels: over groups of numbers, and over
the members of a word's group, so a word costs two short rows and not one of all numbers.  A third level tells the words
of a bucket apart, every one of the corpus: a word has its share of the bucket's occurrences.  These shares are a
table as long as the vocabulary, which documents meet in a join by word.

Training is numpy within tasks and Spark between them: in each round every partition starts from the same
parameters, goes through the positions of the round, and the parameters are averaged, weighted by positions, as one
aggregation over (place in the parameters, value).  The rounds share out all positions: each one is learnt from once.  Word counts are summed in each task before the shuffle.
Texts are turned into numbers once, for all rounds and the scores.  The driver holds the parameters and the counts of
the numbers, whose sizes do not depend on the input.

Defined results: a null or empty text, or one without words, has score 0 and a null mean; a text of one
word is predicted from padding alone; repeated rows are learnt from and scored each; an empty table gives
an empty result; other columns do no harm, as only the named ones are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sandboxlake.llm import texts
from sandboxlake.llm.running import small_batches
from sandboxlake.session import settle

WORDS = 512  # the most frequent words, each with its own number
BUCKETS = 256  # for all others
HIDDEN = 16
SIDES = (-2, -1, 1, 2)
ROUNDS = 2
BATCH = 512
RATE = 0.1
MOST_DISTINCT = 500_000  # words a task counts before it passes the counts on
_BLOCK = 4096  # positions at a time: their exponentials stay in a core's cache
_RUN = 1 << 15  # words of whole texts at a time
PAD = WORDS + BUCKETS
GROUPS = 16
MEMBERS = PAD // GROUPS  # numbers of a group; they follow each other, so the most frequent words share one


@dataclass(frozen=True)
class Vocabulary:
    hashes: np.ndarray  # of the frequent words, sorted
    numbers: np.ndarray  # their numbers, by rank
    counts: np.ndarray  # occurrences per number

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = WORDS + (hashes % np.uint64(BUCKETS)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            out[known] = self.numbers[at[known]]
        return out


def _shift(logits: np.ndarray) -> None:
    """Shift rows by their largest entry, if any entry is so far off that its exponential might leave its range."""
    if not (logits.size and -60 < logits.min() and logits.max() < 60):
        logits -= logits.max(axis=1, keepdims=True)


def _exponentials(logits: np.ndarray) -> np.ndarray:
    """Exponentials in place; returns the sums of rows."""
    _shift(logits)
    return np.exp(logits, out=logits) @ np.ones((logits.shape[1], 1), np.float32)


def _logs(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Logarithm of the share of one entry per row."""
    _shift(logits)
    picked = logits[np.arange(len(own)), own]
    sums = np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32)
    return picked - np.log(sums.astype(np.float64))


def _error(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Shares less the entry that is right, over the number of rows."""
    logits /= _exponentials(logits) * np.float32(len(own))
    logits[np.arange(len(own)), own] -= np.float32(1 / len(own))
    return logits


def _by_number(numbers: np.ndarray) -> np.ndarray:
    """Places in the order of numbers; short ones are sorted by their digits."""
    return np.argsort(numbers.astype(np.uint16), kind="stable")


def _spans(group: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, from, to) of the groups that occur, in a sorted list."""
    bounds = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    return [(g, a, b) for g, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]


@dataclass
class Network:
    near: np.ndarray  # (places, numbers and padding, hidden)
    bias: np.ndarray
    out: np.ndarray  # (groups, hidden, members)
    prior: np.ndarray  # (groups, members)
    group_out: np.ndarray
    group_prior: np.ndarray

    @staticmethod
    def fresh(counts: np.ndarray, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        near = rng.normal(0, 0.1, (len(SIDES), PAD + 1, HIDDEN)).astype(np.float32)
        share = ((counts + 1.0) / (counts + 1.0).sum()).reshape(GROUPS, MEMBERS)
        out = rng.normal(0, 0.1, (GROUPS, HIDDEN, MEMBERS)).astype(np.float32)
        group_out = rng.normal(0, 0.1, (HIDDEN, GROUPS)).astype(np.float32)
        priors = (np.log(p).astype(np.float32) for p in (share, share.sum(axis=1)))
        return Network(near, np.zeros(HIDDEN, np.float32), out, next(priors), group_out, next(priors))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in vars(self).values()])

    def like(self, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for p in vars(self).values():
            parts.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*parts)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.near[0].take(around[0], axis=0)
        for k in range(1, len(SIDES)):
            total += self.near[k].take(around[k], axis=0)
        total += self.bias
        return np.tanh(total, out=total)

    def _member_logits(self, h: np.ndarray, group: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
        """(positions, members) of the group of each position; positions are sorted by group."""
        logits = np.empty((len(h), MEMBERS), np.float32)
        for g, a, b in spans:
            np.matmul(h[a:b], self.out[g], out=logits[a:b])
        logits += self.prior[group]
        return logits

    def log_probabilities(self, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of each word given the words around it: of its group, and of the word in its group."""
        out = np.empty(len(ids))
        for low in range(0, len(ids), _BLOCK):
            order = low + _by_number(ids[low : low + _BLOCK])
            group, member = np.divmod(ids[order], MEMBERS)
            h = self.hidden(around[:, order])
            members = self._member_logits(h, group, _spans(group))
            out[order] = _logs(h @ self.group_out + self.group_prior, group) + _logs(members, member)
        return out

    def steps(self, around: np.ndarray, ids: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradient of the mean loss of positions sorted by number: by parameter, and of what goes into tanh."""
        group, member = np.divmod(ids, MEMBERS)
        spans = _spans(group)
        h = self.hidden(around)
        groups = _error(h @ self.group_out + self.group_prior, group)
        members = _error(self._member_logits(h, group, spans), member)
        back = groups @ self.group_out.T
        out = np.zeros_like(self.out)
        for g, a, b in spans:
            np.matmul(h[a:b].T, members[a:b], out=out[g])
            back[a:b] += members[a:b] @ self.out[g].T
        inside = np.zeros((GROUPS, len(ids)), np.float32)
        inside[group, np.arange(len(ids))] = 1
        prior = inside @ members
        back *= 1 - h * h
        found = {"out": out, "prior": prior, "group_out": h.T @ groups, "group_prior": groups.sum(axis=0), "bias": back.sum(axis=0)}
        return found, back

    def learn(self, around: np.ndarray, ids: np.ndarray, squares: Network) -> None:
        """One step of adaptive gradient descent on a batch."""
        order = _by_number(ids)
        around, ids = around[:, order], ids[order]
        found, back = self.steps(around, ids)
        for name, step in found.items():
            seen = getattr(squares, name)
            seen += step * step
            getattr(self, name)[...] -= RATE * step / np.sqrt(seen + 1e-8)
        # all places at once: the vectors are numbered through, and summed up one part of them after the other
        number = around + (np.arange(len(SIDES)) * (PAD + 1))[:, None]
        rows = np.flatnonzero(np.bincount(number.reshape(-1)))
        places = np.empty(rows[-1] + 1, np.int64)
        places[rows] = np.arange(len(rows))
        at = places[number].reshape(-1)
        parts = np.empty((HIDDEN, *number.shape))
        parts[:] = back.T[:, None, :]
        step = np.empty((HIDDEN, len(rows)), np.float32)
        for part in range(HIDDEN):
            step[part] = np.bincount(at, parts[part].reshape(-1), len(rows))
        step = np.ascontiguousarray(step.T)
        near, seen = self.near.reshape(-1, HIDDEN), squares.near.reshape(-1, HIDDEN)  # views
        total = seen.take(rows, axis=0)
        total += step * step
        seen[rows] = total
        total += np.float32(1e-8)
        np.sqrt(total, out=total)
        step *= np.float32(RATE)
        step /= total
        near[rows] = near.take(rows, axis=0) - step


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = texts.lower(data)
    starts, ends, first = texts.words(data, bounds)
    return texts.span_hashes(data, starts, ends), first


def contexts(ids: np.ndarray, first: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """(places, words): the numbers around each word of its own text, padding beyond its ends; of the words ``at`` only."""
    reach = max(SIDES)
    # all texts in a row, with as much padding between them as a word can see
    place = np.arange(len(ids)) + np.repeat(reach * np.arange(1, len(first)), np.diff(first))
    padded = np.full(len(ids) + reach * len(first), PAD)
    padded[place] = ids
    place = place[at]
    around = np.empty((len(SIDES), len(place)), padded.dtype)
    for k, side in enumerate(SIDES):
        np.take(padded, place + side, out=around[k], mode="clip")
    return around


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes and their counts in a partition."""
    hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["word", "n"])

    for batch in batches:
        for data, bounds in texts.chunks(batch.column(0)):
            found, n = np.unique(_word_hashes(data, bounds)[0], return_counts=True)
            hashes, which = np.unique(np.concatenate((hashes, found)), return_inverse=True)
            counts = np.bincount(which, np.concatenate((counts, n)), len(hashes)).astype(np.int64)
            if len(hashes) > MOST_DISTINCT:
                yield out()
                hashes, counts = hashes[:0], counts[:0]
    yield out()


def _known(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) of every word of all documents, by its hash.  Settled."""
    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_counted, "word long, n long")
    return settle(counted.groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    """Numbers and counts of words over all documents."""
    return _numbered(_known(docs, text))


def _numbered(known: DataFrame) -> Vocabulary:
    top = known.orderBy(F.desc("n"), "word").limit(WORDS).toArrow()
    hashes, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    # the low bits tell the bucket, also of numbers stored as signed
    bucket = F.col("word").bitwiseAND(F.lit(BUCKETS - 1))
    rest = known.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).toArrow().to_pydict()
    counts = np.zeros(PAD)
    counts[: len(n)] = n
    for b, m in zip(rest["b"], rest["n"], strict=True):
        counts[WORDS + b] = m
    np.subtract.at(counts, WORDS + (hashes % np.uint64(BUCKETS)).astype(np.int64), n)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order, counts)


_IDS = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("rare", T.ArrayType(T.LongType()))])


def _turned(words: Vocabulary):
    @F.arrow_udf(_IDS)
    def turned(column: pa.Array) -> pa.Array:
        """Numbers of the words of each text, two bytes each, and hashes of those in buckets."""
        ids, rare, ends, rare_ends = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for data, bounds in texts.chunks(column):
            hashes, first = _word_hashes(data, bounds)
            number = words.ids(hashes)
            low = number >= WORDS
            ids.append(number.astype(np.uint16))
            rare.append(hashes[low].view(np.int64))
            ends.append(ends[-1][-1] + first[1:])
            rare_ends.append(rare_ends[-1][-1] + np.concatenate(([0], np.cumsum(low)))[first[1:]])
        ids, rare = np.concatenate(ids), np.concatenate(rare)
        packed = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer((np.concatenate(ends) * 2).astype(np.int32)), pa.py_buffer(ids)])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(rare_ends), pa.int32()), pa.array(rare))
        return pa.StructArray.from_arrays([packed, lists], names=["ids", "rare"])

    return turned


def _ids(words: Vocabulary, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, words before each text) of texts, or of texts that are numbers already, for runs of texts."""
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        for data, bounds in texts.chunks(column):
            hashes, first = _word_hashes(data, bounds)
            yield words.ids(hashes), first
        return
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) // 2 if len(column) else np.zeros(1, np.int64)
    numbers = np.frombuffer(data, np.uint16, bounds[-1]) if bounds[-1] else np.zeros(0, np.uint16)
    low = 0
    while low < len(column):
        high = max(int(np.searchsorted(bounds, bounds[low] + _RUN, "right")) - 1, low + 1)
        yield numbers[bounds[low] : bounds[high]].astype(np.int64), bounds[low : high + 1] - bounds[low]
        low = high


def _trained(words: Vocabulary, network: Network, round_no: int, rounds: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = network.like(network.flat())
        squares = network.like(np.zeros(len(network.flat())))
        held, total = [], 0
        for batch in batches:
            for ids, first in _ids(words, batch.column(0)):
                # the share of a position depends on its text alone, not on where the text lies
                inside = np.arange(len(ids)) + np.repeat(np.diff(first) - first[:-1], np.diff(first))
                mine = np.flatnonzero(inside % rounds == round_no)
                held.append((contexts(ids, first, mine), ids[mine]))
                if sum(len(h[1]) for h in held) < 8 * BATCH:
                    continue
                total += _steps(own, squares, held)
                held = []
        total += _steps(own, squares, held)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([own.flat()], pa.list_(pa.float32()))], names=["weight", "values"])

    return train


def _steps(own: Network, squares: Network, held: list) -> int:
    if not held:
        return 0
    around, ids = np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held])
    order = np.random.default_rng(len(ids)).permutation(len(ids))
    for low in range(0, len(ids), BATCH):
        pick = order[low : low + BATCH]
        own.learn(around[:, pick], ids[pick], squares)
    return len(ids)


def train(docs: DataFrame, words: Vocabulary, text: str = "text", rounds: int = ROUNDS, seed: int = 0) -> Network:
    return _learnt(docs.select(F.col(text).cast("string").alias("text")), words, rounds, seed)


def _learnt(source: DataFrame, words: Vocabulary, rounds: int, seed: int) -> Network:
    """Parameters learnt from one column, of texts or of their numbers."""
    network = Network.fresh(words.counts, seed)
    for round_no in range(rounds):
        parts = settle(source.mapInArrow(_trained(words, network, round_no, rounds), "weight long, values array<float>"))
        each = parts.select("weight", F.posexplode("values").alias("place", "value"))
        mean = each.groupBy("place").agg((F.sum(F.col("weight") * F.col("value").cast("double")) / F.sum("weight")).alias("value"))
        found = mean.toArrow()  # as many rows as the network has parameters
        if not len(found):
            break
        flat = np.zeros(len(found))
        flat[found["place"].to_numpy()] = found["value"].to_numpy()
        network = network.like(flat)
    return network


def _scores(words: Vocabulary, network: Network):
    """Words of a text, and their summed log-probabilities but for the occurrences of words in buckets, see ``_told_apart``."""
    among = np.zeros(PAD)
    among[WORDS:] = np.log(np.maximum(words.counts[WORDS:], 1))

    @F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())]))
    def score(column: pa.Array) -> pa.Array:
        counts, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for ids, first in _ids(words, column):
            each = network.log_probabilities(contexts(ids, first), ids) - among[ids]
            running = np.concatenate(([0.0], np.cumsum(each)))
            counts.append(np.diff(first))
            sums.append(running[first[1:]] - running[first[:-1]])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts)), pa.array(np.concatenate(sums))], names=["n_words", "score"])

    return score


def _told_apart(numbered: DataFrame, known: DataFrame) -> DataFrame:
    """(row, told): summed logarithms of the occurrences of a text's words that are in buckets.

    No such word is hot: WORDS others occur no less often.  One that occurs once adds nothing.
    """
    rare = numbered.select("row", F.explode("rare").alias("word"))
    often = known.filter(F.col("n") > 1).select("word", F.log(F.col("n").cast("double")).alias("log_n"))
    # long as the table of words is, each of its parts is short beside that of the documents, which need not be sorted then
    return rare.join(often.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum("log_n").alias("told"))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """One row per document: key, n_words, score (summed log-probability), mean_score (per word)."""
    small_batches(docs.sparkSession)
    known = _known(docs, text)
    words = _numbered(known)
    turned = docs.select(F.col(key).alias("key"), _turned(words)(F.col(text).cast("string")).alias("t"))
    numbered = settle(turned.select("key", F.monotonically_increasing_id().alias("row"), "t.ids", "t.rare"))
    network = _learnt(numbered.select("ids"), words, rounds, seed)
    scored = numbered.select("key", "row", _scores(words, network)(F.col("ids")).alias("s"))
    whole = scored.join(_told_apart(numbered, known), "row", "left")
    n, score = F.col("s.n_words"), F.col("s.score") + F.coalesce("told", F.lit(0.0))
    return whole.select(F.col("key").alias(key), n.alias("n_words"), score.alias("score"), F.when(n > 0, score / n).alias("mean_score"))
