"""Words, lines and shingles of whole texts, worked out on the bytes of an Arrow column inside a task.

A word is a maximal run of characters other than space and U+0009 to U+000D.  Those separators are
single bytes that occur in no longer UTF-8 sequence, so words can be found on bytes.  Work goes through
a column in chunks of whole texts (about a quarter of a megabyte), which bounds the memory of a task; only a single
text that is longer makes a longer chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
SHINGLE_WORDS = 5

U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_PLACES = mix(np.arange(1, SHINGLE_WORDS + 1, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES) + 1
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, U(base))
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[:] = tables
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by differences of one running polynomial sum."""
    powers, inverse = _power_tables(len(data))
    running = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data] * powers[: len(data)], out=running[1:])
    return mix((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(U))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, bounds of the texts in them) for runs of whole texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1, low + 1)
        yield whole[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
        low = high


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (one entry more than texts)."""
    white = _WHITE[data]
    full = bounds[1:] > bounds[:-1]
    before = np.ones(len(data), bool)
    before[1:] = white[:-1]
    before[bounds[:-1][full]] = True
    after = np.ones(len(data), bool)
    after[:-1] = white[1:]
    after[bounds[1:][full] - 1] = True
    starts = np.flatnonzero(~white & before)
    ends = np.flatnonzero(~white & after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def windows(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word windows, and for each text the number of windows before it."""
    many = np.maximum(np.diff(first) - (SHINGLE_WORDS - 1), 0)
    bounds = np.concatenate(([0], np.cumsum(many)))
    total = len(hashes) - SHINGLE_WORDS + 1
    if bounds[-1] == 0:
        return np.zeros(0, U), bounds
    sums = sum(hashes[k : total + k] * _PLACES[k] for k in range(SHINGLE_WORDS))
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], many)
    return mix(sums[at]), bounds


def sort_each(values: np.ndarray, bounds: np.ndarray) -> None:
    """Sort the part of each text in place."""
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if high - low > 1:
            values[low:high].sort()


def repeats(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """True where a sorted value equals the one before it in the same text."""
    same = np.zeros(len(values), bool)
    same[1:] = values[1:] == values[:-1]
    same[bounds[:-1][bounds[:-1] < len(values)]] = False
    return same


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of flags set in each text."""
    running = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return running[bounds[1:]] - running[bounds[:-1]]


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct five-word shingles of each text, and their bounds.

    Words are compared with A-Z in lower case.  A text of one to four words has its whole sequence as its
    only shingle; a text without words has none.
    """
    data = lower(data)
    starts, ends, first = words(data, bounds)
    hashes = span_hashes(data, starts, ends)
    grams, at = windows(hashes, first)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < SHINGLE_WORDS))
    if len(short):
        whole = np.zeros(len(short), U)
        for k in range(SHINGLE_WORDS - 1):
            has = count[short] > k
            whole[has] += hashes[first[short[has]] + k] * _PLACES[k]
        whole = mix(whole ^ count[short].astype(U))
        grams = np.insert(grams, at[short], whole)
        more = np.zeros(len(bounds), np.int64)
        more[short + 1] = 1
        at = at + np.cumsum(more)
    sort_each(grams, at)
    keep = ~repeats(grams, at)
    return grams[keep], np.concatenate(([0], np.cumsum(per_text(keep, at))))


def measures(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text: words, their code points, symbols, lines with a word, repeated lines, words in repeated windows."""
    starts, ends, first = words(data, bounds)
    n_words = np.diff(first)
    letters = ~_WHITE[data] & ((data & 0xC0) != 0x80)
    hashes = span_hashes(data, starts, ends)

    grams, at = windows(hashes, first)
    ordered = grams.copy()
    sort_each(ordered, at)
    again = repeats(ordered, at)
    steps = np.zeros(len(starts) + SHINGLE_WORDS, np.int64)
    for text in np.flatnonzero(per_text(again, at)).tolist():
        low, high = at[text], at[text + 1]
        twice = ordered[low:high][again[low:high]]
        found = np.searchsorted(twice, grams[low:high])
        found[found == len(twice)] = 0
        hits = np.flatnonzero(twice[found] == grams[low:high]) + first[text]
        steps[hits] += 1
        steps[hits + SHINGLE_WORDS] -= 1
    covered = np.cumsum(steps)[: len(starts)] > 0

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate((bounds[:-1], breaks + 1)), kind="stable")
    line_ends = np.sort(np.concatenate((breaks, bounds[1:])), kind="stable")
    text_of = np.repeat(np.arange(len(bounds) - 1), per_text(data == 10, bounds) + 1)
    spoken = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, text_of = line_starts[spoken], line_ends[spoken], text_of[spoken]
    lines = span_hashes(data, line_starts, line_ends)
    order = np.lexsort((lines, text_of))
    same = np.zeros(len(lines), bool)
    same[1:] = (lines[order][1:] == lines[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])

    n_texts = len(bounds) - 1
    return {
        "n_words": n_words,
        "word_chars": per_text(letters, bounds),
        "n_symbols": per_text(_SYMBOL[data], bounds),
        "n_lines": np.bincount(text_of, minlength=n_texts),
        "n_dup_lines": np.bincount(text_of[order][same], minlength=n_texts),
        "n_repeat_words": per_text(covered, first),
    }
