"""Token ids of whole texts, with each distinct stretch of a chunk encoded once.

A text is cut where a run of ASCII white space begins.  The splitting pattern of this vocabulary never
joins text across such a place, so the ids of a text are the ids of its stretches in a row.  About three
quarters of the stretches of a chunk repeat an earlier one.  Texts for which this does not hold (white
space beyond ASCII, the text of a special token) are encoded whole by the tokenizer itself.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa

from sandboxlake.llm import texts

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END_ID = 2  # closes a document
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]|<\\|endoftext\\|>")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LEADS = np.zeros(256, bool)  # first bytes that an odd text needs to have
_LEADS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, ord("|")]] = True


@functools.cache
def whole_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _ranked(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        sizes[rank] = len(piece)
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def encode_whole(text: str, tokenizer: str = TOKENIZER) -> np.ndarray:
    return np.array(whole_tokenizer(public_tokenizers.path(tokenizer)).encode(text, add_special_tokens=False).ids, np.int64)


def _odd_texts(data: np.ndarray, bounds: np.ndarray) -> list[int]:
    maybe = np.flatnonzero(texts.per_text(_LEADS[data], bounds))
    return [t for t in maybe.tolist() if _ODD.search(data[bounds[t] : bounds[t + 1]].tobytes().decode())]


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the stretches of all texts (each text that is not empty begins with one), and the first of each text."""
    space = _SPACE[data]
    opens = np.zeros(len(data), bool)
    opens[1:] = space[1:] & ~space[:-1]
    opens[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    starts = np.flatnonzero(opens)
    return starts, np.searchsorted(starts, bounds)


class Known:
    """Ids of the stretches that this process has met, by hash, up to a bounded number of them."""

    def __init__(self, ranks: str, most: int = 250_000):
        self.encoding, self.sizes = _ranked(ranks)
        self.most = most
        self.hashes = np.zeros(0, np.uint64)
        self.low = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.buffer, self.filled = np.zeros(1 << 16, np.uint16), 0

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] != hashes

    def add(self, hashes: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        while self.filled + len(ids) > len(self.buffer):
            self.buffer = np.concatenate((self.buffer, np.zeros_like(self.buffer)))
        self.buffer[self.filled : self.filled + len(ids)] = ids
        low = self.filled + np.concatenate(([0], np.cumsum(count)[:-1]))
        self.filled += len(ids)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.low, self.count = (np.insert(old, at, new) for old, new in ((self.hashes, hashes), (self.low, low), (self.count, count)))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        return self.low[at], self.count[at]

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given stretches in a row, and how many each has.

        One behind the other they are a text whose ids fall apart at their ends again; a stretch that
        opens a text may lack white space in front, so a line break parts it from the one before.
        """
        blank = _SPACE[data[starts]]
        lengths = ends - starts
        pad = (~blank).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths + pad)))
        at = np.arange(offsets[-1]) + np.repeat(starts - pad - offsets[:-1], lengths + pad)
        joined = data[np.maximum(at, 0)].copy()
        joined[offsets[:-1][~blank]] = 10
        ids = self.encoding.encode_to_numpy(joined.tobytes().decode(), disallowed_special=()).astype(np.int64)
        begins = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        low, high = np.searchsorted(begins, offsets[:-1] + pad), np.searchsorted(begins, offsets[1:])
        inside = np.ones(len(ids), bool)
        inside[np.searchsorted(begins, offsets[:-1][~blank])] = False
        return ids[inside], high - low


@functools.cache
def _known(ranks: str) -> list[Known]:
    return [Known(ranks)]


def encode(data: np.ndarray, bounds: np.ndarray, ranks: str = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a chunk, and their bounds."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    holder = _known(public_tokenizers.path(ranks))
    known = holder[0]
    starts, first = stretches(data, bounds)
    ends = np.append(starts[1:], len(data))
    hashes = texts.span_hashes(data, starts, ends)
    distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
    new = known.missing(distinct)
    if len(known.hashes) + np.count_nonzero(new) > known.most and len(known.hashes):
        known = holder[0] = Known(public_tokenizers.path(ranks))  # starts over, so that memory stays bounded
        new[:] = True
    if new.any():
        known.add(distinct[new], *known.encode(data, starts[example[new]], ends[example[new]]))
    low, count = known.look_up(distinct)

    counts = count[which]
    token_bounds = np.concatenate(([0], np.cumsum(counts)))
    flat = known.buffer[np.arange(token_bounds[-1]) + np.repeat(low[which] - token_bounds[:-1], counts)].astype(np.int64)
    text_bounds = token_bounds[first]
    odd = _odd_texts(data, bounds)
    if not odd:
        return flat, text_bounds
    parts = [flat[text_bounds[t] : text_bounds[t + 1]] for t in range(len(bounds) - 1)]
    for t in odd:
        parts[t] = encode_whole(data[bounds[t] : bounds[t + 1]].tobytes().decode())
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def encode_column(column: pa.Array):
    """(ids, bounds) of each chunk of a column in turn."""
    for data, bounds in texts.chunks(column):
        yield encode(data, bounds)
