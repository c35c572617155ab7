"""Words, shingles, counts and token ids on bytes, against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sandboxlake.llm import packing, texts, token_counts, tokens

WORD = re.compile("[^\x20\x09-\x0d]+")
CASES = [
    "", None, "a", "\n", "   ", "a b c d", "a b c d e", "a b c d e f", "A b\tC d e\nf g",
    "x y z v w x y z v w", "one\n\none\n \none two", "é ß 你好     x", "<|endoftext|> a", "a <|endoftext|>", "a  b \n\n c",
    "tab\tx\n \n y", "it's 12345 #*$", "word " * 700, "  \n  q",
]
ALPHABET = st.text(st.sampled_from("ab A1é'\n\t   <|>endoftx#你"), max_size=60)


def plain_words(text):
    return WORD.findall(text or "")


def plain_shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in plain_words(text)]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_measures(text):
    words, text = plain_words(text), text or ""
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


def measured(rows, limit):
    out = []
    for data, bounds in texts.chunks(pa.array(rows, pa.string()), limit):
        m = texts.measures(data, bounds)
        out += list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")), strict=True))
    return out


def encoded(rows, limit=texts.CHUNK_BYTES):
    out = []
    for data, bounds in texts.chunks(pa.array(rows, pa.string()), limit):
        ids, at = tokens.encode(data, bounds)
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def test_cases_by_chunk_size():
    for limit in (1, 40, 1 << 20):
        assert measured(CASES, limit) == [plain_measures(t) for t in CASES]
        assert encoded(CASES, limit) == [tokens.encode_whole(t or "").tolist() for t in CASES]


def test_a_slice_of_a_column():
    whole = pa.array(CASES, pa.string())
    got = [d.tobytes() for data, b in texts.chunks(whole.slice(5, 6), 10) for d in np.split(data, b[1:-1])]
    assert got == [(t or "").encode() for t in CASES[5:11]]


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=5))
def test_any_texts(rows):
    assert measured(rows, 30) == [plain_measures(t) for t in rows]
    assert encoded(rows, 30) == [tokens.encode_whole(t).tolist() for t in rows]
    sets = [np.diff(texts.shingle_sets(d, b)[1]).tolist() for d, b in texts.chunks(pa.array(rows))]
    assert sum(sets, []) == [len(plain_shingles(t)) for t in rows]


def test_shared_shingles_agree_across_texts():
    rows = ["a b c d e f g", "x a b C D e f", "a b c", "A B c", "a b"]
    (data, bounds), = texts.chunks(pa.array(rows))
    sets, at = texts.shingle_sets(data, bounds)
    own = [set(sets[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            assert len(own[i] & own[j]) == len(plain_shingles(x) & plain_shingles(y))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=12))
def test_plans_place_everything(histogram):
    plan = packing.plan_bins(histogram, 40)
    placed = Counter()
    bins: dict[int, list[tuple[int, int]]] = {}
    for size, _, many, first, offset in plan.runs:
        placed[size] += many
        for b in range(first, first + many):
            bins.setdefault(b, []).append((offset, size))
    assert placed == Counter(histogram)
    assert sorted(bins) == list(range(plan.bins))
    for items in bins.values():
        assert sum(3 * size > 40 for _, size in items) <= 2
        end = 0
        for offset, size in sorted(items):
            assert offset == end
            end += size
        assert end <= 40
    assert plan.bins <= 1.25 * sum(s * n for s, n in histogram.items()) / 40 + sum(n for s, n in histogram.items() if 3 * s > 40) / 2 + 1


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab A1é\n  "), max_size=300), st.lists(st.tuples(st.integers(0, 320), st.integers(0, 320), ALPHABET), max_size=6))
def test_edits_of_a_tree(text, edits):
    (data, bounds), = texts.chunks(pa.array([text]))
    lengths, _, _ = token_counts._leaf_sizes(data, bounds)
    own = token_counts.EditedText(text, lengths[0])
    now = text
    for a, b, new in edits:
        a = min(a, len(now))
        b = min(max(b, a), len(now))
        now = now[:a] + new + now[b:]
        own.replace(a, b, new)
        assert "".join(own.leaves) == now
        assert own.lengths[1] == len(now)
    if not tokens._ODD.search(text + "".join(e[2] for e in edits)):
        assert sum(encoded(own.leaves), []) == tokens.encode_whole(now).tolist()
