"""Near words against a plain comparison of all pairs, and the vocabulary against counting."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from sandboxlake.llm import spelling


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(counts):
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    out = {}
    for w, n in counts.items():
        near = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(size, []) if one_edit(w, v)]
        form = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (n, len(near), form if form and counts[form] >= 2 * n else None)
    rows = []
    for w, (n, n_near, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.append((w, n, n_near, form, counts.get(form), root))
    return sorted(rows, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_ranks(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, 3 + seed, 200)
    ranks = spelling.Ranks(text, 10)
    whole = [*text.tolist(), 0]
    assert ranks.order.tolist() == sorted(range(201), key=lambda i: whole[i:])
    for size in (1, 2, 3, 5):
        pattern = text[40 : 40 + size].tolist()
        low, high = np.array([0]), np.array([ranks.n])
        for c in reversed(pattern):
            low, high = ranks.extend(low, high, np.array([c]))
        assert sorted(ranks.order[low[0] : high[0]].tolist()) == [i for i in range(200) if whole[i : i + size] == pattern]


@pytest.mark.parametrize("most", [5000, 12, 1])
def test_near_words(spark, most):
    """Few letters, so that there are many pairs; a small bound on the groups makes them be filed anew, down to single places."""
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))) for _ in range(700)}
    words |= {"prefixprefix" + "".join(rng.choice("xyz") for _ in range(4)) for _ in range(80)} | {c + "quite" for c in "abcdefgh"} | {"q", "qu"}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = Counter(tuple(r) for r in spelling.near_words(frame, most, 300).collect())
    assert got == Counter((a, b) for a in words for b in words if one_edit(a, b))
    sizes = spelling.small_groups(frame, most).filter("longer - head - tail > 1").groupBy("group").count().agg({"count": "max"}).first()[0]
    assert sizes is None or sizes <= most


def test_variants(spark):
    rng = random.Random(1)
    base = ["receive", "separate", "straße", "definitely", "Éclair", "aaaaa", "aaaaaa", "aaaaaaa", "bbbbb"]
    texts = []
    for i in range(300):
        line = []
        for w in base:
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("xé") + w[at + 1 :], w[:at] + "o" + w[at:]])
            line.append(rng.choice([w, w.upper() if w.isascii() else w, w.capitalize()]))
        texts.append((i, rng.choice([" ", "-", "1"]).join(line)))
    texts += [(None, "receive receive"), (None, None), (7, ""), (8, "abcd " * 50), (9, "z" * 30000), (9, "z" * 30000), (9, "z" * 30000), (10, "z" * 29999 + " "), (10, "z" * 29999 + " "), (11, "z" * 29999)]
    frame = spark.createDataFrame([(*t, "w", 1) for t in texts], "doc_id long, text string, word string, n int").repartition(5)
    counts = plain_words(texts)
    assert len(counts) > 50
    assert {r["word"]: r["n"] for r in spelling.vocabulary(frame).collect()} == counts
    assert found(spelling.variants(spelling.vocabulary(frame))) == plain_variants(counts)


def test_chains_and_ties(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "zzzzz": 3, "zzzzy": 6, "zzzyz": 6, "lonely": 9}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(frame)) == plain_variants(counts)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert found(spelling.variants(spelling.vocabulary(empty))) == []
