"""The prefix trie against a plain trie."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from sandboxlake.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, path string, words string, shard int, family long"


def plain_digest(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), plain_digest(role, text), (role or "", text or "")))
    turns = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        own_saved = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += own_saved
    return sorted(
        (min(members[n]), len(n), min(members[n[:-1]]) if n else -1, len(members[n]), len(children[n]), leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n in members
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, rows, shards):
    frame = spark.createDataFrame([(*r, "p", "w", 3, 4) for r in rows], SCHEMA)
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt(frame), shards).select(COLUMNS)
    return sorted(tuple(-1 if v is None else v for v in r) for r in found.collect())


@pytest.mark.parametrize(("shards", "words"), [(1, 2), (3, 2), (7, 1), (5, 9)])
def test_trie(spark, shards, words):
    """A third are copies of one conversation; few distinct turns, so that nodes span shards."""
    rng = random.Random(shards)
    rows = []
    for c in range(0, 400):
        if c % 3 == 0:
            rows += [(c, t, "user", "same  words here") for t in range(5)]
        else:
            rows += [(c, t, rng.choice(["user", "bot"]), "a\tb " * rng.randrange(words)) for t in range(rng.randrange(1, 7))]
    assert trie_of(spark, rows, shards) == plain_trie(rows)


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_TEXT", 3)
    rows = [
        (None, 1, "user", "no conversation"), (None, None, None, None), (1, None, None, None), (1, 2, "user", ""), (1, 2, "user", ""), (1, 2, "", "user"),
        (2, None, None, None), (20, 0, "x", "1:2"), (21, 0, "x1", ":2"), (22, 5, "x", "long " * 5000), (24, 1, "x", "一 二 é"), (44, 1, "x", "一 二 é"),
        (35, 0, "a", "b"), (35, 0, "b", "a"), (35, 0, "a", "c"), (5, 9, None, "q"),
    ]
    rows += [(c, t, "x", f"{t}") for c in (100, 101, 119) for t in range(300)]
    for shards in (1, 4):
        assert trie_of(spark, rows, shards) == plain_trie(rows)
    assert trie_of(spark, [], 2) == []


def test_skeleton_is_bounded(spark, monkeypatch):
    """Long conversations do not become splitters; the result is the same."""
    monkeypatch.setattr(prefix_trie, "SKELETON_NODES", 8)
    rows = [(c, t, "x", f"{c % 3} {t}") for c in range(60) for t in range(1 + c % 9)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    splitters = prefix_trie.choose_splitters(prefix_trie.rebuilt(frame), 4)
    assert len(prefix_trie.Skeleton(splitters).parent) <= 9
    assert trie_of(spark, rows, 4) == plain_trie(rows)
