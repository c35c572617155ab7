"""Every operator over a table that carries all the names it uses itself, with and without underscores, and one with a dot."""

import re
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from sandboxlake import llm
from sandboxlake.llm import jaccard, line_dedup, mixing, quality, secret_scan, sharding, surrogates, token_counts

OWN = ("doc_id", "text", "source")


def reserved():
    """All quoted words of the subpackage that could be names of columns."""
    words = set()
    for file in Path(llm.__file__).parent.glob("*.py"):
        words |= set(re.findall(r'"([a-z_][a-z_0-9]{0,15})"', file.read_text()))
    words -= set(OWN)
    return sorted(words | {f"_{w.lstrip('_')}" for w in words} | {f"__{w.lstrip('_')}" for w in words if len(w) < 6}) + ["a.b"]


TEXT = "l1 a\nl2 b\nl3 c\nl4 d\n" + " ".join(f"w{i}" for i in range(30))
ROWS = [(1, TEXT, "s"), (2, TEXT, "s"), (2, TEXT, "s"), (None, "Mail Bob.x@mail.example.com or +44 20 7946 0958", "t"), (4, None, None), (5, "", "t")]

OPERATORS = {
    "sharding": lambda d: sharding.shard(d, 3),
    "line_dedup": lambda d: line_dedup.dedup_lines(d, removed="n_removed_lines"),
    "mixing": mixing.mix,
    "jaccard_drop": jaccard.drop_near_duplicates,
    "jaccard": jaccard.near_duplicates,
    "quality": quality.quality_filter,
    "surrogates": surrogates.replace_entities,
    "secrets": secret_scan.secrets_by_row,
    "trees": lambda d: token_counts.with_trees(d, "n_tree_of_text"),
}


@pytest.fixture(scope="module")
def wide(spark):
    names = reserved()
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names)
    return spark.createDataFrame([(*r, *range(len(names))) for r in ROWS], schema)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names(spark, wide, name):
    """The result is that of the table without the extra columns, and these are passed on as they were."""
    plain = wide.select(*OWN)
    got, want = OPERATORS[name](wide), OPERATORS[name](plain)
    kept = [c for c in OWN if c in want.columns]
    if name != "sharding":
        assert Counter(tuple(r) for r in got.select(*kept).collect()) == Counter(tuple(r) for r in want.select(*kept).collect())
    passed = [c for c in wide.columns if c not in OWN]
    if set(passed) <= set(got.columns):
        row = got.select(*[f"`{c}`" for c in passed]).first()
        assert row is None or list(row) == list(range(len(passed)))


def test_stages_pass_extra_columns_on(spark, wide):
    docs = wide
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == wide.columns


def test_lines_of_a_very_long_text_are_removed_in_one_walk(spark):
    """Two equal texts of 200,000 lines: all but the first one's lines go."""
    text = "\n".join(f"line {i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "top\n" + text + "\nend")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n"]) for r in line_dedup.dedup_lines(docs, removed="n").collect()}
    assert got == {1: (text, 0), 2: ("top\nend", 200_000)}
