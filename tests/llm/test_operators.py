"""Every operator on a small table of hard cases, and the queries against SQL or brute force on the smallest tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sandboxlake.llm import (
    components, jaccard, line_dedup, lm_scoring, mixing, packing, probing, quality, sharding, surrogates, token_counts, tokens,
)
from sandboxlake.llm.queries import ORACLES, QUERIES
from test_texts import plain_measures, plain_shingles

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, _m string, size string"
LONG = " ".join(f"w{i % 700}x{i // 700}" for i in range(9000))
HARD = [
    (0, None, "en", "a", 1), (1, "", "en", "a", 1), (2, "one two three", "en", None, 1), (3, LONG, "en", "b", 1), (4, LONG, "en", "b", 1),
    (4, LONG, "en", "b", 1), (5, LONG + " end", None, "c", None), (None, "no id here at all", "de", "c", 1), (None, None, None, None, None),
    (6, "l1 a\nl2 b\nl3 c\nl4 d", "fr", "c", 1), (7, "q\nl1 a\nl2 b\nl3 c\nz", "fr", "a", 1), (8, "x\nx\nx\nx\nx", "fr", "a", 1),
    (9, "\n\n\n\n", "fr", "a", 1), (10, "\n\n\n\n", "fr", "a", 1), (11, "Mail BOB.x@Mail.example.com or bob.x@mail.example.com now", "en", "a", 1),
    (12, "一 二 三 四 五 六 七 八 九 十 é ß", "zh", "é", 1),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*r, 1, "s", "m", "z") for r in HARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(r)) for r in df.select(*columns).collect())
    want = Counter(repr(r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())
    assert got == want


def check_shards(placed, n, shards):
    slots = defaultdict(list)
    for r in placed:
        slots[r["_shard"] if "_shard" in r else r["shard"]].append(int(r["_slot"] if "_slot" in r else r["slot"]))
    assert sorted(map(len, slots.values())) == sorted(x for x in [n // shards + (s < n % shards) for s in range(shards)] if x)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding(spark, hard, empty):
    for shards in (1, 3, 40):
        got = rows(sharding.shard(hard, shards))
        assert Counter((r["doc_id"], r["text"], r["slot"]) for r in got) == Counter((r[0], r[1], "s") for r in HARD)
        check_shards(got, len(HARD), shards)
    assert rows(sharding.shard(empty, 3)) == []
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(7)
    cut = rows(sharding.shard(docs, 6, rows_per_slice=10).select("doc_id", "shard", "slot"))
    check_shards(cut, 200, 6)
    again = rows(sharding.shard(docs, 6, seed=5).select("doc_id", "shard", "slot"))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in cut} != {r["doc_id"]: (r["shard"], r["slot"]) for r in again}


def test_sharding_query(spark, duck):
    got = rows(QUERIES["op1_hypergeometric_sharding"](spark, FOLDER))
    check_shards(got, 200, 40)
    text = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)


@pytest.mark.parametrize(("good", "bad", "draws"), [(5, 7, 4), (1, 30, 20), (40, 0, 7), (0, 9, 3), (6, 6, 12)])
def test_hypergeometric_draws(spark, good, bad, draws):
    n = 20000
    columns = [F.lit(x).cast("long") for x in (good, bad, draws)]
    drawn = spark.range(n).select(sharding.hypergeometric(sharding._uniform(3, F.col("id")), *columns).alias("x")).groupBy("x").count()
    for r in drawn.collect():
        p = math.comb(good, r["x"]) * math.comb(bad, draws - r["x"]) / math.comb(good + bad, draws)
        assert abs(r["count"] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def check_packed(packed, texts_by_key, capacity=1024):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity
    for key, text in texts_by_key.items():
        ids = [*tokens.encode_whole(text or "").tolist(), 2]
        own = sorted(pieces[key], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == capacity for r in own[1:])
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            if r.get("ids") is not None:
                assert r["ids"] == part.tolist()
    assert len(bins) <= 1.02 * sum(r["length"] for r in packed) / capacity + 2


def test_packing(spark, hard, empty, duck):
    unique = hard.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    packed = packing.pack(unique, with_ids=True)
    check_packed(rows(packed), {r[0]: r[1] for r in HARD if r[0] is not None})
    sizes = [len(r["ids"]) for r in rows(packing.sequences(packed))]
    assert max(sizes) <= 1024
    assert sum(r["length"] for r in rows(packing.pack(hard))) == sum(len(tokens.encode_whole(r[1] or "")) + 1 for r in HARD)
    assert rows(packing.pack(empty)) == []
    check_packed(rows(QUERIES["op2_best_fit_packing"](spark, FOLDER)), dict(duck.sql("SELECT doc_id, text FROM documents").fetchall()))


def plain_components(texts_by_key):
    sets = {k: plain_shingles(t) for k, t in texts_by_key.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(k, len(sets[k]), find(k)) for k in sets}


def test_jaccard_join(spark, hard, empty, duck):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(jaccard.near_duplicates(hard.filter("doc_id IS NOT NULL")))}
    assert got == plain_components({r[0]: r[1] for r in HARD if r[0] is not None})
    nameless = rows(jaccard.near_duplicates(hard).filter("doc_id IS NULL"))
    assert [r["component_id"] for r in nameless] == [None, None]
    assert rows(jaccard.near_duplicates(empty)) == []
    kept = rows(jaccard.drop_near_duplicates(hard))
    assert Counter(r["doc_id"] for r in kept) == Counter([0, 1, 2, 3, None, None, 6, 7, 8, 9, 10, 11, 12])
    assert jaccard.drop_near_duplicates(hard).columns == hard.columns
    assert rows(jaccard.drop_near_duplicates(empty)) == []
    found = {tuple(r) for r in QUERIES["op8_ngram_jaccard_join"](spark, FOLDER).collect()}
    assert found == plain_components(dict(duck.sql("SELECT doc_id, text FROM documents").fetchall()))


def test_jaccard_join_of_chains_and_hot_passages(spark):
    """Chains link ends that do not link, and unlike texts that share a long passage stay apart."""
    passage = " ".join(f"p{i}" for i in range(40))
    data = [(i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 100))) for i in range(30)]
    data += [(100 + i, passage + " " + " ".join(f"u{i}x{j}" for j in range(60))) for i in range(40)]
    data += [(200 + i, f"z{i} " + " ".join(f"s{j}" for j in range(80)) + f" y{i}") for i in range(40)]
    got = {tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == plain_components(dict(data))
    assert len({c for d, _, c in got if d < 100}) == 1


def test_components(spark):
    links = [(1, 2), (2, 1), (2, 3), (5, 5), (7, 6), (8, 7), (3, 9)] + [(i, i + 1) for i in range(20, 60)]
    got = {tuple(r) for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(n, 1) for n in (1, 2, 3, 9)} | {(n, 6) for n in (6, 7, 8)} | {(n, 20) for n in range(20, 61)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(spark, hard, empty, duck):
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    got = rows(quality.quality_verdicts(hard, ["doc_id", "text"]))
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r[0], *plain_measures(r[1])) for r in HARD)
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)
    assert not any(r["kept"] for r in got if r["base_failed"])
    kept = quality.quality_filter(hard)
    assert kept.columns == hard.columns
    assert Counter(r["doc_id"] for r in rows(kept)) == Counter(r["doc_id"] for r in got if r["kept"])
    assert rows(quality.quality_verdicts(empty, ["doc_id"])) == rows(quality.quality_filter(empty)) == []
    found = {r["doc_id"]: tuple(r[n] for n in names) for r in rows(QUERIES["op9_host_quality_rules"](spark, FOLDER))}
    assert found == {k: plain_measures(t) for k, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


def test_hosts_that_fail_are_rejected(spark):
    good = "a plain text of more than ten words that says this and that and more"
    bad = "# $ % & | < > words # $ % and symbols ** in every line of it here"
    data = [(i, f"{good} {i} {h}", f"good{h}") for h in range(6) for i in range(30)] + [(1000 + i, f"{bad} {i}", "bad") for i in range(60)]
    data += [(2000, f"{bad} once", "good1"), (2001, f"{good} twice", "bad"), (2002, f"{bad} nowhere", None)]
    got = {r["doc_id"]: r["kept"] for r in rows(quality.quality_verdicts(spark.createDataFrame(data, "doc_id long, text string, source string"), ["doc_id"]))}
    assert all(got[i] for i in (0, 29, 2000, 2002))
    assert not any(got[i] for i in (1000, 1059, 2001))


def test_mixing(spark, hard, empty):
    got, names = mixing.with_copies(hard)
    taken = rows(got)
    assert len(taken) == len(HARD)
    assert names["size"] == "_size"
    words = {id(r): len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for r in HARD}
    total = defaultdict(int)
    for r in HARD:
        total[r[3]] += words[id(r)]
    assert {(r["source"], r["source_size"]) for r in taken} == set(total.items())
    assert all(r["target"] <= 3 * r["source_size"] and r["copies"] <= 3 for r in taken)
    assert mixing.mix(hard).columns == hard.columns
    assert mixing.mix(hard).count() == sum(r["copies"] for r in taken)
    assert rows(mixing.mix(empty)) == []


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), ("d", 0), (None, 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in rows(mixing.targets(sizes, mixing.rotating_weights(sizes)))}
    assert got["a"] == 30 and got["c"] == 300 and got["d"] == 0
    assert math.isclose(sum(got.values()), 1610) and math.isclose(got["b"], got[None])


def test_line_dedup(hard, empty):
    got = rows(line_dedup.dedup_lines(hard, removed="gone"))
    by_id = {r["doc_id"]: (r["text"], r["gone"]) for r in got}
    assert by_id[6] == ("l1 a\nl2 b\nl3 c\nl4 d", 0)
    assert by_id[7] == ("q\nz", 3)
    assert by_id[8] == ("x", 4)
    assert by_id[9] == by_id[10] == ("\n\n\n\n", 0)
    assert by_id[0] == (None, 0) and by_id[1] == ("", 0)
    assert line_dedup.dedup_lines(hard).columns == hard.columns
    assert rows(line_dedup.dedup_lines(empty)) == []


def test_surrogates(spark, hard, empty):
    data = [
        (1, "Write to Und.34@mail7.example.com or und.34@MAIL7.example.com, not of.55@mail9.example.com."),
        (2, "und.34@mail7.example.com; call +1 (017) 555-7713 or +1 (017)-555-7713, at 97.51.17.173"),
        (3, "Card 4111 1111 1111 1111 and 4111-1111-1111-1111; token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""),
        (4, "Mrs. Smith met Mr Smith, and Mrs SMITH. Frau Maria Müller. Господин Иванов. No 12345 or 1.5 or 1999-2000."),
        (5, "clean text with 10 words and 3.14 and a@b, nothing else"), (6, None), (7, ""),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n"]) for r in rows(surrogates.replace_entities(docs, counted="n"))}
    assert [got[d][1] for d in range(1, 8)] == [3, 4, 3, 5, 0, 0, 0]
    assert got[5][0] == data[4][1] and got[6][0] is None and got[7][0] == ""
    for d, text in data[:4]:
        for kind, p in surrogates.PATTERNS.items():
            if kind != "name":
                assert not {m.lower() for m in re.findall(p, text)} & {m.lower() for m in re.findall(p, got[d][0])}
    mails = re.findall(surrogates.PATTERNS["email"], got[1][0])
    assert mails[0].lower() == mails[1].lower() != mails[2].lower()
    assert mails[0][0].isupper() and mails[0].lower() in got[2][0]
    assert re.search(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 \(\1\)-\2-\3, at \d+\.\d+\.\d+\.\d+$", got[2][0])
    cards = re.findall(r"4\d{3}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[3][0])
    digits = [int(c) for c in re.sub(r"\D", "", cards[0])]
    assert re.sub(r"\D", "", cards[0]) == re.sub(r"\D", "", cards[1])
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    names = re.match(r"Mrs\. (\S+) met Mr (\S+), and Mrs (\S+)\. Frau (\S+)a (\S+)\. Господин ([А-Яа-я]+)\. No 12345 or 1\.5 or 1999-2000\.", got[4][0])
    assert names and names[1].upper() == names[3] and names[1] != names[2] and names[1] != "Smith"
    other = {r["doc_id"]: r["text"] for r in rows(surrogates.replace_entities(docs, key="another"))}
    assert other[1] != got[1][0]
    treated = rows(surrogates.replace_entities(hard))
    assert len(treated) == len(HARD)
    assert surrogates.replace_entities(hard).columns == hard.columns
    assert rows(surrogates.replace_entities(empty)) == []


def test_surrogates_stay_distinct_in_a_small_space(spark):
    """Formats of which more than half occur: distinct, never an entity, and all still addresses of the same length."""
    entities = spark.createDataFrame([("email", f"{a}@{b}.c") for a in "abcdefghij0123" for b in "aeiouxyz"], "kind string, canon string")
    got = rows(surrogates.assign(entities))
    drawn = {r["surrogate"] for r in got}
    assert len(drawn) == len(got) == 14 * 8
    assert not drawn & {r["canon"] for r in got}
    assert all(re.fullmatch(r"[a-z0-9]@[a-z0-9]\.c", d) for d in drawn)


SPACES = {
    "name": [f"m/{a}{b}" for a in "aeioubcd" for b in "aeioubz"], "phone": [f"{i:03d}" for i in range(1000)],
    "card": [f"4{i:03d}" for i in range(1000)], "iban": [f"de{i:02d}" for i in range(100)], "secret": [f"{i:02x}" for i in range(256)],
    "email": [f"{a}{b}@a.c" for a in "aeiou" for b in "0123456789"], "ip": [f"10.0.{i}.7" for i in range(256)],
}


@pytest.mark.parametrize("wide", [False, True])
def test_permutation_of_whole_formats(spark, wide):
    """Every text of a format goes to a text of the same format, no two to one; other keys give other permutations."""
    df = spark.createDataFrame([(k, c) for k, v in SPACES.items() for c in v], "kind string, canon string")
    drawn = {key: defaultdict(dict) for key in "ab"}
    for key in drawn:
        for r in df.select("kind", "canon", surrogates.permuted(key, F.col("kind"), F.col("canon"), wide).alias("to")).collect():
            drawn[key][r["kind"]][r["canon"]] = r["to"]
    for kind, canons in SPACES.items():
        to = drawn["a"][kind]
        assert len(set(to.values())) == len(canons)
        assert to != drawn["b"][kind]
        if kind in ("phone", "card", "iban", "secret"):
            assert set(to.values()) == set(canons)

    def luhn(digits):
        return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10

    assert all((luhn(c) == 0) == (luhn(t) == 0) for c, t in drawn["a"]["card"].items())
    ends = "ao"
    assert all((c[-1] in ends) == (t[-1] in ends) and (c[-1] not in ends or c[-1] == t[-1]) for c, t in drawn["a"]["name"].items())
    assert all(re.fullmatch(r"\d+\.\d+\.\d+\.\d+", t) for t in drawn["a"]["ip"].values())


def test_mentions_of_one_entity_agree(spark):
    """Names without their form of address, shorter forms and numbers without country code follow the entity; other documents' words stay."""
    data = [
        (1, "Mr John Smith wrote. John Smith signed; Mr Smith left. SMITH, smith and Smithson. Call +1 (017) 555-7713 or (017) 555-7713."),
        (2, "John Smith and Paris are words here: John."), (3, "Dear Mrs Smith, Smith@mail.example.com wrote to Smith."),
    ]
    got = {r["doc_id"]: (r["text"], r["n"]) for r in rows(surrogates.replace_entities(spark.createDataFrame(data, "doc_id long, text string"), counted="n"))}
    text = got[1][0]
    m = re.fullmatch(r"Mr (\S+) (\S+) wrote\. \1 \2 signed; Mr \2 left\. (\S+), smith and Smithson\. Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \(\4\) \5-\6\.", text)
    assert m and m[3] == m[2].upper() and "John" not in text and "Smith " not in text and got[1][1] == 7
    assert got[2] == (data[1][1], 0)
    m = re.fullmatch(r"Dear Mrs (\S+), (\S+)@(\S+)\.com wrote to (\S+)\.", got[3][0])
    assert m and m[1] == m[4] != "Smith" and m[2] != "Smith" and got[3][1] == 3


def plain_nearest(data, queries, k=20):
    fine = {i: np.array(v, float) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries & fine.keys():
        scored = sorted((-float(fine[q] @ v), i) for i, v in fine.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_nearest_of_hard_vectors(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    data += [(1000 + i, [1.0] * 8) for i in range(50)] + [(2000, None), (2001, [0.0] * 8), (2020, [float("nan")] * 8), (2040, [1.0] * 7 + [None]), (None, [1.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in data]
    got = defaultdict(list)
    for r in sorted(rows(probing.nearest(df, F.col("vec_id") % 20 == 0)), key=lambda r: r["rank"]):
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = plain_nearest(data, {i for i, _ in data if i is not None and i % 20 == 0})
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    few = spark.createDataFrame(data[:5], "vec_id long, embedding array<double>")
    assert len(rows(probing.nearest(few, F.col("vec_id") == 0))) == 4
    assert rows(probing.nearest(few.filter("false"), F.col("vec_id") == 0)) == []


def test_nearest_of_rows_that_share_an_id(spark):
    """Each row is a candidate of its own, of a query with the same id too; equal rows tie."""
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (0, [0.5, 0.0]), (3, [-1.0, 1.0])]
    got = defaultdict(list)
    for r in rows(probing.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=4)):
        got[r["query_id"], r["rank"]].append((r["vec_id"], r["score"]))
    assert {rank: sorted(found) for (_, rank), found in got.items()} == {
        1: [(1, 1.0), (1, 2.0)], 2: [(1, 1.0), (1, 2.0)], 3: [(0, 0.5), (1, 1.0)], 4: [(0, 0.5), (1, 0.5)],
    }


def test_clustered_vectors_are_found_in_few_buckets(spark):
    """With cells as wide as clusters need, a query finds its neighbours among a small part of all rows."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    vectors = np.concatenate([c + rng.normal(scale=0.02, size=(50, 16)) for c in centres])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    data = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    hashing = probing.Hashing(16, 1.0, width=0.5)
    own = probing._bucket_keys(np.floor(hashing.scores(np.column_stack((vectors, np.zeros(len(vectors)))))))
    sizes = [Counter(own[:, t].tolist()) for t in range(own.shape[1])]
    probed = spark.createDataFrame(data[::100], "vec_id long, v array<double>").select(probing._probed_buckets(hashing, 8)("v").alias("b"))
    seen = [sum(sizes[t][b] for b in set(r["b"]) for t in range(len(sizes))) for r in probed.collect()]
    assert np.mean(seen) < 0.35 * len(vectors)
    got = defaultdict(set)
    for r in rows(probing.nearest(df, F.col("vec_id") % 100 == 0, width=0.5, probes=8)):
        got[r["query_id"]].add(r["vec_id"])
    want = plain_nearest(data, {i for i, _ in data if i % 100 == 0})
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_nearest_query(spark, duck):
    got = defaultdict(dict)
    for r in rows(QUERIES["op5_multiprobe_search"](spark, FOLDER)):
        got[r["query_id"]][r["vec_id"]] = r["score"]
    data = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    want = plain_nearest(data, {i for i, _ in data if i % 20 == 0})
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len(got[q].keys() & dict(want[q]).keys()) for q in want) >= 0.9 * 20 * len(want)
    for q, found in got.items():
        for i, score in found.items():
            assert math.isclose(score, dict(plain_nearest(data, {q}, 10**6)[q])[i], abs_tol=1e-12) if q < 60 else True


def test_token_counts(spark, hard, empty, duck):
    got = rows(QUERIES["op7_edit_aware_counts"](spark, FOLDER))
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in got:
        text = texts[r["doc_id"]]
        assert r["n_tokens"] == len(tokens.encode_whole(text))
        new = re.sub("[0-9]{6,}", "<NUM>", text, count=1)
        new = (new.split("\n", 1)[1] if "\n" in new else new) + "\nEND OF TEXT"
        assert r["n_tokens_after"] == len(tokens.encode_whole(new))
    assert sum(r["encoded_chars"] for r in got) < 0.5 * sum(map(len, texts.values()))
    trees = token_counts.with_trees(hard, "tree")
    counts = rows(trees.select("doc_id", "text", token_counts.n_tokens(F.col("tree")).alias("n")))
    assert all(r["n"] == len(tokens.encode_whole(r["text"] or "")) for r in counts)
    edits = F.when(F.col("doc_id") == 6, F.array(F.struct(F.lit(1).alias("start"), F.lit(5).alias("stop"), F.lit("new words").alias("text"))))
    changed = rows(token_counts.apply_edits(trees, edits, "tree", "new").select("doc_id", "text", "new"))
    for r in changed:
        want = "l" + "new words" + "l2 b\nl3 c\nl4 d" if r["doc_id"] == 6 else r["text"] or ""
        assert r["new"]["text"] == want
        assert r["new"]["counts"][1] == len(tokens.encode_whole(want))
    assert rows(token_counts.with_trees(empty, "tree")) == []


def test_lm_scores(spark, hard, empty):
    scored = rows(lm_scoring.score_documents(hard))
    assert Counter((r["doc_id"], r["n_words"]) for r in scored) == Counter((r[0], len(re.findall("[^\x20\x09-\x0d]+", r[1] or ""))) for r in HARD)
    assert all(r["score"] < 0 if r["n_words"] else (r["score"] == 0 and r["mean_score"] is None) for r in scored)
    assert rows(lm_scoring.score_documents(empty)) == []
    rng = np.random.default_rng(0)
    phrases = ["the cat sat on a mat", "we went to see my dog", "you can not have it all"]
    natural = [(i, " ".join(rng.choice(phrases, 60))) for i in range(300)]
    docs = spark.createDataFrame(natural, "doc_id long, text string")
    words = lm_scoring.vocabulary(docs)
    network = lm_scoring.train(docs, words)
    held_out = [" ".join(rng.choice(phrases, 60)) for _ in range(20)]
    shuffled = [" ".join(rng.permutation(t.split())) for t in held_out]
    more = spark.createDataFrame([(i, t) for i, t in enumerate(held_out + shuffled)], "doc_id long, text string")
    s = {r["doc_id"]: r["s"]["score"] / r["s"]["n_words"] for r in rows(more.select("doc_id", lm_scoring._scores(words, network)("text").alias("s")))}
    unigram = float(np.sum(words.counts / words.counts.sum() * np.log(np.maximum(words.counts, 1) / words.counts.sum())))
    assert np.mean([s[i] for i in range(20)]) > unigram + 0.3
    assert np.mean([s[i] for i in range(20)]) > np.mean([s[20 + i] for i in range(20)]) + 0.3


def test_pipeline(spark, duck):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "target_mixing", "best_fit_packing"]
    kept = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    plain = {k: t for k, t in duck.sql("SELECT doc_id, text FROM documents").fetchall() if (m := plain_measures(t))[0] >= 10 and 100 * m[5] <= 20 * m[0]}
    assert {r["doc_id"] for r in rows(kept)} == set(plain)
    cleaned = corpus_pipeline.three_line_dedup(spark, kept, FOLDER)
    seen, after = set(), {}
    for key in sorted(plain):
        lines, gone = plain[key].split("\n"), set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if window in seen:
                gone |= {i, i + 1, i + 2}
            elif re.search("[^\x20\x09-\x0d]", "".join(window)):
                seen.add(window)
        after[key] = "\n".join(line for i, line in enumerate(lines) if i not in gone)
    assert {r["doc_id"]: r["text"] for r in rows(cleaned)} == after
    single = corpus_pipeline.ngram_jaccard_join(spark, cleaned, FOLDER)
    first = {k for k, n, c in plain_components(after) if k == c}
    assert {r["doc_id"] for r in rows(single)} == first
    mixed = corpus_pipeline.target_mixing(spark, single, FOLDER)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in rows(mixed))
    packed = corpus_pipeline.run(spark, FOLDER)
    assert Counter(r["doc_id"] for r in rows(packed.filter("piece = 0"))) == copies


def test_model_learns_from_every_position(frame):
    texts = ["a b c d e f g", "a", "b a", None, "", " ".join(f"w{i % 37}" for i in range(1000))]
    docs = frame("doc_id long, text string", *enumerate(texts))
    words = lm_scoring.vocabulary(docs)
    network = lm_scoring.Network.fresh(words.counts, 0)
    batch = docs.select("text").toArrow().to_batches()
    learnt = sum(
        part["weight"][0].as_py()
        for number in range(lm_scoring.ROUNDS) for part in lm_scoring._trained(words, network, number, lm_scoring.ROUNDS)(iter(batch))
    )
    assert learnt == sum(len((text or "").split()) for text in texts)


def test_two_levels_of_shares_against_one_by_one():
    rng = np.random.default_rng(1)
    network = lm_scoring.Network.fresh(rng.integers(0, 1000, lm_scoring.PAD), 0)
    network = network.like((network.flat() * 3).astype(np.float32))
    ids = np.sort(rng.integers(0, lm_scoring.PAD, 300))
    around = rng.integers(0, lm_scoring.PAD + 1, (len(lm_scoring.SIDES), 300))
    got = network.log_probabilities(around, ids)
    h = network.hidden(around).astype(float)

    def share(logits):
        return np.exp(logits) / np.exp(logits).sum()

    for i, number in enumerate(ids):
        g, m = divmod(number, lm_scoring.MEMBERS)
        whole = share(h[i] @ network.group_out + network.group_prior)[g] * share(h[i] @ network.out[g] + network.prior[g])[m]
        assert abs(np.log(whole) - got[i]) < 1e-4
    everything = np.arange(lm_scoring.PAD)
    assert abs(np.exp(network.log_probabilities(np.repeat(around[:, :1], lm_scoring.PAD, axis=1), everything)).sum() - 1) < 1e-5

    steps, _ = network.steps(around, ids)
    for name, step in steps.items():
        part = getattr(network, name).reshape(-1)  # a view
        for at in rng.integers(0, part.size, 5):
            kept, losses = part[at], []
            for moved in (0.02, -0.02):
                part[at] = kept + np.float32(moved)
                losses.append(-network.log_probabilities(around, ids).mean())
            part[at] = kept
            assert abs((losses[0] - losses[1]) / 0.04 - step.reshape(-1)[at]) < 2e-4
    # an output that is far off stays a number
    network.group_prior[3] = 500
    network.prior[3, 1] = -500
    assert np.isfinite(network.log_probabilities(around, ids)).all()


def test_contexts_of_some_words():
    rng = np.random.default_rng(3)
    for sizes in ([], [0], [1], [0, 3, 0, 0, 2, 1, 7], [40, 0, 5]):
        first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        ids = rng.integers(0, lm_scoring.PAD, first[-1])
        want = [
            [ids[i + side] if a <= i + side < b else lm_scoring.PAD for a, b in zip(first, first[1:]) for i in range(a, b)] for side in lm_scoring.SIDES
        ]
        some = np.flatnonzero(rng.random(len(ids)) < 0.5)
        assert lm_scoring.contexts(ids, first).tolist() == want
        assert lm_scoring.contexts(ids, first, some).tolist() == [[row[i] for i in some] for row in want]


def test_every_word_of_a_bucket_is_told_apart(spark, frame):
    """Scores against the three levels one by one, and shares of all words of the corpus that add up to one."""
    own = [f"own{i}" for i in range(lm_scoring.WORDS)]
    rare = [w for i in range(600) for w in [f"rare{i}"] * (1 + i % 3)]
    texts = [" ".join(own * 9), " ".join(rare), "rare5 own1 rare4 rare3", "RARE5", "", None, "rare5 own1 rare4 rare3"]
    docs = frame("doc_id long, text string", *[(i % 6, t) for i, t in enumerate(texts)]).repartition(3)
    counts = Counter(w for t in texts for w in (t or "").lower().split())
    words = lm_scoring.vocabulary(docs)
    network = lm_scoring.train(docs, words)

    def numbers(found):
        data = " ".join(found).encode()
        hashes, _ = lm_scoring._word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        return words.ids(hashes)

    number = dict(zip(counts, numbers(counts).tolist(), strict=True))
    inside = Counter()
    for word, n in counts.items():
        inside[number[word]] += n
    assert {number[w] for w in own} == set(range(lm_scoring.WORDS)) and max(Counter(number.values()).values()) > 1
    some = np.random.default_rng(2).integers(0, lm_scoring.PAD + 1, (len(lm_scoring.SIDES), 1))
    share = np.exp(network.log_probabilities(np.repeat(some, lm_scoring.PAD, axis=1), np.arange(lm_scoring.PAD)))
    assert abs(sum(share[number[w]] * counts[w] / inside[number[w]] for w in counts) - share[list(set(number.values()))].sum()) < 1e-6

    got = rows(lm_scoring.score_documents(docs))
    want = []
    for i, text in enumerate(texts):
        found = (text or "").lower().split()
        ids = np.array([number[w] for w in found], np.int64)
        around = lm_scoring.contexts(ids, np.array([0, len(ids)]))
        score = network.log_probabilities(around, ids).sum() + sum(np.log(counts[w] / inside[number[w]]) for w in found)
        want.append((i % 6, len(found), score))
    assert [(r["doc_id"], r["n_words"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["n_words"], r["score"]))] == [w[:2] for w in sorted(want)]
    for r, w in zip(sorted(got, key=lambda r: (r["doc_id"], r["n_words"], r["score"])), sorted(want), strict=True):
        assert abs(r["score"] - w[2]) < 1e-3 * max(1, abs(w[2]))


def test_numbers_of_texts_are_those_of_their_words(frame):
    texts = ["a b c A", None, "", "zz " * 50_000, "b"]
    docs = frame("doc_id long, text string", *enumerate(texts))
    words = lm_scoring.vocabulary(frame("doc_id long, text string", (1, " ".join(f"w{i} w{i}" for i in range(600)) + " a")))
    turned = docs.select("doc_id", lm_scoring._turned(words)("text").alias("t")).select("doc_id", "t.ids", "t.rare").orderBy("doc_id").toArrow()
    plain = [ids.tolist() for ids, first in lm_scoring._ids(words, docs.toArrow()["text"].combine_chunks()) for ids in np.split(ids, first[1:-1])]
    again = [ids.tolist() for ids, first in lm_scoring._ids(words, turned["ids"].combine_chunks()) for ids in np.split(ids, first[1:-1])]
    assert again == plain and [len(ids) for ids in plain] == [4, 0, 0, 50_000, 1]
    assert [len(r) for r in turned["rare"].to_pylist()] == [sum(n >= lm_scoring.WORDS for n in ids) for ids in plain]
