"""Queries that apply each operator to its whole table, and SQL with the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sandboxlake.llm import (
    jaccard, line_dedup, lm_scoring, mixing, packing, prefix_trie, probing, quality, secret_scan, sharding, spelling, surrogates,
    token_counts,
)
from sandboxlake.llm.columns import text_crc32

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, table: str, oracle: str | None = None):
    def register(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(spark.read.parquet(f"{folder}/{table}.parquet"))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@_query("op2_best_fit_packing", "documents")
def op2(docs: DataFrame) -> DataFrame:
    return packing.pack(docs)


@_query("op9_host_quality_rules", "documents")
def op9(docs: DataFrame) -> DataFrame:
    return quality.quality_verdicts(docs, ["doc_id"])


@_query("op8_ngram_jaccard_join", "documents")
def op8(docs: DataFrame) -> DataFrame:
    return jaccard.near_duplicates(docs)


@_query("op1_hypergeometric_sharding", "documents")
def op1(docs: DataFrame) -> DataFrame:
    placed = sharding.shard(docs, shards=40)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    return placed.select(
        "doc_id", size.alias("size"), text_crc32(F.col("text")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@_query("op6_target_mixing", "documents", r"""
    WITH RECURSIVE sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
    ), sources AS (
        SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
        FROM sized GROUP BY source
    ), share(round, level, n_full) AS (
        SELECT 0, 0.0::DOUBLE, -1::BIGINT
        UNION ALL
        SELECT round + 1,
               (SELECT (sum(source_size) - 3 * coalesce(sum(source_size) FILTER (weight * level > source_size * 3.0::DOUBLE), 0))::DOUBLE
                       / sum(weight) FILTER (weight * level <= source_size * 3.0::DOUBLE)::DOUBLE FROM sources),
               (SELECT count(*) FILTER (weight * level > source_size * 3.0::DOUBLE) FROM sources)
        FROM share
        WHERE n_full <> (SELECT count(*) FILTER (weight * level > source_size * 3.0::DOUBLE) FROM sources)
    ), aims AS (
        SELECT source, source_size, least(source_size * 3.0::DOUBLE, weight * (SELECT level FROM share ORDER BY round DESC LIMIT 1)) AS target FROM sources
    ), rated AS (
        SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
               ('0x' || substr(md5('0/' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
        FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source
    )
    SELECT doc_id, size, source_size, target, (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken FROM rated
""")
def op6(docs: DataFrame) -> DataFrame:
    mixed, _ = mixing.with_copies(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@_query("op10_three_line_dedup", "documents", r"""
    WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
    starts AS (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM cut WHERE len(lines) >= 3),
    windows AS (SELECT doc_id, pos, lines[pos + 1 : pos + 3] AS w FROM starts),
    later AS (
        SELECT doc_id, pos FROM (SELECT doc_id, pos, w, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM windows
                                WHERE regexp_matches(array_to_string(w, chr(10)), '[^\x20\x09-\x0D]')) WHERE k > 1
    ), covered AS (SELECT doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) AS gone FROM later GROUP BY doc_id)
    SELECT cut.doc_id, coalesce(len(gone), 0)::BIGINT AS removed_lines,
           CASE WHEN gone IS NULL THEN text
                ELSE array_to_string([lines[i + 1] FOR i IN range(0, len(lines)) IF NOT list_contains(gone, i)], chr(10)) END AS text
    FROM cut LEFT JOIN covered USING (doc_id)
""")
def op10(docs: DataFrame) -> DataFrame:
    return line_dedup.dedup_lines(docs.select("doc_id", "text"), removed="removed_lines")


@_query("op3_masked_pseudo_likelihood", "documents")
def op3(docs: DataFrame) -> DataFrame:
    return lm_scoring.score_documents(docs)


@_query("op4_surrogate_generation", "documents")
def op4(docs: DataFrame) -> DataFrame:
    return surrogates.replace_entities(docs.select("doc_id", "text"), counted="n_mentions")


@_query("op5_multiprobe_search", "embeddings")
def op5(vectors: DataFrame) -> DataFrame:
    return probing.nearest(vectors, F.col("vec_id") % 20 == 0)


@_query("op7_edit_aware_counts", "documents")
def op7(docs: DataFrame) -> DataFrame:
    """Token counts of all documents, and their counts after a cleaning step has edited them."""
    trees = token_counts.with_trees(docs.select("doc_id", "text"), "tree")
    edits = token_counts.clean_up_edits(F.col("text"))
    changed = token_counts.apply_edits(trees, edits, "tree", "changed")
    return changed.select(
        "doc_id", token_counts.n_tokens(F.col("tree")).alias("n_tokens"), F.size(edits).cast("long").alias("n_edits"),
        token_counts.n_tokens(F.col("changed")).alias("n_tokens_after"), F.col("changed.encoded_chars").alias("encoded_chars"),
        text_crc32(F.col("changed.text")).alias("text_crc32_after"),
    )


@_query("op12_prefix_trie", "conversations", r"""
    WITH crc AS (  -- CRC-32 by its polynomial: a step takes in one byte, or shifts by one bit (-1)
        SELECT conv_id, xor(4294967295, list_reduce(
            [4294967295] || flatten([[ascii(d), -1, -1, -1, -1, -1, -1, -1, -1] FOR d IN string_split(conv_id::VARCHAR, '')]),
            lambda crc, step: CASE WHEN step >= 0 THEN xor(crc, step) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END
        )) % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
    ), turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
        FROM conversations WHERE conv_id IS NOT NULL
    ), whole AS (
        SELECT crc.conv_id, place, role, text FROM crc JOIN turns ON turns.conv_id = crc.conv_id - crc.conv_id % 20 WHERE place <= h
        UNION ALL SELECT crc.conv_id, place, role, text FROM crc JOIN turns USING (conv_id) WHERE place > h
    ), rebuilt AS (
        SELECT conv_id, row_number() OVER w AS depth, list(md5(length(role)::VARCHAR || ':' || role || text)) OVER w AS path,
               len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
        FROM whole WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
    ), prefixes AS (
        SELECT conv_id, depth, array_to_string(path, '') AS key, array_to_string(path[:-2], '') AS above, words FROM rebuilt
        UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM crc
    ), lengths AS (SELECT conv_id, max(depth) AS last FROM prefixes GROUP BY conv_id),
    nodes AS (
        SELECT key, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256
        FROM prefixes JOIN lengths USING (conv_id) GROUP BY key
    ), children AS (SELECT above AS key, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
    own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM nodes LEFT JOIN children USING (key)),
    below AS (
        SELECT p.key, sum((o.n_children = 0)::INT) AS n_leaves, sum(o.saved) AS saved_tokens
        FROM own o JOIN prefixes p ON p.conv_id = o.conv_id AND p.depth <= o.depth GROUP BY p.key
    )
    SELECT own.conv_id, own.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, own.n_convs::BIGINT AS n_convs, own.n_children::BIGINT AS n_children,
           n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, own.ends_sha256
    FROM own JOIN below USING (key) LEFT JOIN nodes up ON up.key = own.above
""")
def op12(conversations: DataFrame) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(conversations))


@_query("op11_randomness_battery", "documents")
def op11(docs: DataFrame) -> DataFrame:
    return secret_scan.secrets_by_row(docs.select("doc_id", "text"))


@_query("op13_spelling_variants", "documents", r"""
    WITH RECURSIVE runs AS (
        SELECT DISTINCT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{5,}')) AS run FROM documents
    ), hexed AS (SELECT doc_id, run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes FROM runs),
    hashed AS (  -- CRC-32 by its polynomial: a step takes in one byte, or shifts by one bit (-1)
        SELECT doc_id, run, xor(4294967295, list_reduce(
            [4294967295] || flatten([[('0x' || bytes[2 * i + 1 : 2 * i + 2])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(0, len(bytes) // 2)]),
            lambda crc, step: CASE WHEN step >= 0 THEN xor(crc, step) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END
        )) AS h FROM hexed
    ), named AS (
        SELECT doc_id, run, CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed
    ), every AS (
        SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{5,}')) AS run FROM documents
    ), words AS MATERIALIZED (
        SELECT word, count(*) AS n FROM every e JOIN named m ON m.doc_id IS NOT DISTINCT FROM e.doc_id AND m.run = e.run
        WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3
    ), cuts AS (SELECT word, i, word[: i - 1] || word[i + 1 :] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS MATERIALIZED (
        SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.rest = b.word
    ), ranked AS (
        SELECT near.word, near.near, o.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near,
               row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, near.near) AS place
        FROM near JOIN words o ON o.word = near.near
    ), formed AS MATERIALIZED (
        SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
        FROM words LEFT JOIN ranked ON ranked.word = words.word AND place = 1
    ), road AS (
        SELECT word, word AS root, form FROM formed
        UNION ALL SELECT road.word, formed.word, formed.form FROM road JOIN formed ON formed.word = road.form
    )
    SELECT word, n::BIGINT AS n, n_near::BIGINT AS n_near, formed.form, form_n::BIGINT AS form_n, root
    FROM formed JOIN (SELECT word, root FROM road WHERE form IS NULL) USING (word)
""")
def op13(docs: DataFrame) -> DataFrame:
    return spelling.variants(spelling.vocabulary(docs.select("doc_id", "text")))
