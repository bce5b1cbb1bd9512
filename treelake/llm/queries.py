"""The queries of this package, by name: functions of (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, jaccard, mixing, quality, secret_scan, sharding, suffix, topk, toxicity
from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_report(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op5_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digests(table(spark, sf_dir, "documents"))


def op8_tiled_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_every_hundredth(table(spark, sf_dir, "embeddings"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(rows.unionByName(control), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_ngram_jaccard, op3_source_mix, op4_histogram_shards, op5_string_kernel, op6_byte_bpe, op7_secret_ledger, op8_tiled_topk, op9_chat_format, op10_quality_llr)}

ORACLE_SQL = {
    "op2_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), g AS (
            SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS grams FROM w
        ), s AS (SELECT doc_id, len(grams) AS n FROM g),
        e AS (SELECT doc_id, unnest(grams) AS gram FROM g),
        c AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM e x JOIN e y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * both_ >= 85 * (p.n + q.n - both_)
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
        )
        SELECT s.doc_id, CAST(any_value(s.n) AS BIGINT) AS n_shingles, min(other) AS component_id FROM s JOIN reach ON s.doc_id = reach.doc_id GROUP BY s.doc_id
    """,
    "op8_tiled_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT * FROM r WHERE rank <= 10
    """,
    "op9_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), m AS (
            SELECT *, len(role) + len(text) + 23
                + len(regexp_extract_all(role, '[<\[]\\*(\|turn\|>|\|text\|>|\|end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)'))
                + len(regexp_extract_all(text, '[<\[]\\*(\|turn\|>|\|text\|>|\|end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)')) AS chars
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id
    """,
}
