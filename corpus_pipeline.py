"""A training corpus in five stages, from documents to token ids. Each stage reads what the one before it wrote.

All stages keep columns they don't know, whatever their names (the last returns its own five), take null texts as empty, texts
of any length whole, and give an empty table for an empty one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm import bpe, jaccard, mixing, quality, secret_scan
from treelake.llm.common import materialize, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; those without 50 words are none. Repeated rows stay or go together."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more, linked in chains) the least doc_id,
    one of repeated rows too; a null doc_id comes last. Documents without words are near nothing, so all stay."""
    return jaccard.keep_one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; a null text stays null."""
    return secret_scan.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, at most 3 times. Documents without words cost nothing: they go
    with their hash range. A null source is a source."""
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the hash of what they decode to; no ids for an empty text."""
    encoded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", one_of_near_copies),
    ("secret scans", without_secrets),
    ("mixing sources", mixed_sources),
    ("byte-level BPE", token_ids),
]

#: No SQL: BPE merges and the seeded mix are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
