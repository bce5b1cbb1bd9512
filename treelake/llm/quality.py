"""Quality rules: word statistics, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and word pairs are hashed into BUCKETS bins. One pass over all documents counts the bins of the raw corpus and, for
a bounded set of trusted documents (TRUSTED ids of label 1, the smallest by hash), those of the target. A document's
score is the mean over its n-grams of log(target share / raw share), both with additive smoothing, hence normalised for
length. Documents under THRESHOLD are rejected, each by itself and the same way at every size of corpus.

Null texts have no words and fail the base rules. Repeated rows get equal results. With no trusted document every score
is 0 and only the base rules decide. Extra columns are kept by ``keep_good``.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_chunks, text_or_empty

BUCKETS = 1 << 15
TRUSTED = 20_000
SMOOTH = 0.5
THRESHOLD = -0.15
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MEMO = 100_000

_memo: dict[str, int] = {}


def grams(words: list[str]) -> np.ndarray:
    """Bins of all words and of all pairs of neighbours."""
    if len(_memo) > MEMO:
        _memo.clear()
    try:
        single = np.array(list(map(_memo.__getitem__, words)), np.uint64)
    except KeyError:
        for w in words:
            if w not in _memo:
                _memo[w] = zlib.crc32(w.encode())
        single = np.array(list(map(_memo.__getitem__, words)), np.uint64)
    pairs = single[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate([single * np.uint64(0xD6E8FEB86659FD93), pairs])
    return (both >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    again = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= again
    return int(covered.sum())


def statistics(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """At most TRUSTED doc_ids of label 1, the smallest by hash."""
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The weight of each bin: log of target share over raw share. Counts cover all documents; BUCKETS sums come back."""
    trusted = F.broadcast(trusted_ids(labels).withColumn("trusted", F.lit(True)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(trusted, "doc_id", "left")
    columns = ["trusted", "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for flags, texts in row_chunks(batch, columns):
                bins = [grams(WORDS.findall(t)) for t in texts]
                raw += np.bincount(np.concatenate(bins), minlength=BUCKETS)
                if any(flags):
                    target += np.bincount(np.concatenate([b for b, f in zip(bins, flags, strict=True) if f]), minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bin", "raw", "target"])

    sums = rows.select(*columns).mapInArrow(run, "bin long, raw long, target long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in sums:
        raw[b], target[b] = r, t
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x: (x + SMOOTH) / (x.sum() + SMOOTH * BUCKETS)
    return np.log(share(target) / share(raw))


def measure(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The columns of docs (text last), then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score."""
    columns = [c for c in docs.columns if c != "text"] + ["text"]
    held = docs.sparkSession.sparkContext.broadcast(weights)
    fields = [docs.schema[c] for c in columns]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = held.value
        for batch in batches:
            start = 0
            for (texts,) in row_chunks(batch.select([len(columns) - 1]), ["text"]):
                part = batch.slice(start, len(texts))
                start += len(texts)
                stats, scores = [], []
                for t in texts:
                    words = WORDS.findall(t or "")
                    stats.append(statistics(t or "", words))
                    scores.append(round(float(weight[grams(words)].mean()), 9) if words else 0.0)
                made = [pa.array(x, pa.int64()) for x in zip(*stats, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made, pa.array(scores, pa.float64())], out)

    out = [f"c{i}" for i in range(len(columns))] + [f"m{i}" for i in range(6)]
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)) + "".join(f", m{i} long" for i in range(5)) + ", m5 double"
    made = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, schema)
    return made.toDF(*columns, *names, "score")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, score and kept of every row of docs."""
    weights = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = measure(rows, weights).drop("text").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= THRESHOLD)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    tag = uuid.uuid4().hex[:12]
    order = [c for c in docs.columns if c != "text"] + ["text"]
    free = {c: f"k{i}{tag}" if c != "text" else "text" for i, c in enumerate(order)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(free[c]) for c in order])
    kept = measure(renamed, fit(docs, labels)).filter(~base_failed() & (F.col("score") >= THRESHOLD))
    return kept.select(*[F.col(free[c]).alias(c) for c in docs.columns])
