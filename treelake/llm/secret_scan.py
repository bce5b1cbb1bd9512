"""Secret scans with an incremental blob ledger.

Every version of every text is content-addressed (SHA-256). Only blobs that the ledger does not hold for this version of
the rules are scanned, once each whatever the number of paths; findings are joined back from the ledger to all paths of a
blob. The ledger is a Parquet table (blob, rule_version, spans) in a shared folder that grows by one append a scan; clean
blobs are in it too. A necessary condition of any finding (a keyword or a run of hexadecimal digits) is tested on the JVM
first, so that only texts that may hold a finding are moved by address. A blob that is appended twice, after a job that
was repeated, counts once.

Null texts count as empty and have no findings. Repeated rows and equal texts share findings. Empty tables give empty
results. Very long texts are scanned whole. Extra columns of the input are kept by ``redact``; names it makes cannot clash.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, row_chunks, shared_dir, text_key, text_or_empty

RULE_VERSION = "2"
FLAGS = re.ASCII
#: kind, pattern, group whose length counts, least length; in the order in which kinds are listed.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", FLAGS | re.IGNORECASE), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+", FLAGS), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}", FLAGS), 0, 32),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", FLAGS), 0, 1),
    ("forge", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}", FLAGS), 0, 40),
)
KINDS = tuple(x[0] for x in RULES)
MASK = "[SECRET]"


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end (code points, end exclusive) by start, then kind as listed."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def may_hold_secret(text: Column) -> Column:
    """True for every text with a finding, and for few others."""
    low = F.lower(text)
    words = ("password", "passwd", "secret", "token", "apikey", "api_key")
    test = text.contains("AKIA") | text.contains("PRIVATE KEY-----") | text.rlike("gh[pousr]_") | text.rlike("[0-9a-f]{32}")
    for word in words:
        test = test | low.contains(word)
    return test


LEDGER = "blob string, rule_version string, spans array<struct<kind:string,start:bigint,stop:bigint>>"
NO_SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"


def new_ledger(spark: SparkSession) -> str:
    """The path of a ledger of its own in the shared folder."""
    return f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, ledger: str, rule_version: str) -> DataFrame:
    """blob, spans that the ledger holds for a version of the rules; a ledger that isn't there yet is made, empty."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == rule_version).select("blob", "spans")


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """blob, spans (array of kind, start, stop) for every row of blobs (blob, text); a null text has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
        for batch in batches:
            for keys, texts in row_chunks(batch, ["blob", "text"]):
                spans = [[{"kind": k, "start": a, "stop": b} for k, a, b in find_secrets(t or "")] for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(spans, pa.list_(kind))], ["blob", "spans"])

    return blobs.select("blob", "text").mapInArrow(run, f"blob string, spans {NO_SPANS}")


def unseen_blobs(docs: DataFrame, ledger: str, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """blob, text (null where it cannot hold a secret) of the distinct texts that the ledger lacks for these rules."""
    rows = docs.select(text_or_empty(text).alias("text")).select(text_key(F.col("text")).alias("blob"), F.when(may_hold_secret(F.col("text")), F.col("text")).alias("text"))
    # Equal texts become one in each task before they move.
    blobs = rows.groupBy("blob").agg(F.first("text", ignorenulls=True).alias("text"))
    return blobs.join(read_ledger(docs.sparkSession, ledger, rule_version).select("blob"), "blob", "left_anti")


def update_ledger(docs: DataFrame, ledger: str, text: str = "text", rule_version: str = RULE_VERSION) -> None:
    """Scans the unseen blobs of docs and appends them to the ledger."""
    found = scan_blobs(unseen_blobs(docs, ledger, text, rule_version))
    found.select("blob", F.lit(rule_version).alias("rule_version"), "spans").write.mode("append").parquet(ledger)


def found_spans(spark: SparkSession, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """blob, spans of the blobs with a secret, by the ledger."""
    return read_ledger(spark, ledger, rule_version).filter(F.size("spans") > 0).dropDuplicates(["blob"])


def of_paths(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, spans of every row of docs: the findings of a blob for each of its paths."""
    paths = docs.select("doc_id", text_key(text_or_empty()).alias("blob"))
    return join_unique(paths, found, "blob").select("doc_id", F.coalesce("spans", F.array().cast(NO_SPANS)).alias("spans"))


def scan(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, spans of every row of docs, through the ledger (a new one where none is given)."""
    ledger = new_ledger(docs.sparkSession) if ledger is None else ledger
    update_ledger(docs, ledger)
    return of_paths(docs, found_spans(docs.sparkSession, ledger))


def scan_history(docs: DataFrame, pushes: int = 2, ledger: str | None = None) -> DataFrame:
    """doc_id, spans of every row of docs, taken as a history: a row is a version of the path doc_id, and versions come in
    pushes (dealt by a hash of path and text, as the table names none). Each push is an increment on the ledger."""
    ledger = new_ledger(docs.sparkSession) if ledger is None else ledger
    push = F.pmod(F.xxhash64("doc_id", text_or_empty()), F.lit(pushes))
    for k in range(pushes):
        update_ledger(docs.filter(push == k), ledger)
    return of_paths(docs, found_spans(docs.sparkSession, ledger))


def scan_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of every row of docs."""
    base = KINDS[:3]
    label = lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])
    basic = F.filter("spans", lambda s: s["kind"].isin(*base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, label), ",")
    return scan_history(docs).select("doc_id", *(count(k) for k in base), F.sha2(joined(basic).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask(text: str, spans) -> str:
    """text with each run of overlapping spans (by start) replaced by MASK."""
    out, at = [], 0
    for s in spans:
        if s["stop"] <= at:
            continue
        if s["start"] >= at:
            out += [text[at : s["start"]], MASK]
        at = s["stop"]
    return "".join([*out, text[at:]])


def _masked(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([mask(t, f) for t, f in zip(text, spans, strict=True)], dtype=object)


def redact(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """docs with every finding replaced by a mask, n_chars (if there) brought up to date; other rows are unchanged."""
    tag = "_" + uuid.uuid4().hex[:12]
    blob, spans = f"blob{tag}", f"spans{tag}"
    flag = may_hold_secret(text_or_empty())
    ledger = new_ledger(docs.sparkSession) if ledger is None else ledger
    update_ledger(docs, ledger)
    found = found_spans(docs.sparkSession, ledger).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    suspects = join_unique(docs.filter(flag).withColumn(blob, text_key(F.col("text"))), found, blob)
    masked = F.pandas_udf(_masked, "string")("text", F.coalesce(spans, F.array().cast(NO_SPANS)))
    cleaned = suspects.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(masked))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return docs.filter(~flag).unionByName(cleaned.select(*docs.columns))
