"""Sharding by histogram sort, with DataFrame operations only.

Rows are ordered by a 63-bit key: the CRC-32 of the text, then a hash of doc_id and text, so equal texts lie together and
a group of copies that is too large for one shard can still be cut inside. Splitters come from a histogram: the exact
bytes of every interval between candidate boundaries are summed over all partitions (map-side combined, BINS sums a
splitter come back), and the interval in which a splitter falls is divided again until the bytes below a boundary meet the
target within the tolerance or the interval is a single key. Rows then move once, to their shard.

Law ``bytes``: each shard gets an equal share of bytes within the tolerance, or within one row where a single key is
larger. Null texts have size 1 and the checksum of no bytes. Repeated rows are separate rows. An empty table gives an
empty result. Extra columns are not used.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

SHARDS = 16
KEY_BITS = 63
#: Candidate boundaries in an interval: 2 ** STEP.
STEP = 8
#: Bytes by which a splitter may miss, as a share of a shard.
TOLERANCE = 0.001
#: Rows that are numbered in one task, about.
SLOT_ROWS = 50_000


def keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    crc = F.crc32(text.cast("binary"))
    low = F.xxhash64(F.col("doc_id"), text).bitwiseAND(F.lit((1 << 31) - 1))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        crc.alias("text_crc32"),
        (crc * F.lit(1 << 31) + low).alias("key"),
    )


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[int]:
    """Least keys of shards 1, 2, ...: the bytes of the keys below each are near its share."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    want = [total * k / shards for k in range(1, shards)]
    slack = tolerance * total / shards
    #: splitter -> (low key, bits of the interval's width, bytes below low)
    open_ = {k: (0, KEY_BITS, 0) for k in range(len(want))}
    found: dict[int, int] = {}
    while open_ and total:
        intervals = sorted({x for x in open_.values()})
        counted: dict[int, dict[int, int]] = {}
        for bits in {x[1] for x in intervals}:  # intervals of one width share a pass
            lows = sorted({low for low, b, _ in intervals if b == bits})
            finer = max(0, bits - STEP)
            chosen = F.lit(False)
            if len(lows) == 1 and bits == KEY_BITS:
                chosen = F.lit(True)
            else:
                chosen = F.shiftright("key", bits).isin([low >> bits for low in lows])
            for b, size in rows.filter(chosen).groupBy(F.shiftright("key", finer).alias("bin")).agg(F.sum("size")).collect():
                counted.setdefault((b << finer) >> bits << bits, {})[b << finer] = size
        following = {}
        for k, (low, bits, below) in open_.items():
            finer = max(0, bits - STEP)
            bins = sorted(counted.get(low, {}).items())
            best = (abs(below - want[k]), low)
            for at, size in bins:
                if below + size > want[k]:
                    break
                below += size
                best = min(best, (abs(below - want[k]), at + (1 << finer)))
            else:
                found[k] = best[1]
                continue
            best = min(best, (abs(below + size - want[k]), at + (1 << finer)))
            if best[0] <= slack or finer == 0:
                found[k] = best[1]
            else:
                following[k] = (at, finer, below)
        open_ = following
    return [found.get(k, 0) for k in range(len(want))]


def shard_of(key: Column, bounds: list[int]) -> Column:
    """How many of the bounds are at most key."""
    out = F.lit(0)
    for b in bounds:
        out = out + (key >= F.lit(b)).cast("int")
    return out


def locate(key: int, bounds: list[int]) -> int:
    return bisect_right(bounds, key)


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text)."""
    rows = materialize(keyed(docs), "shard")
    placed = rows.withColumn("shard", shard_of(F.col("key"), splitters(rows, shards)))
    # Slots: rows are numbered inside small cells of a shard; a cell starts where the cells before it end.
    cells = max(1, min(1 << 20, rows.count() // (shards * SLOT_ROWS) + 1) * 8)
    celled = placed.withColumn("cell", F.pmod(F.xxhash64("key", "doc_id"), F.lit(cells)).cast("int"))
    counts = celled.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("start", F.expr("sum(n) over (partition by shard order by cell) - n")).drop("n")
    numbered = celled.withColumn("nth", F.expr("row_number() over (partition by shard, cell order by key, doc_id)"))
    return numbered.join(starts, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
