"""Removal of repeated substrings by a hash-compared suffix sort.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (in a document of smaller doc_id, or further
left in the same one). Every window of LENGTH bytes is filed under an anchor, its GRAM-byte string of least hash, so equal
windows are filed under equal anchors at equal offsets, and only about one place in thirty is an anchor. Anchors whose
string occurs once in the corpus are dropped at once; what is left is sorted as suffixes:

* the windows of one anchor span a context of bytes around it. Where all contexts of an anchor string are alike, all but
  the earliest are repeats;
* otherwise the contexts are grouped by anchor string and their right parts, and mirrored left parts, are sorted as
  suffixes. Comparisons take the common extension from polynomial prefix hashes by binary search; neighbours are verified
  byte by byte. Windows at one offset are equal if they lie in one run of long enough extensions on both sides, so in each
  such class all but the earliest are repeats;
* an anchor string with more than HOT contexts does not fit a task: there the windows themselves are hashed, and counted
  by key over all tasks.

Repeats inside one task are settled there (map-side combine), so no key has more rows than there are tasks.
Which anchor strings occur twice is told to the tasks by a bit table of fixed size (2 ** BITS bits); what it lets through
by accident is settled by the exact steps after it.

Null texts count as empty; texts under LENGTH bytes keep everything unless repeats cover them, which they can't. Very long
texts are cut into pieces that overlap by LENGTH - 1 bytes, which changes nothing. Rows of one doc_id with the same text are
one document; those with other texts are documents of their own, which come one after another by the hash of their text, as
do rows without a doc_id, before all others. An empty table gives an empty result. Extra columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_chunks, text_or_empty
from .suffix_anchors import PrefixHash, anchors, mix
from .suffix_sort import neighbours

LENGTH = 100
GRAM = 32
BITS = 27
HOT = 20_000
#: Bytes of text handled at once; longer texts are cut into pieces of this size.
CHUNK = 1 << 21
BLOCK_ROWS = 30_000
#: Bits of a place inside a text; a version, of 31 bits, stands above them.
VERSION_SHIFT = 32
#: Stands for a null doc_id, which comes before all others.
NULL_ID = -(1 << 62)


NUMBERS = ["gram", "context", "doc_id", "place", "back", "front"]


def pieces(ids: list, versions: list[int], texts: list[str]) -> tuple[list, list[int], list[bytes]]:
    """doc_id, offset and bytes of each piece. Offsets of a row start at its version << VERSION_SHIFT, so rows of one doc_id
    with other texts are told apart, and come one after another."""
    out_ids, offsets, parts = [], [], []
    for doc, version, text in zip(ids, versions, texts, strict=True):
        raw = text.encode()
        for at in range(0, max(1, len(raw) - LENGTH + 1), CHUNK):
            out_ids.append(doc)
            offsets.append((version << VERSION_SHIFT) + at)
            parts.append(raw[at : at + CHUNK + LENGTH - 1])
    return out_ids, offsets, parts


def chunk_anchors(ids: list, versions: list[int], texts: list[str]):
    names, offsets, parts = pieces(ids, versions, texts)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    document, place, first, last, gram = anchors(data, bounds, LENGTH, GRAM)
    shift = np.array(offsets, np.int64) - bounds[:-1] if len(parts) else np.zeros(0, np.int64)
    return names, data, document, place, first, last, gram, shift


def slot(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(64 - BITS)).astype(np.int64)


def slot_of(gram: str):
    return F.expr(f"shiftrightunsigned({gram}, {64 - BITS})")


def bit_table(keys: DataFrame) -> np.ndarray:
    """The table with the bit of every row's slot set; 2 ** (BITS - 6) words at most come back."""
    words = keys.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def is_set(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def repeated_grams(rows: DataFrame) -> np.ndarray:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, versions, texts in row_chunks(batch, ["doc_id", "version", "text"], CHUNK):
                gram = chunk_anchors(ids, versions, texts)[6]
                found, counts = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.minimum(counts, 2).astype(np.int8))], ["gram", "n"])

    seen = rows.mapInArrow(run, "gram long, n tinyint").groupBy("gram").agg(F.sum("n").alias("n"))
    return bit_table(seen.filter("n > 1").select(slot_of("gram").alias("slot")))


class Leads:
    """The earliest occurrence of each (gram, context) that a task has met."""

    def __init__(self):
        self.key = np.zeros(0, np.uint64)
        self.rows = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64)]

    def settle(self, gram, context, doc, place) -> np.ndarray:
        """Which of these (distinct) entries come after one that was met before; the others are taken in."""
        key = mix(gram + mix(context))
        later = np.zeros(len(key), bool)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            g, c, d, p = (r[at] for r in self.rows)
            later = (g == gram) & (c == context) & ((d < doc) | ((d == doc) & (p < place)))
        fresh = ~later
        key = np.concatenate([self.key, key[fresh]])
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.rows = [np.concatenate([old, new[fresh]])[order] for old, new in zip(self.rows, (gram, context, doc, place), strict=True)]
        return later


def task_leads(batches: Iterable[pa.RecordBatch], table: np.ndarray):
    """For each chunk of a task: data, and of the anchors whose gram is in the table gram, context, doc, place, back,
    front, first and last window (in data), and whether each is the task's lead of its context."""
    met = Leads()
    for batch in batches:
        for ids, versions, texts in row_chunks(batch, ["doc_id", "version", "text"], CHUNK):
            names, data, document, place, first, last, gram, shift = chunk_anchors(ids, versions, texts)
            some = np.flatnonzero(is_set(table, slot(gram)))
            if not len(some):
                continue
            document, place, first, last, gram = (x[some] for x in (document, place, first, last, gram))
            back, front = place - first, place - last
            context = mix(PrefixHash(data, 1).of(first, last + LENGTH) + mix((back * 128 + front).astype(np.uint64)))
            known = np.array([NULL_ID if i is None else i for i in names], np.int64)[document]
            absolute = place + shift[document]
            order = np.lexsort((absolute, known, context, gram))
            gram, context, known, absolute, back, front, first, last = (x[order] for x in (gram, context, known, absolute, back, front, first, last))
            lead = np.ones(len(order), bool)
            lead[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
            again = np.zeros(len(order), bool)  # repeated rows of one document are no repeats of each other
            again[1:] = ~lead[1:] & (known[1:] == known[:-1]) & (absolute[1:] == absolute[:-1])
            heads = np.flatnonzero(lead)
            lead[heads[met.settle(gram[heads], context[heads], known[heads], absolute[heads])]] = False
            keep = ~again
            yield data, *(x[keep] for x in (gram, context, known, absolute, back, front, first, last, lead))


def repeated_anchors(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """Two kinds of rows. Anchors: gram, context (hash), doc_id, place, back and front (offsets of the first and last
    window before the anchor). Spans that are repeats inside a task: doc_id, start, stop."""
    held = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, gram, context, doc, place, back, front, _, _, lead in task_leads(batches, held.value):
            rest = ~lead
            begin, stop = merged(doc[rest], place[rest] - back[rest], place[rest] - front[rest] + LENGTH)
            n, m = int(lead.sum()), len(stop)
            pair = lambda a, b, kind: pa.concat_arrays([pa.nulls(n, kind) if a is None else pa.array(a, kind), pa.nulls(m, kind) if b is None else pa.array(b, kind)])
            long, int_ = pa.int64(), pa.int32()
            yield pa.RecordBatch.from_arrays(
                [
                    pair(doc[lead], begin[0], long), pair(gram[lead].view(np.int64), None, long), pair(context[lead].view(np.int64), None, long), pair(place[lead], None, long),
                    pair(back[lead].astype(np.int32), None, int_), pair(front[lead].astype(np.int32), None, int_), pair(None, begin[1], long), pair(None, stop, long),
                ],
                ["doc_id", "gram", "context", "place", "back", "front", "start", "stop"],
            )

    return rows.mapInArrow(run, "doc_id long, gram long, context long, place long, back int, front int, start long, stop long")


def contexts(rows: DataFrame, several: np.ndarray, hot: np.ndarray) -> DataFrame:
    """The tasks' leads of grams in the table, with their bytes, and whether the gram is hot."""
    held = rows.sparkSession.sparkContext.broadcast((several, hot))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, hot = held.value
        for data, gram, context, doc, place, back, front, first, last, lead in task_leads(batches, several):
            raw = data.tobytes()
            some = np.flatnonzero(lead)
            byte = [raw[a : b + LENGTH] for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True)]
            arrays = [gram[some].view(np.int64), context[some].view(np.int64), doc[some], place[some], back[some].astype(np.int32), front[some].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(byte, pa.binary()), pa.array(is_set(hot, slot(gram[some])))], [*NUMBERS, "bytes", "hot"])

    return rows.mapInArrow(run, "gram long, context long, doc_id long, place long, back int, front int, bytes binary, hot boolean")


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Overlapping or touching spans of a document as one: ((doc, start), stop)."""
    if not len(doc):
        return (doc, start), stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    base = start >> VERSION_SHIFT << VERSION_SHIFT
    low, high = start - base, stop - base
    new_doc = np.concatenate([[True], (doc[1:] != doc[:-1]) | (base[1:] != base[:-1])])
    # Stops rise with starts inside a document up to nesting; a running maximum by document number keeps them apart.
    number = np.cumsum(new_doc)
    step = int(high.max()) + 1
    reach = np.maximum.accumulate(number * step + high) - number * step
    new = new_doc.copy()
    new[1:] |= low[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return (doc[heads], start[heads]), (reach + base)[np.concatenate([heads[1:], [len(doc)]]) - 1]


def repeats_in_groups(gram, context, doc, place, back, front, byte: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, stop of the repeats among contexts, given sorted by gram, then context."""
    order = np.lexsort((place, doc, context, gram))
    gram, context, doc, place, back, front = (x[order] for x in (gram, context, doc, place, back, front))
    head = np.concatenate([[True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])])
    same = ~head & np.concatenate([[False], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])])
    out = [(doc[same], place[same] - back[same], place[same] - front[same] + LENGTH)]
    keep = np.flatnonzero(head)
    several = np.concatenate([[True], gram[keep][1:] != gram[keep][:-1], [True]])
    keep = keep[~(several[:-1] & several[1:])]  # a gram with one context has no more to compare
    if len(keep):
        gram, doc, place, back, front = (x[keep] for x in (gram, doc, place, back, front))
        parts = [byte[k] for k in order[keep].tolist()]
        size = np.array([len(p) for p in parts], np.int64)
        at = np.cumsum(size) - size
        data = np.frombuffer(b"".join(parts), np.uint8)
        mirror = np.ascontiguousarray(data[::-1])
        anchor = at + back
        n = len(keep)
        group = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
        right_order, right_common = neighbours(PrefixHash(data), data, anchor, size - back, group)
        left_order, left_common = neighbours(PrefixHash(mirror), mirror, len(data) - anchor, back.astype(np.int64), group)
        rank = np.empty(n, np.int64)
        rank[np.lexsort((place, doc))] = np.arange(n)
        repeat = np.zeros((n, LENGTH - GRAM + 2), bool)
        for offset in range(LENGTH - GRAM + 1):
            here = np.flatnonzero((front <= offset) & (offset <= back))
            if not len(here):
                continue
            # Classes of equal right and left parts: runs of neighbours with extensions that are long enough.
            right, left = np.empty(n, np.int64), np.empty(n, np.int64)
            right[right_order] = np.cumsum((right_common < LENGTH - offset) | new_group(group, right_order))
            left[left_order] = np.cumsum((left_common < offset) | new_group(group, left_order))
            key = right[here] * (n + 1) + left[here]
            sort = np.lexsort((rank[here], key))
            again = np.concatenate([[False], key[sort][1:] == key[sort][:-1]])
            repeat[here[sort[again]], offset] = True
        edge = np.diff(np.pad(repeat.astype(np.int8), ((0, 0), (1, 0))), axis=1)
        row, low = np.nonzero(edge == 1)
        row_, high = np.nonzero(edge == -1)
        out.append((doc[row], place[row] - (high - 1), place[row] - low + LENGTH))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def new_group(group: np.ndarray, order: np.ndarray) -> np.ndarray:
    g = group[order]
    return np.concatenate([[True], g[1:] != g[:-1]])


def compare(found: DataFrame) -> DataFrame:
    """doc_id, start, stop of repeats, contexts being compared inside their anchor string's group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            numbers = [table.column(c).to_numpy().astype(np.int64) for c in NUMBERS]
            doc, start, stop = repeats_in_groups(*numbers, table.column("bytes").to_pylist())
            begin, finish = merged(doc, start, stop)
            return pa.RecordBatch.from_arrays([pa.array(begin[0]), pa.array(begin[1]), pa.array(finish)], ["doc_id", "start", "stop"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            if sum(b.num_rows for b in kept) < BLOCK_ROWS:
                continue
            # All but the last anchor string are complete.
            table = pa.Table.from_batches(kept).combine_chunks()
            gram = table.column("gram").to_numpy()
            cut = int(np.flatnonzero(gram == gram[-1])[0])
            if cut:
                yield settle(table.slice(0, cut).to_batches())
            kept = table.slice(cut).to_batches()
        if kept:
            yield settle(kept)

    ordered = found.select(*NUMBERS, "bytes").repartition("gram").sortWithinPartitions("gram")
    return ordered.mapInArrow(run, "doc_id long, start long, stop long")


def window_repeats(found: DataFrame) -> DataFrame:
    """doc_id, start, stop of repeats, by counting each window under (anchor string, offset, hash)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 5_000):
                part = batch.slice(k, 5_000)
                gram, _, doc, place, back, front = (part.column(c).to_numpy().astype(np.int64) for c in NUMBERS)
                byte = part.column("bytes").to_pylist()
                size = np.array([len(b) for b in byte], np.int64)
                at = np.cumsum(size) - size
                table = PrefixHash(np.frombuffer(b"".join(byte), np.uint8), 1)
                many = back - front + 1
                row = np.repeat(np.arange(len(gram)), many)
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                begin = at[row] + step
                offset = back[row] - step
                key = mix(table.of(begin, begin + LENGTH) + mix(offset.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(gram[row]), pa.array(key.view(np.int64)), pa.array(doc[row]), pa.array(place[row] - offset)], ["gram", "key", "doc_id", "start"])

    windows = found.select(*NUMBERS, "bytes").mapInArrow(run, "gram long, key long, doc_id long, start long")
    first = windows.groupBy("gram", "key").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = windows.join(first.drop("n"), ["gram", "key"]).filter("first.doc_id <> doc_id or first.start <> start")
    return again.select("doc_id", "start", (F.col("start") + LENGTH).alias("stop"))


def versioned(docs: DataFrame) -> DataFrame:
    """doc_id, version (31 bits of the text's hash), text."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.shiftrightunsigned(F.xxhash64(text), 33).alias("version"), text.alias("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, stop (bytes from version << VERSION_SHIFT on, overlapping spans not yet joined) of all repeats in docs
    (doc_id, text)."""
    rows = versioned(docs)
    found = materialize(repeated_anchors(rows, repeated_grams(rows)), "anchors")
    entries = found.filter("gram is not null")
    # Contexts that occurred before, whole.
    first = F.expr("min(struct(doc_id, place)) over (partition by gram, context)")
    again = entries.withColumn("first", first).filter("first.doc_id <> doc_id or first.place <> place")
    spans = found.filter("gram is null").select("doc_id", "start", "stop").unionByName(again.select("doc_id", (F.col("place") - F.col("back")).alias("start"), (F.col("place") - F.col("front") + LENGTH).alias("stop")))
    # Grams with several contexts.
    kinds = entries.groupBy("gram").agg(F.min("context").alias("low"), F.max("context").alias("high"), F.count(F.lit(1)).alias("n"))
    kinds = materialize(kinds.filter("low <> high").select(slot_of("gram").alias("slot"), (F.col("n") > HOT).alias("hot")), "kinds")
    several, hot = bit_table(kinds.select("slot")), bit_table(kinds.filter("hot").select("slot"))
    full = contexts(rows, several, hot)
    spans = spans.unionByName(compare(full.filter("not hot")))
    if hot.any():
        spans = spans.unionByName(window_repeats(full.filter("hot")))
    return spans.withColumn("doc_id", F.expr(f"if(doc_id = {NULL_ID}, null, doc_id)"))


def joined_spans(starts: list[int], stops: list[int]) -> tuple[np.ndarray, np.ndarray]:
    (_, begin), finish = merged(np.zeros(len(starts), np.int64), np.array(starts, np.int64), np.array(stops, np.int64))
    return begin, finish


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and starts, stops (arrays or null) of every row of docs."""
    keyed = repeated_spans(docs).withColumn("version", F.shiftright("start", VERSION_SHIFT))
    base = F.shiftleft("version", VERSION_SHIFT)
    spans = keyed.groupBy("doc_id", "version").agg(F.collect_list(F.struct((F.col("start") - base).alias("start"), (F.col("stop") - base).alias("stop"))).alias("spans"))
    named = spans.select(F.col("doc_id").alias("span_doc"), F.col("version").alias("span_version"), F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    rows = versioned(docs)
    return rows.join(named, F.col("doc_id").eqNullSafe(F.col("span_doc")) & (F.col("version") == F.col("span_version")), "left").select("doc_id", "text", "starts", "stops")


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, starts, stops in zip(*(batch.column(c) for c in ("doc_id", "text", "starts", "stops")), strict=True):
                raw, kept, at, gone, n = text.as_py().encode(), hashlib.sha256(), 0, 0, 0
                if starts.is_valid:
                    for a, b in zip(*(x.tolist() for x in joined_spans(starts.values.to_numpy(), stops.values.to_numpy())), strict=True):
                        kept.update(raw[at:a])
                        gone, n, at = gone + b - a, n + 1, b
                kept.update(raw[at:])
                out.append((doc.as_py(), len(raw), gone, n, kept.hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == 4 else pa.int64()) for k, x in enumerate(columns)], names)

    return with_spans(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text of every row of docs without its repeats; cut characters are dropped."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, stops in zip(*(batch.column(c) for c in ("text", "starts", "stops")), strict=True):
                raw, kept, at = text.as_py().encode(), [], 0
                if starts.is_valid:
                    for a, b in zip(*(x.tolist() for x in joined_spans(starts.values.to_numpy(), stops.values.to_numpy())), strict=True):
                        kept.append(raw[at:a])
                        at = b
                out.append(b"".join([*kept, raw[at:]]).decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return with_spans(docs).mapInArrow(run, "doc_id long, text string")
