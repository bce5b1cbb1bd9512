"""N-gram Jaccard join and its connected components.

A text's set holds the 64-bit hashes of its distinct word n-grams. Rows with equal sets form a class, which is a node of
the graph whatever the ids of its rows. The n-grams of a set are put in one global order, rarest first: by a count over all
documents in 2 ** SKETCH_BITS hashed bins (any order gives right results; a rare-first one gives small groups), then by
hash. Two sets can only be similar enough if their prefixes in that order share an n-gram, so prefixes are exploded,
n-grams in one set only are dropped (by a bit table; what it lets through finds no partner), and so are entries whose
length and position no other entry of their group can meet. The sets that share an n-gram are compared under three
filters: length, position of the shared n-gram, and signatures: parities of the sets' counts in hash bins, eight or more
a n-gram up to MOST_BITS, whose distance bounds what prefix and suffix can still have in common. Pairs that pass are verified exactly, once a
pair, on the texts.

As only links that join components matter, it goes in two rounds. First each set is compared with those before it in a
group until one passes: at most one pair for every index entry, so a large group of near copies gives a chain and not all
its pairs. Then groups inside one component are dropped, and in the others every pair of two components that passes is
verified. Groups of more than BLOCK sets are cut into blocks; in the second round each pair of blocks is a task.

Null and empty texts have an empty set and link with nothing; their component_id is their doc_id. With fewer words than the
n-gram has, the whole sequence is the one n-gram. Rows of one doc_id are separate documents, so the doc_id may be in two
components. component_id is the least doc_id of a component that isn't null. An empty table gives an empty result. Extra
columns are kept by ``keep_one_of_each``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, join_unique, materialize, row_chunks, text_or_empty
from .components import components

SKETCH_BITS = 21
#: Bits of the longest signature: the parities of a set's n-gram counts in as many hash bins.
MOST_BITS = 2048
#: Bits of the largest table of n-grams that several sets have in their prefixes.
MOST_TABLE_BITS = 29
BLOCK = 8192
MEMO = 100_000
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

_memo: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[0]
    return x ^ (x >> np.uint64(29))


def hashed(words: list[bytes]) -> list[int]:
    try:
        return list(map(_memo.__getitem__, words))
    except KeyError:
        if len(_memo) > MEMO:
            _memo.clear()
        for w in words:
            if w not in _memo:
                _memo[w] = xxhash.xxh64_intdigest(w)
        return list(map(_memo.__getitem__, words))


def gram_lists(texts: list[str], n: int) -> list[np.ndarray]:
    """Hashes of the word n-grams of each text, A-Z lowered, in the order of the text."""
    split = [WORDS.findall(t.encode().translate(LOWER)) for t in texts]
    size = np.array([len(w) for w in split], np.int64)
    one = np.array([h for words in split for h in hashed(words)], np.uint64)
    out, stops = [], np.cumsum(size)
    if len(one) < n:
        full = np.zeros(0, np.uint64)
    else:
        full = np.full(len(one) - n + 1, n, np.uint64)
        for i in range(n):
            full = mix(full + one[i : len(one) - n + 1 + i] * ODD[i % 5] + np.uint64(i))
    for count, stop in zip(size.tolist(), stops.tolist(), strict=True):
        if count >= n:
            out.append(full[stop - count : stop - n + 1])
        elif count:
            short = np.full(1, count, np.uint64)
            for i in range(count):
                short = mix(short + one[stop - count + i : stop - count + i + 1] * ODD[i % 5] + np.uint64(i))
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    return np.unique(gram_lists([text], n)[0])


def least_overlap(a, b, percent: int):
    """Least size of the intersection of linked sets of sizes a and b: 100 * both >= percent * either."""
    return -(-percent * (a + b) // (100 + percent))


def sketch(rows: DataFrame, n: int) -> np.ndarray:
    """Counts of n-grams over all rows in hashed bins. Tasks send their counts in blocks of bins, which are added up block
    by block; the bins alone come back."""
    width = 1 << 13

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for (texts,) in row_chunks(batch, ["text"], 2 << 20):
                total += np.bincount((np.concatenate(gram_lists(texts, n)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        blocks = np.flatnonzero(total.reshape(-1, width).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array([total[k * width : (k + 1) * width].astype("<u4").tobytes() for k in blocks.tolist()], pa.binary())], ["block", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(counts, "<u4").astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    made = rows.select("text").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, counts binary").toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for block, counts in zip(made.column("block").to_pylist(), made.column("counts").to_pylist(), strict=True):
        out[block * width : (block + 1) * width] = np.frombuffer(counts, np.int64)
    return out.astype(np.uint32) if out.max(initial=0) < 1 << 32 else out


def signature(found: np.ndarray, bits: int) -> bytes:
    """Parities of the counts of a set's n-grams in bits hash bins. Sets that differ in k n-grams differ in k bits at most.
    The two halves of a signature, one upon the other, are the signature of half the bits."""
    parity = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def signature_bits(size: int) -> int:
    """Eight bits an n-gram or more, a power of 2, so that few differences fall together and hide each other."""
    return min(MOST_BITS, max(512, 8 << (size - 1).bit_length()))


def features(rows: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """doc_id, text_key, n_shingles, set_hash, prefix (rarest first), bins (signature) of every row (doc_id, text_key, text)."""
    held = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = held.value
        for batch in batches:
            for ids, keys, texts in row_chunks(batch, ["doc_id", "text_key", "text"], 2 << 20):
                sizes, hashes, prefixes, bins = [], [], [], []
                for grams in gram_lists(texts, n):
                    found = np.unique(grams)
                    size = len(found)
                    # Stable, so n-grams of one count stay in the order of their hashes.
                    order = np.argsort(rarity[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                    keep = size - -(-percent * size // 100) + 1 if size else 0
                    sizes.append(size)
                    hashes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if size else None)
                    prefixes.append(found[order[:keep]].view(np.int64))
                    bins.append(signature(found, signature_bits(size)) if size else None)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefixes))), pa.array(bins, pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "set_hash", "prefix", "bins"],
                )

    return rows.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key binary, n_shingles long, set_hash binary, prefix array<long>, bins binary")


def slot(token: np.ndarray, bits: int) -> np.ndarray:
    return (token.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def shared_table(made: DataFrame) -> tuple[np.ndarray, int]:
    """A bit table of the prefix n-grams that more than one set has, and its bits: about two for every prefix n-gram, up to
    2 ** MOST_TABLE_BITS; 2 ** (bits - 6) words at most come back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            sets = np.array([int.from_bytes((h or b"")[:8], "little", signed=True) for h in batch.column("set_hash").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([lists.flatten(), pa.array(np.repeat(sets, lists.value_lengths().to_numpy(zero_copy_only=False)))], ["token", "s"])

    total = made.agg(F.coalesce(F.sum(F.size("prefix").cast("long")), F.lit(0))).first()[0]
    bits = min(MOST_TABLE_BITS, max(16, int(total).bit_length() + 1))
    tokens = made.select("set_hash", "prefix").mapInArrow(run, "token long, s long")
    several = tokens.groupBy("token").agg(F.min("s").alias("low"), F.max("s").alias("high")).filter("low <> high")
    at = several.select(F.expr(f"shiftrightunsigned(token, {64 - bits})").alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table, bits


def shared_entries(made: DataFrame, table: np.ndarray, bits: int) -> DataFrame:
    """node, n, place, token of the prefix n-grams that the table lets through."""
    held = made.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            token = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            at = slot(token, bits)
            some = np.flatnonzero((held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
            pick = pa.array(row[some])
            columns = [batch.column(c).take(pick) for c in ("node", "n_shingles")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place[some].astype(np.int32)), pa.array(token[some])], ["node", "n", "place", "token"])

    return made.select("node", "n_shingles", "prefix").mapInArrow(run, "node long, n long, place int, token long")


def in_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by (token, cell), cut anew so that no group lies in two of them."""
    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        token, cell = (batch.column(c).to_numpy() for c in ("token", "cell"))
        last = np.flatnonzero((token == token[-1]) & (cell == cell[-1]))[0]
        if last or (kept and (kept[-1].column("token")[-1].as_py(), kept[-1].column("cell")[-1].as_py()) != (token[0], cell[0])):
            if kept or last:
                yield pa.concat_tables([*kept, pa.Table.from_batches([batch.slice(0, last)])]) if last else pa.concat_tables(kept)
            kept = []
        kept.append(pa.Table.from_batches([batch.slice(last)]))
    if kept:
        yield pa.concat_tables(kept)


def group_numbers(table: pa.Table) -> np.ndarray:
    token, cell = (table.column(c).to_numpy() for c in ("token", "cell"))
    return np.cumsum(np.concatenate([[0], (np.diff(token) != 0) | (np.diff(cell) != 0)]))


def has_partner(group: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Which rows have another of their group that the length and position filters let them meet; rows are sorted by group,
    then size."""
    first = np.concatenate([[True], group[1:] != group[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    met, active, step = np.zeros(len(group), bool), np.flatnonzero(~first), 1
    while len(active):
        other = active - step
        inside = other >= start[active]
        active, other = active[inside], other[inside]
        close = 100 * size[other] >= percent * size[active]
        active, other = active[close], other[close]
        able = np.minimum(size[active] - place[active], size[other] - place[other]) >= least_overlap(size[active], size[other], percent)
        met[active[able]] = True
        met[other[able]] = True
        step += 1
    return met


def with_partner(index: DataFrame, percent: int) -> DataFrame:
    """The entries (node, n, place, token, block, blocks) that may have a partner. Groups of one block are tried; larger ones
    stay as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches):
            number = lambda c: table.column(c).to_numpy().astype(np.int64)  # noqa: B023, E731
            met = has_partner(group_numbers(table), number("n"), number("place"), percent) | (number("blocks") > 1)
            yield from table.filter(pa.array(met)).drop_columns(["cell"]).combine_chunks().to_batches()

    ordered = index.withColumn("cell", F.col("block")).repartition("token", "cell").sortWithinPartitions("token", "cell", "n", "node")
    return ordered.select("node", "n", "place", "token", "block", "blocks", "cell").mapInArrow(run, "node long, n long, place int, token long, block int, blocks int")


def unpacked(signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of each signature, and the signatures as they are and folded to half their bits, in rows of one length."""
    width = np.array([len(x) for x in signatures], np.int64)
    own, half = (np.zeros((len(signatures), int(width.max(initial=8)) // 8), np.uint64) for _ in range(2))
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        words = np.frombuffer(b"".join(signatures[k] for k in rows.tolist()), np.uint64).reshape(len(rows), -1)
        own[rows, : w // 8] = words
        if w > 8:
            half[rows, : w // 16] = words[:, : w // 16] ^ words[:, w // 16 :]
    return width * 8, own, half


def bits_apart(a: np.ndarray, b: np.ndarray, signatures: tuple) -> np.ndarray:
    """Distance of the signatures of rows a and b, in the bits of the shorter one. Where one has more than twice the bits of
    the other, which sizes rule out, the distance counts as 0."""
    width, own, half = signatures
    left = np.where((width[a] > width[b])[:, None], half[a], own[a])
    right = np.where((width[b] > width[a])[:, None], half[b], own[b])
    apart = np.bitwise_count(left ^ right).sum(1, dtype=np.int64)
    return np.where(np.maximum(width[a], width[b]) <= 2 * np.minimum(width[a], width[b]), apart, 0)


def near_pairs(token, rep, size, place, bins, label, percent: int, chain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of rows of one token that pass all filters; rows are sorted by token, then size. chain: each row is
    compared with those before it, nearest first, until one passes. Else all pairs of different labels."""
    first = np.concatenate([[True], token[1:] != token[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))
    active, out, step = np.flatnonzero(~first), [], 1
    while len(active):
        other = active - step
        inside = other >= start[active]
        active, other = active[inside], other[inside]
        close = 100 * size[other] >= percent * size[active]  # sizes fall with each step, so this row is done
        active, other = active[close], other[close]
        need = least_overlap(size[active], size[other], percent)
        # Of the first n-gram that two sets share: neither has a common one before it.
        able = (np.minimum(size[active] - place[active], size[other] - place[other]) >= need) & (rep[active] != rep[other])
        if not chain:
            able &= label[active] != label[other]
        able = np.flatnonzero(able)
        passed = []
        for k in range(0, len(able), 1 << 14):
            part = able[k : k + (1 << 14)]
            apart = bits_apart(active[part], other[part], bins)
            passed.append(part[apart <= size[active[part]] + size[other[part]] - 2 * need[part]])
        if passed:
            passed = np.concatenate(passed)
            out.append((rep[other[passed]], rep[active[passed]]))
            if chain:
                active = np.delete(active, passed)
        step += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def candidates(index: DataFrame, percent: int, chain: bool) -> DataFrame:
    """a, b: distinct pairs that pass the filters, from index (token, cell, node, n, place, bins, label)."""
    names = ["token", "cell", "node", "n", "place", "bins", "label"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches):
            number = lambda c: table.column(c).to_numpy().astype(np.int64)  # noqa: B023, E731
            bins = unpacked(table.column("bins").to_pylist())
            a, b = near_pairs(group_numbers(table), number("node"), number("n"), number("place"), bins, number("label"), percent, chain)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    ordered = index.select(*names).repartition("token", "cell").sortWithinPartitions("token", "cell", "n", "node")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def node_texts(rows: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the given nodes. A bitmap of fixed size (2 ** 23 bits) spares most other rows the shuffle."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 23))
    wanted = nodes.join(classes.select("node", "text_key"), "node")
    bits = wanted.select(place("text_key").alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    marked = rows.withColumn("at", place("text_key")).withColumn("word", F.shiftright("at", 6)).join(F.broadcast(bits), "word")
    some = marked.filter(F.expr("shiftrightunsigned(bits, cast(at & 63 as int)) & 1") == 1).select("text_key", "text")
    # Copies of a text are made one in each task before they move.
    return some.dropDuplicates(["text_key"]).join(wanted, "text_key").select("node", "text")


def verify(pairs: DataFrame, rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are links, by their whole texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            held, out = {}, []
            for k, (x, y) in enumerate(zip(batch.column("text_a"), batch.column("text_b"), strict=True)):
                left, right = shingles(x.as_py(), n), None
                if b[k] not in held:
                    held = {b[k]: shingles(y.as_py(), n)}
                right = held[b[k]]
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both) and both:
                    out.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in out], pa.int64()), pa.array([b[k] for k in out], pa.int64())], ["a", "b"])

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = materialize(node_texts(rows, classes, nodes), "texts")
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (MD5 of the text), text."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"), text.alias("text"))


def linked_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component (a node; null for empty sets), component_id of every row of docs (doc_id, text)."""
    rows = keyed_rows(docs)
    made = materialize(features(rows, n, percent, sketch(rows, n)).withColumn("node", F.monotonically_increasing_id()), "features")
    # A node is a class of equal sets, named after one of its rows.
    groups = made.filter("n_shingles > 0").groupBy("set_hash").agg(F.min("node").alias("node"), F.min("doc_id").alias("low"), F.min("text_key").alias("text_key"))
    classes = materialize(groups, "classes")
    entries = shared_entries(made, *shared_table(made)).join(classes.select("node"), "node", "left_semi")
    index = materialize(entries, "index")
    blocks = index.groupBy("token").agg(F.expr(f"cast((count(1) + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    blocked = index.join(blocks, "token").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    index = materialize(with_partner(blocked, percent), "partners")
    bins = made.select("node", "bins").join(index.select("node").distinct(), "node", "left_semi")
    bins = materialize(bins, "bins")
    chained = index.withColumn("cell", F.expr("block * blocks + block")).withColumn("label", F.col("node"))
    tried = materialize(candidates(chained.join(bins, "node"), percent, True), "pairs")
    links = materialize(verify(tried, rows, classes, n, percent), "links")
    labels = components(links)
    # The rest: entries of groups that reach over components, every pair of blocks.
    named = index.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token")
    cells = named.join(mixed, "token").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("cell", F.expr("least(block, other) * blocks + greatest(block, other)"))
    others = candidates(cells.join(bins, "node"), percent, False).join(tried, ["a", "b"], "left_anti")
    rest = verify(materialize(others, "pairs"), rows, classes, n, percent)
    labels = components(links.unionByName(rest)).withColumnRenamed("id", "node")
    linked = labels.join(classes.select("node", "low"), "node")
    least = linked.groupBy("label").agg(F.min("low").alias("component_id"))
    linked = materialize(join_unique(linked.select("node", "label"), least, "label"), "linked")
    of_class = classes.join(linked, "node", "left").select("set_hash", F.coalesce("label", "node").alias("component"), F.when(F.col("label").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"))
    found = join_unique(made.select("doc_id", "text_key", "n_shingles", "set_hash"), of_class, "set_hash")
    alone = F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "text_key", "n_shingles", "component", alone.alias("component_id"))


def link_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    return linked_rows(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with its own columns: of its rows of least doc_id (rows without one come last) the one
    whose text has the least key. Rows with empty sets link with nothing, so they all stay."""
    tag = uuid.uuid4().hex[:12]
    key, text, turn = f"k{tag}", f"t{tag}", f"r{tag}"
    of_component = linked_rows(docs, n, percent).filter(F.col("component").isNotNull()).groupBy("component")
    first = of_component.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    lead = first.select(F.col("first.doc_id").alias(f"a{tag}"), F.col("first.text_key").alias(f"b{tag}"))
    named = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(text, F.unhex(F.md5(text_or_empty().cast("binary"))))
    kept = named.join(lead, F.col(key).eqNullSafe(F.col(f"a{tag}")) & (F.col(text) == F.col(f"b{tag}")), "left_semi")
    kept = kept.withColumn(turn, F.expr(f"row_number() over (partition by {key}, {text} order by {key})")).filter(F.col(turn) == 1)
    return kept.select(*docs.columns).unionByName(docs.filter(~text_or_empty().rlike(WORD)))
