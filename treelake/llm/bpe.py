"""Byte-level BPE encoding and decoding.

Every match of the split pattern is encoded by itself. Pieces that are not in the vocabulary go through the merges in
batches: each piece has a segment tree over its byte positions whose nodes hold the least (pair rank, position), so the
root names the leftmost pair of least rank. A merge changes three leaves (the merged position, its live left neighbour
and the consumed position) and their ancestors, hence costs O(log n). All pieces of a batch that still have a pair to
merge take their next merge together, as numpy operations over one array of trees. A very long piece has a tree of its own
and merges all pairs of the least rank together.

Null texts count as empty; an empty text has no tokens. Repeated rows give repeated results, an empty table an empty one.
Extra columns pass through ``encode_documents`` untouched, but for those named like what it adds, which are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_chunks

NONE = np.int64(1) << 62
#: Remembered pieces in one Python worker; beyond that the memory is emptied.
MEMO = 100_000
#: Tree leaves handled at once.
LEAVES = 1 << 19
#: Pieces of more bytes are merged by themselves, a rank at a time.
LONG = 2048


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PairTable:
    """(left id, right id) -> rank of the joined token, by open addressing in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(rank)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        self.bits = max(8, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slots[left]
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            chosen = np.zeros(len(left), bool)
            chosen[first] = True
            put = chosen & free
            self.keys[at[put]] = keys[left[put]]
            self.values[at[put]] = values[left[put]]
            left = left[~put]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where the two do not join."""
        keys = left << 20 | right
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = ranks
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.memo: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if len(piece) > LONG:
                out[k] = self._merge_long(piece)
            else:
                groups.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(k)
        for height, members in groups.items():
            step = max(1, LEAVES >> height)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for k, ids in zip(part, self._merge(height, [pieces[k] for k in part]), strict=True):
                    out[k] = ids
        return out

    def _merge(self, height: int, pieces: list[bytes]) -> list[bytes]:
        n, width = len(pieces), 1 << height
        size = np.array([len(p) for p in pieces], np.int64)
        ids = np.full((n, width + 1), -1, np.int64)
        live = np.arange(width) < size[:, None]
        ids[:, :width][live] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), NONE, np.int64)
        pair = (ids[:, :-1] >= 0) & (ids[:, 1:] >= 0)
        ranks = self.pairs.ranks(ids[:, :-1][pair], ids[:, 1:][pair])
        leaves = np.full((n, width), NONE, np.int64)
        leaves[pair] = np.where(ranks >= 0, ranks, NONE >> 32) << 32
        leaves += np.arange(width)
        leaves[leaves >= NONE] = NONE
        tree[:, width:] = leaves
        for level in range(height - 1, -1, -1):
            low = 1 << level
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        active = np.flatnonzero(tree[:, 1] < NONE)
        while len(active):
            root = tree[active, 1]
            at = root & 0xFFFFFFFF
            gone = after[active, at]
            ids[active, at] = root >> 32
            ids[active, gone] = -1
            following = np.minimum(after[active, gone], width)
            after[active, at] = following
            before[active, following] = at
            self._set(tree, height, active, np.minimum(gone, width - 1), np.full(len(active), NONE))
            self._refresh(tree, height, active, at, ids, after, width)
            previous = before[active, at]
            has = previous >= 0
            self._refresh(tree, height, active[has], previous[has], ids, after, width)
            active = active[tree[active, 1] < NONE]
        flat = ids[:, :width]
        kept = flat >= 0
        counts = kept.sum(1)
        data = flat[kept].astype("<u4").tobytes()
        ends = np.cumsum(counts) * 4
        return [data[e - 4 * c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]

    def _merge_long(self, piece: bytes) -> bytes:
        """One long piece. The root names the least rank; all its pairs, found by going down the tree, are merged together from
        left to right, up to the first that makes a pair of lower rank, which has to come next."""
        n = len(piece)
        height = max(1, (n - 1).bit_length())
        width = 1 << height
        ids = np.full(width + 1, -1, np.int32)
        ids[:n] = self.byte_ids[np.frombuffer(piece, np.uint8)]
        after = np.minimum(np.arange(1, width + 2), width).astype(np.int32)
        before = np.arange(-1, width, dtype=np.int32)
        tree = np.full(2 * width, NONE, np.int64)
        tree[width : width + n - 1] = self._leaves(ids, after, np.arange(n - 1))
        for level in range(height - 1, -1, -1):
            low = 1 << level
            tree[low : 2 * low] = np.minimum(tree[2 * low : 4 * low : 2], tree[2 * low + 1 : 4 * low : 2])
        while tree[1] < NONE:
            rank = int(tree[1] >> 32)
            nodes = np.ones(1, np.int64)
            for _ in range(height):
                nodes = np.column_stack((2 * nodes, 2 * nodes + 1)).ravel()
                nodes = nodes[tree[nodes] >> 32 == rank]
            at = nodes - width
            # Of pairs that overlap in a run, every second one goes.
            linked = np.concatenate([[False], at[1:] == after[at[:-1]]])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(linked, 0, place))) % 2 == 0]
            gone = after[at]
            following = after[gone]
            left = ids[before[at]].astype(np.int64)
            left[before[at] < 0] = -1
            left[1:][before[at[1:]] == gone[:-1]] = rank
            right = ids[following].astype(np.int64)
            low = np.zeros(len(at), bool)
            for a, b in ((left, np.full(len(at), rank)), (np.full(len(at), rank), right)):
                ranks = self.pairs.ranks(np.maximum(a, 0), np.maximum(b, 0))
                low |= (a >= 0) & (b >= 0) & (ranks >= 0) & (ranks < rank)
            if low.any():
                stop = int(np.argmax(low)) + 1
                at, gone, following = at[:stop], gone[:stop], following[:stop]
            ids[at], ids[gone] = rank, -1
            after[at], before[following] = following, at
            previous = before[at]
            fresh = np.concatenate([at, previous[previous >= 0]])
            tree[width + gone.astype(np.int64)] = NONE
            tree[width + fresh.astype(np.int64)] = self._leaves(ids, after, fresh)
            nodes = np.unique(np.concatenate([fresh, gone])).astype(np.int64) + width
            for _ in range(height):
                nodes = nodes >> 1
                nodes = nodes[np.concatenate([[True], nodes[1:] != nodes[:-1]])]
                tree[nodes] = np.minimum(tree[2 * nodes], tree[2 * nodes + 1])
        return ids[ids >= 0].astype("<u4").tobytes()

    def _leaves(self, ids: np.ndarray, after: np.ndarray, at: np.ndarray) -> np.ndarray:
        left, right = ids[at].astype(np.int64), ids[after[at]].astype(np.int64)
        ranks = np.where((left >= 0) & (right >= 0), self.pairs.ranks(np.maximum(left, 0), np.maximum(right, 0)), -1)
        return np.where(ranks >= 0, ranks << 32 | at, NONE)

    def _refresh(self, tree, height, rows, at, ids, after, width):
        following = np.minimum(after[rows, at], width)
        right = ids[rows, following]
        ranks = np.where(right >= 0, self.pairs.ranks(ids[rows, at], np.maximum(right, 0)), -1)
        self._set(tree, height, rows, at, np.where(ranks >= 0, ranks << 32 | at, NONE))

    @staticmethod
    def _set(tree, height, rows, at, values):
        """Point update: the leaf and its ancestors."""
        node = at + (1 << height)
        tree[rows, node] = values
        for _ in range(height):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(text) for text in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        unseen = list({p for pieces in split for p in pieces if p not in memo})
        hard = []
        for piece in unseen:
            raw = piece.encode()
            rank = self.vocabulary.get(raw)
            if rank is None:
                hard.append((piece, raw))
            else:
                memo[piece] = rank.to_bytes(4, "little")
        for (piece, _), ids in zip(hard, self.merge([raw for _, raw in hard]), strict=True):
            memo[piece] = ids
        return [b"".join(map(memo.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary, pattern: str, key: str) -> Encoder:
    """The encoder of this Python worker; vocabulary is a broadcast of the rank file's bytes."""
    found = _encoders.get((key, pattern))
    if found is None:
        _encoders.clear()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.value.splitlines() if x.strip())}
        found = _encoders[key, pattern] = Encoder(ranks, pattern)
    return found


def broadcast_ranks(spark: SparkSession, path: str):
    """The rank file (under 1 MB for 50,000 tokens) as a broadcast, and a key that names its content."""
    with open(path, "rb") as file:
        data = file.read()
    return spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ids (array of int) and decoded (binary) to docs; columns of docs that have these names are replaced."""
    vocabulary, key = broadcast_ranks(docs.sparkSession, path)
    columns = [c for c in docs.columns if c not in (text, "ids", "decoded")] + [text]
    fields = [docs.schema[c].simpleString().split(":", 1) for c in columns]
    schema = ", ".join(f"`{a}` {b}" for a, b in fields) + ", ids array<int>, decoded binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern, key)
        for batch in batches:
            start = 0
            for *_, texts in row_chunks(batch, columns, 4 << 20):
                part = batch.slice(start, len(texts))
                start += len(texts)
                ids = enc.encode([t or "" for t in texts])
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<i4"))
                decoded = pa.array([enc.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, flat), decoded], [*columns, "ids", "decoded"])

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    vocabulary, key = broadcast_ranks(docs.sparkSession, path)
    columns = ["doc_id", "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern, key)
        for batch in batches:
            for doc_ids, texts in row_chunks(batch, columns, 4 << 20):
                ids = enc.encode([t or "" for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
