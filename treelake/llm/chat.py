"""Chat formatting by token-level assembly.

A turn is ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. The three marks are reserved ids beyond the vocabulary; role and
text are encoded by themselves, so no mark can arise from content. As readers may split the written form on control
strings, content that looks like one is escaped: a backslash goes after its first character (one more where such
backslashes stand already), which is undone exactly. The loss mask comes from prefix sums over the lengths of a turn's
segments and covers the text of assistant turns; each turn also has its place among its conversation's tokens.

Rows of a conversation are ordered by turn (nulls first), then role, then text; repeated rows stay. A null role or text is
empty, and null conv_ids make one conversation. An empty table gives an empty result. Extra columns are not used.
Conversations are read as sorted streams, never gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import broadcast_ranks, encoder
from .common import row_chunks

TURN, TEXT, END = 50_257, 50_258, 50_259
MARKS = {TURN: "<|turn|>", TEXT: "<|text|>", END: "<|end|>"}
CONTROL = re.compile(r"([<\[])(\\*)(\|turn\|>|\|text\|>|\|end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(\|turn\|>|\|text\|>|\|end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)")
LEARNED = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def splice(role_ids: bytes, text_ids: bytes, learned: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of a turn."""
    parts = [np.array([TURN], "<i4"), np.frombuffer(role_ids, "<i4"), np.array([TEXT], "<i4"), np.frombuffer(text_ids, "<i4"), np.array([END], "<i4")]
    ends = np.cumsum([len(p) for p in parts])
    steps = np.zeros(int(ends[-1]) + 1, np.int8)
    if learned:
        steps[ends[2]] += 1
        steps[ends[3]] -= 1
    return np.concatenate(parts), np.cumsum(steps[:-1], dtype=np.int8)


def format_turns(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, turn, role, text, ids, mask of every row."""
    vocabulary, key = broadcast_ranks(conversations.sparkSession, path)
    columns = ["conv_id", "turn", "role", "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern, key)
        for batch in batches:
            start = 0
            for _, _, roles, texts in row_chunks(batch, columns, 4 << 20):
                part = batch.slice(start, len(texts))
                start += len(texts)
                role_ids = enc.encode([escape(r) for r in roles])
                text_ids = enc.encode([escape(t) for t in texts])
                made = [splice(a, b, r == LEARNED) for a, b, r in zip(role_ids, text_ids, roles, strict=True)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i, _ in made])]).astype("<i4"))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in made]))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*columns, "ids", "mask"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, ids array<int>, mask array<tinyint>")


def assemble(turns: DataFrame) -> DataFrame:
    """conv_id, first_token, ids, mask: the turns of each conversation in order, with the place of their first token among
    the conversation's (the prefix sum of the turns before). A conversation's rows follow each other in one partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, at = object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            places = []
            lengths = batch.column("ids").value_lengths().to_pylist()
            for conv, length in zip(batch.column("conv_id").to_pylist(), lengths, strict=True):
                at = at if conv == before else 0
                places.append(at)
                before, at = conv, at + length
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(places, pa.int64()), batch.column("ids"), batch.column("mask")], ["conv_id", "first_token", "ids", "mask"])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(run, "conv_id long, first_token long, ids array<int>, mask array<tinyint>")


def read_back(assembled: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of each conversation, from ids and masks alone."""
    vocabulary, key = broadcast_ranks(assembled.sparkSession, path)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern, key)
        text = lambda ids: enc.decode(ids.astype("<u4").tobytes()).decode()
        open_: list | None = None
        for batch in batches:
            done = []
            for conv, ids, mask in zip(*(batch.column(c) for c in ("conv_id", "ids", "mask")), strict=True):
                conv, ids, mask = conv.as_py(), ids.values.to_numpy(), mask.values.to_numpy()
                if open_ is None or open_[0] != conv:
                    if open_ is not None:
                        done.append(open_)
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                middle = int(np.flatnonzero(ids == TEXT)[0])
                role, content = text(ids[1:middle]), text(ids[middle + 1 : -1])
                learned = unescape(text(ids[mask == 1]))
                open_[1] += 1
                open_[2].update(f"{unescape(role)}\n{unescape(content)}\n".encode())
                open_[3] += len(learned)
                open_[4].update(learned.encode())
                open_[5] += len(role) + len(content) + sum(len(MARKS[i]) for i in (TURN, TEXT, END))
            if done:
                yield rows(done)
        if open_ is not None:
            yield rows([open_])

    def rows(found: list) -> pa.RecordBatch:
        plain = [[c, n, a.hexdigest(), m, b.hexdigest(), f] for c, n, a, m, b, f in found]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*plain, strict=True), kinds, strict=True)], names)

    return assembled.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def written(ids: np.ndarray, decode) -> str:
    """The written form of a turn's ids."""
    middle = int(np.flatnonzero(ids == TEXT)[0])
    return MARKS[TURN] + decode(ids[1:middle]) + MARKS[TEXT] + decode(ids[middle + 1 : -1]) + MARKS[END]


def chat_digests(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    return read_back(assemble(format_turns(conversations, path, pattern)), path, pattern)
