"""Removal of repeats against brute force."""

import hashlib
import random

import numpy as np
import pytest

from treelake.llm import suffix, suffix_anchors, suffix_sort


def brute(rows, length=suffix.LENGTH):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            window = raw[k : k + length]
            if window in seen:
                gone[k : k + length] = b"\1" * length
            else:
                seen.add(window)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def synthetic():
    random.seed(1)
    base = "".join(random.choice("abcdefgh ") for _ in range(2000))
    piece = lambda: base[(a := random.randrange(1900)) : a + random.randrange(60, 400)] + "".join(random.choice("xyz") for _ in range(random.randrange(30)))
    rows = [(k, "".join(piece() for _ in range(random.randrange(6)))) for k in range(120)]
    return rows + [(1000, "a" * 500), (1001, "a" * 150), (1002, "ab" * 300), (1003, None), (1004, ""), (1005, "a" * 99), (1006, "é" * 120), (None, "ab" * 60)]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_brute_force(documents, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = synthetic()
    got = {r[0]: tuple(r[1:]) for r in suffix.removal_report(documents(rows).repartition(3)).collect()}
    assert got == brute(rows)


def test_small_chunks(documents, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 300)
    rows = synthetic()[:40]
    assert {r[0]: tuple(r[1:]) for r in suffix.removal_report(documents(rows)).collect()} == brute(rows)


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_ids(documents, parts):
    """Rows of one id with other texts keep their own bytes; repeated rows are one document."""
    random.seed(9)
    long = "".join(random.choice("abcdefghij") for _ in range(400))
    rows = [(1, long), (5, "short"), (5, long), (5, "other " + long[:150]), (7, "y" + long[200:]), (7, "y" + long[200:]), (None, long[50:300]), (None, "z")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.removal_report(documents(rows).repartition(parts)).collect()), key=str)
    # The row without an id comes first, so that its bytes are the earliest.
    inside = 250
    assert got == sorted([(1, 400, inside), (5, 5, 0), (5, 400, 400), (5, 156, 150), (7, 201, 200), (7, 201, 200), (None, 250, 0), (None, 1, 0)], key=str)


def test_odd_and_empty(odd, empty):
    got = suffix.removal_report(odd).collect()
    assert len(got) == 10 and sum(r.doc_id == 7 for r in got) == 2
    assert suffix.removal_report(empty).count() == 0
    kept = {r.doc_id: r.text for r in suffix.strip_repeats(odd).collect()}
    assert kept[4] == "one" and kept[1] == ""


def test_suffix_order():
    random.seed(3)
    for alphabet in ("ab", "abcdefgh"):
        data = np.frombuffer("".join(random.choice(alphabet) for _ in range(3000)).encode(), np.uint8)
        start = np.array(sorted(random.sample(range(2800), 400)))
        length = np.array([random.randrange(1, 100) for _ in start])
        group = np.sort(np.array([random.randrange(9) for _ in start]))
        order, shared = suffix_sort.neighbours(suffix_anchors.PrefixHash(data), data, start, length, group)
        raw = data.tobytes()
        texts = [(group[k], raw[start[k] : start[k] + length[k]]) for k in order]
        assert texts == sorted(texts)
        for k in range(1, len(order)):
            a, b = texts[k - 1], texts[k]
            both = 0 if a[0] != b[0] else next((i for i, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1])))
            assert shared[k] == both
