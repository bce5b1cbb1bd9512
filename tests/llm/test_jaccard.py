"""Link components against brute force."""

import random
import re

import numpy as np
import pytest

from treelake.llm import jaccard
from treelake.llm.common import join_unique
from treelake.llm.components import components


def brute(rows, n, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        k = min(n, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    part = {d: d for d, _ in rows}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = sorted((top(a), top(b)))
                part[y] = x
    return {(d, len(s), top(d)) for (d, _), s in zip(rows, sets, strict=True)}


def family(seed, n=60):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    base = [[random.choice(vocabulary) for _ in range(random.randrange(20, 120))] for _ in range(6)]
    rows = []
    for k in range(n):
        words = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 4])):
            words[random.randrange(len(words))] = random.choice(vocabulary).upper()
        rows.append((k, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a b c d")]


@pytest.mark.parametrize(("block", "n", "percent"), [(8192, 4, 85), (3, 4, 85), (8192, 5, 80)])
def test_brute_force(documents, monkeypatch, block, n, percent):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = family(7)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(documents(rows), n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_odd_and_empty(odd, empty):
    got = jaccard.link_components(odd).collect()
    assert len(got) == 10
    by = {r.doc_id: r.component_id for r in got}
    assert by[6] == 5 and by[1] == 1 and by[2] == 2
    assert jaccard.link_components(empty).count() == 0


def test_one_of_each(odd):
    kept = jaccard.keep_one_of_each(odd)
    assert kept.schema == odd.schema
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 9]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_repeated_and_null_ids(documents, parts):
    """Rows are documents of their own, whatever their ids: ids that come twice with other texts, and none at all."""
    one, other = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, one), (5, other), (9, one + " more"), (3, other + " more"), (None, one + " less"), (None, "alone and without an id"), (None, None)]
    got = jaccard.link_components(documents(rows).repartition(parts))
    # One is 57 shingles, its near copies 58; 57 of 58 are shared.
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == sorted(
        [(5, 57, 5), (5, 57, 3), (9, 58, 5), (3, 58, 3), (None, 58, 5), (None, 2, None), (None, 0, None)], key=str
    )
    kept = jaccard.keep_one_of_each(documents(rows).repartition(parts))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(5, one), (3, other + " more"), (None, "alone and without an id"), (None, None)], key=str
    )


def test_partners_and_signatures():
    """An entry is dropped only where no other can pass; folded signatures never lie further apart than the sets."""
    random.seed(3)
    for _ in range(50):
        rows = sorted((random.randrange(3), random.randrange(1, 60), random.randrange(8)) for _ in range(40))
        group, size, place = (np.array(c) for c in zip(*rows, strict=True))
        place = np.minimum(place, size - 1)
        met = jaccard.has_partner(group, size, place, 80)
        for i in range(40):
            able = any(
                j != i and group[j] == group[i] and 100 * min(size[i], size[j]) >= 80 * max(size[i], size[j])
                and min(size[i] - place[i], size[j] - place[j]) >= jaccard.least_overlap(size[i], size[j], 80)
                for j in range(40)
            )
            assert met[i] == able
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (3, 60, 64, 65, 120, 129, 4000)]
    packed = jaccard.unpacked([jaccard.signature(s, jaccard.signature_bits(len(s))) for s in sets])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            apart = jaccard.bits_apart(np.array([i]), np.array([j]), packed)[0]
            assert apart <= len(np.setxor1d(a, b))


def test_hot_keys(spark):
    left = spark.createDataFrame([(k % 7 if k % 3 else None, k) for k in range(300)] + [(1, k) for k in range(200)], "k long, v long")
    right = spark.createDataFrame([(k, -k) for k in range(5)], "k long, w long")
    want = sorted(map(str, left.join(right, "k", "left").collect()))
    assert sorted(map(str, join_unique(left, right, "k", 100).collect())) == want == sorted(map(str, join_unique(left, right, "k").collect()))


def test_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 200), (7, 7)], "a long, b long")
    got = dict(tuple(r) for r in components(edges).collect())
    assert all(got[k] == 1 for k in range(1, 41)) and got[200] == 100


def test_join_unique_keeps_rows_of_common_keys_without_match(spark):
    """A key with many rows that the other side lacks keeps its rows, as in a plain left join, whatever the limit."""
    left = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 9), ("c", 10), (None, 11), (None, 12), (None, 13)], "k string, x int")
    right = spark.createDataFrame([("b", 1), ("d", 2)], "k string, y int")
    plain = sorted(map(str, left.join(right, "k", "left").collect()))
    assert len(plain) == 14
    for many in (1, 2, 8, 9, 100):
        assert sorted(map(str, join_unique(left, right, "k", many).collect())) == plain
