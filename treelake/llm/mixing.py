"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern (the set of their sources); tokens
flow from patterns to sources with a quota each, and the k-th pass over a pattern costs more than the one before it
(convex repetition costs), so the cheapest flow that fills the quotas repeats as little as possible. The flow network has
one node a pattern and one a source, whatever the number of documents. A pattern whose flow is r whole passes and a rest
takes every document r times, and once more the documents that come first by a seeded hash until the rest is filled.

The rest is cut without ordering a pattern in one task: hash ranges are summed, the range in which the rest ends is found,
and only its documents (a few thousand) are walked in hash order, each being taken if it still fits.

Null texts have size 0; a null source is a source of its own and comes last. Repeated rows count as often as they occur.
An empty table gives an empty result. Extra columns are kept by ``mix_documents``.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
SEED = 20_231
#: Documents that a hash range holds, about.
RANGE_ROWS = 2048
#: More sources or patterns than this are refused, as the flow network is solved in one place.
MAX_NODES = 20_000


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quotas(sizes: dict, weights=WEIGHTS, cap: int = MAX_PASSES) -> dict:
    """Targets of the sources (by code point, null last): shares of the total by weight, none above cap times its size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, held, free = float(sum(sizes.values())), {}, set(order)
    while free:
        rest, shares = total - sum(held.values()), sum(weight[s] for s in free)
        above = {s for s in free if rest * weight[s] / shares > cap * sizes[s]}
        if not above:
            return held | {s: rest * weight[s] / shares for s in free}
        held |= {s: float(cap * sizes[s]) for s in above}
        free -= above
    return held


def parts_of(patterns) -> list[list[tuple]]:
    """The patterns in sets that share no source, each of which is a flow problem of its own."""
    top: dict = {}

    def find(s):
        while top[s] != s:
            top[s] = top[top[s]]
            s = top[s]
        return s

    key = lambda s: (s is None, s or "")
    for p in patterns:
        names = [key(s) for s in p]
        for s in names:
            top.setdefault(s, s)
        for s in names[1:]:
            top[find(s)] = find(names[0])
    parts: dict = {}
    for p in patterns:
        parts.setdefault(find(key(p[0])) if p else None, []).append(p)
    return list(parts.values())


def routed(capacity: dict[tuple, int], quota: dict, passes: int) -> dict[tuple, dict]:
    """pattern -> source -> tokens, of the cheapest flow, found for each set of entangled sources by itself."""
    flow: dict[tuple, dict] = {}
    for part in parts_of(capacity):
        sources = {s for p in part for s in p}
        flow |= min_cost_flow({p: capacity[p] for p in part}, {s: quota[s] for s in quota if s in sources}, passes)
    return flow


def min_cost_flow(capacity: dict[tuple, int], quota: dict, passes: int = MAX_PASSES) -> dict[tuple, dict]:
    """pattern -> source -> tokens. Successive cheapest augmenting paths; pass k of a pattern costs k * k a token."""
    patterns, sources = list(capacity), list(quota)
    start, end = 0, 1
    node = {("p", p): 2 + i for i, p in enumerate(patterns)} | {("s", s): 2 + len(patterns) + i for i, s in enumerate(sources)}
    arcs: list[list[float]] = []
    out: list[list[int]] = [[] for _ in range(2 + len(node))]

    def arc(a: int, b: int, room: float, cost: float) -> None:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    for p in patterns:
        for k in range(passes):
            arc(start, node["p", p], capacity[p], k * k)
    between = {}
    for p in patterns:
        for s in set(p):
            if s in quota:
                between[p, s] = len(arcs)
                arc(node["p", p], node["s", s], passes * capacity[p], 0)
    for s in sources:
        arc(node["s", s], end, quota[s], 0)
    height = [0.0] * len(out)
    while True:
        far, via, heap = [float("inf")] * len(out), [-1] * len(out), [(0.0, start)]
        far[start] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for i in out[a]:
                b, room, cost = arcs[i]
                if room > 0 and (e := d + cost + height[a] - height[b]) < far[b]:
                    far[b], via[b] = e, i
                    heapq.heappush(heap, (e, b))
        if far[end] == float("inf"):
            break
        height = [h + min(d, far[end]) for h, d in zip(height, far, strict=True)]
        push, at = float("inf"), end
        while at != start:
            push, at = min(push, arcs[via[at]][1]), arcs[via[at] ^ 1][0]
        at = end
        while at != start:
            arcs[via[at]][1] -= push
            arcs[via[at] ^ 1][1] += push
            at = arcs[via[at] ^ 1][0]
    flow: dict[tuple, dict] = {p: {} for p in patterns}
    for (p, s), i in between.items():
        flow[p][s] = arcs[i ^ 1][1]
    return flow


def fill(sizes: np.ndarray, room: int) -> np.ndarray:
    """Which of the documents, in their order, are taken to fill the room: each that still fits, then a few exchanges of
    a taken one for a larger one (or for none taken) that bring the sum nearer to it."""
    taken = np.zeros(len(sizes), bool)
    for k, size in enumerate(sizes.tolist()):
        if 0 < size <= room:
            taken[k] = True
            room -= size
    for _ in range(4):
        out = np.flatnonzero(~taken & (sizes > 0))
        if not room or not len(out):
            break
        inside = np.concatenate([[-1], np.flatnonzero(taken)])
        given = np.where(inside < 0, 0, sizes[inside])
        order = out[np.argsort(sizes[out], kind="stable")]
        at = np.searchsorted(sizes[order], given + room, "right") - 1
        gain = np.where(at >= 0, sizes[order[np.maximum(at, 0)]] - given, 0)
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            break
        if inside[best] >= 0:
            taken[inside[best]] = False
        taken[order[at[best]]] = True
        room -= int(gain[best])
    return taken


def plan(narrow: DataFrame, weights=WEIGHTS, passes: int = MAX_PASSES) -> tuple[DataFrame, dict, dict]:
    """narrow: pattern (array of sources), size, draw (seeded hash), once for every document. Returns narrow with copies,
    and size and target of every source."""
    spark = narrow.sparkSession
    sums = narrow.groupBy("pattern").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_NODES + 1).collect()
    if len(sums) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} membership patterns")
    capacity = {tuple(r.pattern): r["size"] for r in sums}
    sizes: dict = {}
    for p, size in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    target = quotas(sizes, weights, passes)
    # A document of several sources can fill one quota at a time, so what the patterns hold bounds the flow, not the sizes.
    flow = routed(capacity, {s: round(t) for s, t in target.items()}, passes)
    orders = []
    for r in sums:
        p, size = tuple(r.pattern), r["size"]
        want = int(sum(flow[p].values()))
        whole = min(passes, want // size) if size else 0
        rest = want - whole * size if whole < passes else 0
        bits = max(0, min(20, (r.n // RANGE_ROWS).bit_length()))
        orders.append((list(p), int(whole), int(rest), bits))
    schema = "pattern array<string>, whole int, rest long, bits int"
    table = F.broadcast(spark.createDataFrame(orders, schema))
    ranged = narrow.join(table, "pattern").withColumn("range", F.expr("shiftrightunsigned(draw, 44) >> (20 - bits)").cast("long"))
    # Sums of hash ranges, at most about rows / RANGE_ROWS of them, and the range where each rest ends.
    summed = ranged.filter("rest > 0").groupBy("pattern", "range", "rest").agg(F.sum("size").alias("in_range"))
    running = summed.withColumn("upto", F.expr("sum(in_range) over (partition by pattern order by range)"))
    cut = running.filter("upto >= rest and upto - in_range < rest").select("pattern", F.col("range").alias("cut"), (F.col("rest") - F.col("upto") + F.col("in_range")).alias("room"))
    cut_rows = cut.limit(MAX_NODES + 1).collect()
    cuts = F.broadcast(spark.createDataFrame([tuple(r) for r in cut_rows], "pattern array<string>, cut long, room long"))
    joined = ranged.join(cuts, "pattern", "left")
    at_cut = F.coalesce(F.col("range") == F.col("cut"), F.lit(False))
    sure = joined.filter(~at_cut).withColumn("copies", F.col("whole") + F.coalesce((F.col("range") < F.col("cut")).cast("int"), F.lit(0)))
    names = [c for c in narrow.columns]
    fields = [f for f in joined.schema.fields if f.name in (*names, "whole", "room")]

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["draw", "size", *[n for n in names if n not in ("draw", "size", "pattern")]])
        taken = fill(part["size"].to_numpy(np.int64), int(part["room"].iloc[0]))
        return part.assign(copies=part["whole"] + taken.astype("int32"))[[*names, "copies"]]

    schema = ", ".join(f"`{n}` {narrow.schema[n].dataType.simpleString()}" for n in names) + ", copies int"
    edge = joined.filter(at_cut).select(*[f.name for f in fields]).groupBy("pattern").applyInPandas(walk, schema)
    return sure.select(*names, "copies").unionByName(edge), sizes, target


def draw(seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), text_or_empty())


def mix_report(docs: DataFrame, weights=WEIGHTS, passes: int = MAX_PASSES, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, text, source)."""
    narrow = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array(F.col("source").cast("string")).alias("pattern"), n_words(text_or_empty()).alias("size"), draw(seed).alias("draw")), "mix")
    chosen, sizes, target = plan(narrow, weights, passes)
    spark = docs.sparkSession
    facts = F.broadcast(spark.createDataFrame([([s], int(sizes[s]), float(target[s])) for s in sizes], "pattern array<string>, source_size long, target double"))
    return chosen.join(facts, "pattern").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, passes: int = MAX_PASSES, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its own columns."""
    tag = uuid.uuid4().hex[:12]
    narrow = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array(F.col("source").cast("string")).alias("pattern"), n_words(text_or_empty()).alias("size"), draw(seed).alias("draw")), "mix")
    chosen, _, _ = plan(narrow, weights, passes)
    # Rows of one doc_id and text share a draw; those taken are told apart by how many of them are taken how often.
    times = chosen.filter("copies > 0").groupBy("draw", "pattern").agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("n"))
    keyed = docs.withColumn(f"d{tag}", draw(seed)).withColumn(f"p{tag}", F.array(F.col("source").cast("string")))
    marked = keyed.join(times.select(F.col("draw").alias(f"d{tag}"), F.col("pattern").alias(f"p{tag}"), F.col("copies").alias(f"c{tag}"), F.col("n").alias(f"n{tag}")), [f"d{tag}", f"p{tag}"])
    # The join leaves rows of one draw together, so numbering them moves nothing.
    nth = F.expr(f"row_number() over (partition by d{tag}, p{tag} order by d{tag})")
    rows = marked.withColumn(f"t{tag}", F.expr(f"cast(c{tag} div n{tag} as int)") + (nth <= F.expr(f"c{tag} % n{tag}")).cast("int")).filter(F.col(f"t{tag}") > 0)
    return rows.withColumn(f"k{tag}", F.explode(F.sequence(F.lit(1), F.col(f"t{tag}")))).select(*docs.columns)
