"""Exact top-k search by tiled matrix products.

Vectors become integers (floor of SCALE times each component). Repeated query rows are made one. Queries are dealt into
tiles by a hash of the whole row, candidates into shards at random places of the table, so that rows of one id or one
vector spread out; every (tile, shard) pair is one matrix product in one task, of which each query
keeps its k best. The partial lists are merged as a tree, FAN shards at a time, so no task sees more than FAN * k rows of
a query.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id. A query meets
candidates of its own dimension only, and no row of its own id. Repeated rows of an id are separate candidates; repeated
query rows share one result list. Components may be any finite doubles. Fewer candidates than k give all of them; an empty table gives an empty result. Extra
columns are not used. Scores are exact integers, held at 63 bits
where they would pass them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
K = 10
#: Queries of a tile and candidates of a shard. All candidates are sent once a tile and all queries once a shard, so larger
#: ones move less; a task holds one of each.
TILE = 8192
SHARD = 16_384
#: Columns of one matrix product; best() has room for so many beside the score.
PIECE = 1 << 16
FAN = 64
#: Scores beyond this count as this.
MOST = (1 << 63) - 1


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, vec (array of double), dim of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    good = F.forall("vec", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & good).withColumn("dim", F.size("vec"))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties to the smaller column."""
    n = scores.shape[1]
    k = min(k, n)
    if scores.dtype != object and np.abs(scores).max(initial=0) < 1 << 46:
        joint = scores.astype(np.int64) * (1 << 16) + np.arange(n - 1, -1, -1)
        part = np.argpartition(-joint, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(joint, part, 1), axis=1)
        return np.take_along_axis(part, order, 1)
    return np.array([sorted(range(n), key=lambda j: (-int(row[j]), j))[:k] for row in scores], np.int64).reshape(len(scores), k)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b, each component x being floor(SCALE * x): in float64 where no sum can reach
    2**53, else in Python integers, which also hold what SCALE takes beyond the largest double."""
    if a.shape[1] == 0:
        return np.zeros((len(a), len(b)))
    with np.errstate(over="ignore", invalid="ignore"):
        left, right = np.floor(a * SCALE), np.floor(b * SCALE)
        if np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * a.shape[1] < 2.0**53:
            return left @ right.T
    # A double of 2**53 or more is a whole number.
    one = lambda x: int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(x * SCALE))
    whole = lambda m: np.array([[one(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST)


def search_tile(queries: pd.DataFrame, shard: pd.DataFrame, k: int = K) -> pd.DataFrame:
    """The k best rows of a shard for each query, found in pieces of at most PIECE rows."""
    pieces = [search_piece(queries, shard.iloc[start : start + PIECE], k) for start in range(0, len(shard), PIECE)] or [search_piece(queries, shard, k)]
    if len(pieces) == 1:
        return pieces[0]
    both = pd.concat(pieces).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return both.groupby("query_id", sort=False).head(k).reset_index(drop=True)


def search_piece(queries: pd.DataFrame, shard: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(queries) and len(shard):
        shard = shard.sort_values("vec_id", kind="stable")
        ids = shard["vec_id"].to_numpy(np.int64)
        right = np.stack(shard["vec"].to_numpy())
        for start in range(0, len(queries), 128):
            part = queries.iloc[start : start + 128]
            left = np.stack(part["vec"].to_numpy())
            scores = product(left, right)
            own = part["vec_id"].to_numpy(np.int64)[:, None] == ids
            # Rows of the query's own id go behind all others.
            scores[own] = scores.min() - 1
            columns = best(scores, k)
            for row, query in enumerate(part["vec_id"].tolist()):
                chosen = [c for c in columns[row].tolist() if not own[row, c]]
                out += [(query, int(shard["shard"].iloc[0]), int(ids[c]), int(scores[row, c])) for c in chosen]
    return pd.DataFrame(out, columns=["query_id", "shard", "vec_id", "score"])


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of vectors for each row of queries."""
    asked, held = usable(queries, key, vector).dropDuplicates(["vec_id", "vec"]), usable(vectors, key, vector)
    n_asked, n_held = asked.count(), held.count()
    tiles, shards = max(1, -(-n_asked // TILE)), max(1, -(-n_held // SHARD))
    asked = asked.withColumn("tile", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(tiles)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = held.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    cell = ["tile", "shard", "dim"]
    lists = (
        asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInPandas(lambda q, s: search_tile(q, s, k), "query_id long, shard long, vec_id long, score long")
    )
    while True:
        shards = -(-shards // FAN)
        lists = lists.withColumn("shard", F.expr(f"shard div {FAN}"))
        lists = lists.withColumn("rank", F.expr("row_number() over (partition by query_id, shard order by score desc, vec_id)")).filter(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def search_every_hundredth(vectors: DataFrame) -> DataFrame:
    return top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors)
