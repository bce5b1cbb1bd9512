"""Key-value, slice and id operators, and general row changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import lit_code

KV_COLUMNS = ["user_key", "value_len", "slice_num", "value_key", "location", "slice_len"]
SLICE_COLUMNS = ["inodeid", "chunkid", "sliceid", "slicesize", "sliceoffset", "slicelen", "sliceloc1", "sliceloc2"]


def kv_put(requests: DataFrame, kv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert where absent; a key that is there keeps its value and the request succeeds. Of several requests for a key the
    first by req_id counts."""
    first = requests.withColumn("_n", F.expr("row_number() over (partition by user_key order by req_id)")).filter("_n = 1")
    fresh = first.join(kv.select("user_key"), "user_key", "left_anti").select(*KV_COLUMNS)
    return requests.select("req_id", lit_code("SUCCESS").alias("error_code")), kv.select(*KV_COLUMNS).unionByName(fresh)


def kv_get(requests: DataFrame, kv: DataFrame) -> DataFrame:
    rows = requests.select("req_id", "user_key").join(kv.withColumn("_hit", F.lit(True)), "user_key", "left")
    return rows.select("req_id", F.when(F.col("_hit"), lit_code("SUCCESS")).otherwise(lit_code("ARGUMENT_ERROR")).alias("error_code"), *KV_COLUMNS[1:])


def kv_delete(requests: DataFrame, kv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A second delete of a key misses."""
    rows = requests.join(kv.select("user_key", F.lit(True).alias("_hit")), "user_key", "left")
    turn = F.expr("row_number() over (partition by user_key order by req_id)")
    code = F.when(F.col("_hit") & (turn == 1), lit_code("SUCCESS")).otherwise(lit_code("ARGUMENT_ERROR"))
    return rows.select("req_id", code.alias("error_code")), kv.join(requests.select("user_key"), "user_key", "left_anti").select(*KV_COLUMNS)


def slice_put(requests: DataFrame) -> DataFrame:
    """Rows of requests that hold parallel arrays; nothing is unique."""
    return requests.select("req_id", F.inline(F.arrays_zip(*SLICE_COLUMNS)))


def slice_get(requests: DataFrame, slices: DataFrame) -> DataFrame:
    """All slices of (inodeid, chunkid) as parallel arrays in order of offset; none is FILE_NOT_EXISTS."""
    entry = F.struct("sliceoffset", "slicesize", "slicelen", "sliceloc1", "sliceloc2")
    held = slices.join(requests.select("inodeid", "chunkid").distinct(), ["inodeid", "chunkid"], "left_semi").groupBy("inodeid", "chunkid").agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    rows = requests.select("req_id", "inodeid", "chunkid").join(held, ["inodeid", "chunkid"], "left")
    code = F.when(F.col("_s").isNull(), lit_code("FILE_NOT_EXISTS")).otherwise(lit_code("SUCCESS"))
    return rows.select("req_id", code.alias("error_code"), *[F.col(f"_s.{c}").alias(c) for c in ("sliceoffset", "slicesize", "slicelen", "sliceloc1", "sliceloc2")])


def slice_delete(requests: DataFrame, slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes all slices of (inodeid, chunkid); none is a success too."""
    return requests.select("req_id", lit_code("SUCCESS").alias("error_code")), slices.join(requests.select("inodeid", "chunkid"), ["inodeid", "chunkid"], "left_anti")


def reserve_ids(requests: DataFrame, start: int = 0) -> DataFrame:
    """req_id, first, last of disjoint ranges [first, last): per kind, in order of req_id. Kinds are summed in blocks of
    req_id first, so no task orders all requests of a kind."""
    blocked = requests.withColumn("_block", F.floor(F.col("req_id") / 4096).cast("long"))
    sums = blocked.groupBy("kind", "_block").agg(F.sum("count").alias("_sum"))
    before = sums.withColumn("_before", F.expr("sum(_sum) over (partition by kind order by _block) - _sum")).drop("_sum")
    inside = blocked.withColumn("_inside", F.expr("sum(count) over (partition by kind, _block order by req_id rows between unbounded preceding and current row)"))
    rows = inside.join(before, ["kind", "_block"])
    last = F.lit(start) + F.col("_before") + F.col("_inside")
    return rows.select("req_id", "kind", (last - F.col("count")).cast("long").alias("first"), last.cast("long").alias("last"))


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on), on, "left_anti").select(*table.columns)


def update(table: DataFrame, changes: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Column-mask update: a null in changes leaves the old value."""
    new = changes.select(*on, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(new, on, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def upsert(table: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    return delete(table, rows, on).unionByName(rows.select(*table.columns))


def truncate(table: DataFrame) -> DataFrame:
    """The table's columns without rows."""
    return table.limit(0)


def batch_runs(requests: DataFrame, order: str, kind: str, alone: Column) -> DataFrame:
    """Adds run: the number of a stretch of requests of one kind; those for which alone holds stand by themselves. Runs
    are counted per client, which bounds what one task orders."""
    starts = F.when(alone | F.expr(f"not ({kind} <=> lag({kind}) over (partition by client order by {order}))"), 1).otherwise(0)
    return requests.withColumn("_s", starts).withColumn("run", F.expr(f"sum(_s) over (partition by client order by {order} rows between unbounded preceding and current row)")).drop("_s")


def batches(requests: DataFrame, kind: str, order: str, size: int) -> DataFrame:
    """Adds batch: requests of one kind in order, `size` at a time; kinds are numbered in ranges of order, offset by the
    counts before."""
    blocked = requests.withColumn("_block", F.floor(F.col(order) / 65_536).cast("long"))
    counts = blocked.groupBy(kind, "_block").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.expr(f"sum(_c) over (partition by {kind} order by _block) - _c")).drop("_c")
    nth = blocked.withColumn("_n", F.expr(f"row_number() over (partition by {kind}, _block order by {order})")).join(counts, [kind, "_block"])
    return nth.withColumn("batch", F.floor((F.col("_n") + F.col("_before") - 1) / size).cast("long")).drop("_n", "_before", "_block")
