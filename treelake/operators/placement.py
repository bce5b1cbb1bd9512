"""Shard maps: building, lookup, change and balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import PART_MASK, hash32

INT_MAX = (1 << 31) - 1
#: Number of partition values.
PARTS = PART_MASK + 1
#: A shard map is broadcast only up to this many shards.
MAX_SHARDS = 100_000


def build(spark: SparkSession, shards: int, workers: int) -> DataFrame:
    """range_point, server_id: equal ranges of the hash space, dealt to workers 1 to `workers` in turn."""
    i = F.col("id")
    point = F.when(i == shards - 1, F.lit(INT_MAX)).otherwise(F.expr(f"({INT_MAX}L * (id + 1)) div {shards}"))
    return spark.range(shards).select(point.cast("int").alias("range_point"), (i % workers + 1).cast("int").alias("server_id"))


def ranges(shard_map: DataFrame) -> DataFrame:
    """Adds range_min: one past the range before, 0 for the first. A map has one row a shard, so one task orders it."""
    return shard_map.withColumn("range_min", F.expr("coalesce(lag(range_point) over (order by range_point) + 1, 0)"))


def part_table(shard_map: DataFrame) -> DataFrame:
    """part, range_point, server_id for all PARTS partition values: the least range_point that is at least the part's hash.
    The values and at most MAX_SHARDS points are ordered together in one task."""
    points = shard_map.select(F.col("range_point").cast("long").alias("at"), F.lit(None).cast("int").alias("part"), F.struct("range_point", "server_id").alias("shard")).limit(MAX_SHARDS + 1)
    parts = shard_map.sparkSession.range(PARTS).select(hash32(F.col("id")).alias("at"), F.col("id").cast("int").alias("part"), F.lit(None).cast(points.schema["shard"].dataType).alias("shard"))
    # From the highest point down, so the point met last is the least one that is high enough.
    met = F.expr("last(shard, true) over (order by at desc, part nulls first rows between unbounded preceding and current row)")
    found = points.unionByName(parts).withColumn("met", met).withColumn("points", F.expr("count_if(part is null) over ()"))
    small = F.when(F.col("points") <= MAX_SHARDS, F.col("part")).otherwise(F.raise_error(F.lit("too many shards")))
    return found.filter("part is not null").select(small.alias("part"), "met.range_point", "met.server_id")


def with_shard(rows: DataFrame, part: Column, shard_map: DataFrame) -> DataFrame:
    """Adds range_point, server_id of the shard that holds the partition value; PARTS rows are broadcast, whatever the map."""
    table = part_table(shard_map).withColumnRenamed("part", "_table_part")
    return rows.withColumn("_part", part.cast("int")).join(F.broadcast(table), F.col("_part") == F.col("_table_part"), "left").drop("_part", "_table_part")


def renew(shard_map: DataFrame, servers: DataFrame) -> DataFrame:
    """range_min, range_max, host, port, server_id of every shard; server columns are null where the server is unknown."""
    rows = ranges(shard_map).withColumnRenamed("range_point", "range_max")
    return rows.join(F.broadcast(servers.select("server_id", "host", "port")), "server_id", "left").select("range_min", "range_max", "host", "port", "server_id")


def check(renewed: DataFrame) -> DataFrame:
    """One row: whether the ranges follow each other from 0 to the last value."""
    rows = renewed.withColumn("_due", F.expr("coalesce(lag(range_max) over (order by range_min) + 1, 0)"))
    return rows.agg(F.coalesce(F.bool_and(F.col("range_min") == F.col("_due")) & (F.max("range_max") == INT_MAX), F.lit(False)).alias("valid"))


def update_map(shard_map: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert of (range_points, server_ids) arrays of equal length."""
    flat = changes.select(F.explode(F.arrays_zip("range_points", "server_ids")).alias("z")).select(F.col("z.range_points").cast("int").alias("range_point"), F.col("z.server_ids").cast("int").alias("_new"))
    return shard_map.join(flat, "range_point", "full_outer").select("range_point", F.coalesce("_new", "server_id").alias("server_id"))


def move(shard_map: DataFrame, moves: DataFrame) -> DataFrame:
    """Gives shards (range_point) to other servers (to_server)."""
    return shard_map.join(moves.select("range_point", "to_server"), "range_point", "left").select("range_point", F.coalesce("to_server", "server_id").cast("int").alias("server_id"))


def rebalance(shard_map: DataFrame, targets: DataFrame) -> DataFrame:
    """range_point, from_server, to_server: the last shards of servers with more than ceil(shards / targets), or that are
    no targets, each to a free place of a target; places are filled a round of servers at a time."""
    sizes = shard_map.agg(F.count(F.lit(1)).alias("_all")).crossJoin(targets.agg(F.count(F.lit(1)).alias("_targets")))
    goal = sizes.select(F.expr("cast(ceil(_all / _targets) as int)").alias("goal"))
    rows = shard_map.join(targets.withColumn("_target", F.lit(True)), "server_id", "left").crossJoin(F.broadcast(goal))
    nth = rows.withColumn("_n", F.expr("row_number() over (partition by server_id order by range_point)"))
    excess = nth.filter(F.col("_target").isNull() | (F.col("_n") > F.col("goal"))).select("range_point", F.col("server_id").alias("from_server"))
    excess = excess.withColumn("_k", F.expr("row_number() over (order by from_server, range_point desc)"))
    held = shard_map.groupBy("server_id").agg(F.count(F.lit(1)).alias("_held"))
    free = targets.join(held, "server_id", "left").crossJoin(F.broadcast(goal)).withColumn("_held", F.coalesce("_held", F.lit(0)))
    places = free.filter("_held < goal").select(F.col("server_id").alias("to_server"), F.explode(F.expr("sequence(1, cast(goal - _held as int))")).alias("_round"))
    places = places.withColumn("_k", F.expr("row_number() over (order by _round, to_server)"))
    return excess.join(places, "_k").select("range_point", "from_server", "to_server")


def alloc_node(ids: DataFrame, column: Column, nodes: DataFrame) -> DataFrame:
    """Adds node_id: the node (by ascending id) that the unsigned 64-bit hash of the column falls on."""
    from ..functions.hashing import hash64, unsigned_mod

    ring = nodes.agg(F.array_sort(F.collect_list("node_id")).alias("_ring"))
    return ids.crossJoin(F.broadcast(ring)).withColumn("node_id", F.get("_ring", unsigned_mod(hash64(column), F.size("_ring")).cast("int"))).drop("_ring")


def next_nodes(nodes: DataFrame) -> DataFrame:
    """node_id, next_id: the successor by id, the first one after the last."""
    return nodes.select("node_id", F.expr("coalesce(lead(node_id) over (order by node_id), min(node_id) over ())").alias("next_id"))
