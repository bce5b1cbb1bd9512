"""Tables of a server's shards: each kind of row is one table, partitioned by the range point of its shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.placement import MAX_SHARDS, with_shard
from ..schema import KV_SCHEMA, SLICE_SCHEMA, XATTR_SCHEMA
from .stores import scratch

INODE_SCHEMA = (
    "name string, st_ino bigint, parentid_partid bigint, st_dev bigint, st_mode int, st_nlink bigint, st_uid int, st_gid int, st_rdev bigint, st_size bigint, st_blksize bigint, st_blocks bigint, "
    "st_atim timestamp_ntz, st_mtim timestamp_ntz, st_ctim timestamp_ntz, etag string, update_version bigint, primary_nodeid int, backup_nodeid int"
)
KINDS = {"inode": INODE_SCHEMA, "xattr": XATTR_SCHEMA, "slice": SLICE_SCHEMA, "kvmeta": KV_SCHEMA}
#: Kinds that are made and dropped together when a shard comes or goes.
MOVED = ("inode", "xattr")


def partitions(points: list[int]) -> str:
    return " ".join(f"PARTITION (range_point = {int(p)})" for p in points)


def create(spark: SparkSession, database: str, shard_map: DataFrame, server: int, kinds: tuple[str, ...] = tuple(KINDS)) -> None:
    """The database, in the shared folder, its tables, and in each a place for every shard of the server; what is there stays.
    A server has at most as many shards as a map (MAX_SHARDS), so their points come to the driver."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{scratch(spark, database)}'")
    points = [r.range_point for r in shard_map.filter(F.col("server_id") == server).select("range_point").limit(MAX_SHARDS).collect()]
    for kind in kinds:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{kind} ({KINDS[kind]}, range_point int) USING parquet PARTITIONED BY (range_point)")
        if points:
            spark.sql(f"ALTER TABLE {database}.{kind} ADD IF NOT EXISTS {partitions(points)}")


def create_at(spark: SparkSession, database: str, point: int) -> None:
    """Places for one shard's inodes and attributes; an error if they are there."""
    for kind in MOVED:
        spark.sql(f"ALTER TABLE {database}.{kind} ADD {partitions([point])}")


def drop_at(spark: SparkSession, database: str, point: int) -> None:
    """Drops one shard's inodes and attributes with their rows; an error if there are none."""
    for kind in MOVED:
        spark.sql(f"ALTER TABLE {database}.{kind} DROP {partitions([point])}")


def points_of(spark: SparkSession, database: str, kind: str) -> DataFrame:
    """range_point of the shards that a table has a place for."""
    return spark.sql(f"SHOW PARTITIONS {database}.{kind}").select(F.split("partition", "=")[1].cast("int").alias("range_point"))


def load(rows: DataFrame, database: str, kind: str, part, shard_map: DataFrame) -> DataFrame:
    """Writes the rows whose shard has a place in the table, and gives the others (range_point: the shard they belong to). Rows
    are rebalanced by shard: few files a shard, and a large shard is cut over tasks."""
    placed = with_shard(rows, part, shard_map).drop("server_id")
    here = F.broadcast(points_of(rows.sparkSession, database, kind))
    columns = rows.sparkSession.table(f"{database}.{kind}").columns
    placed.join(here, "range_point", "left_semi").select(*columns).hint("rebalance", "range_point").write.insertInto(f"{database}.{kind}")
    return placed.join(here, "range_point", "left_anti")
