"""Tables by shard, and statements passed through."""

import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from treelake.functions import hashing as H
from treelake.operators import placement
from treelake.plans import passthrough
from treelake.sources import shards


def test_shard_tables(spark):
    base = f"shards_{uuid.uuid4().hex}"
    shard_map = placement.build(spark, 6, 2)
    mine = {r.range_point for r in shard_map.filter("server_id = 1").collect()}
    shards.create(spark, base, shard_map, 1)
    rows = spark.range(300).select(F.col("id").alias("parentid_partid"), F.concat(F.lit("n"), "id").alias("name"), F.lit("k").alias("xKey"), F.lit("v").alias("xValue"))
    others = shards.load(rows, base, "xattr", H.part_of(F.col("parentid_partid")), shard_map)
    kept = spark.table(f"{base}.xattr")
    assert kept.count() + others.count() == 300 and {r.range_point for r in kept.select("range_point").distinct().collect()} <= mine
    # Made again, the tables keep their rows.
    before = kept.count()
    shards.create(spark, base, shard_map, 1)
    assert spark.table(f"{base}.xattr").count() == before
    held = {r.range_point for r in shards.points_of(spark, base, "xattr").collect()}
    assert held == mine
    gone = max(mine, key=lambda p: kept.filter(F.col("range_point") == p).count())
    shards.drop_at(spark, base, gone)
    left = spark.table(f"{base}.xattr")
    assert 0 < left.count() < before and left.filter(F.col("range_point") == gone).count() == 0
    assert {r.range_point for r in shards.points_of(spark, base, "inode").collect()} == mine - {gone}
    assert {r.range_point for r in shards.points_of(spark, base, "slice").collect()} == mine
    with pytest.raises(PySparkException):
        shards.drop_at(spark, base, gone)
    shards.create_at(spark, base, gone)
    assert spark.table(f"{base}.xattr").filter(F.col("range_point") == gone).count() == 0
    with pytest.raises(PySparkException):
        shards.create_at(spark, base, gone)


def test_server_without_shards(spark):
    base = f"shards_{uuid.uuid4().hex}"
    shards.create(spark, base, placement.build(spark, 4, 2), 9)
    assert shards.points_of(spark, base, "kvmeta").count() == 0


def test_several_statements_fail(spark):
    sf = "/root/testdata/sf0.001"
    assert passthrough.plain_command(spark, sf, "SELECT 1 AS a, CAST(NULL AS int) AS b").collect() == [("1", None)]
    with pytest.raises(PySparkException):
        passthrough.plain_command(spark, sf, "SELECT 1; SELECT 2")
