"""Files as sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Where it is unset, local sessions get a
    temporary folder; on a cluster executors would not see one, so that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_treelake_scratch", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.sparkContext._treelake_scratch = tempfile.mkdtemp(prefix="spark-treelake-")
    return f"{found}/{name}"


def saved(rows: DataFrame, name: str) -> DataFrame:
    """rows as a Parquet table in the shared folder: later jobs neither recompute them nor need the executors that made them."""
    path = scratch(rows.sparkSession, f"{name}-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def cache_files(spark: SparkSession, folder: str) -> DataFrame:
    """file, size, atime, refs of all files under a folder, oldest first; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).drop("content")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("atime"), F.lit(0).alias("refs")).orderBy("atime", "file")


def json_copy(rows: DataFrame, path: str) -> DataFrame:
    """rows as JSON lines at path, read back with their own schema."""
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path).select(*rows.columns)


def partitioned_copy(rows: DataFrame, path: str, key: str, shards: int = 16) -> DataFrame:
    """rows in a Parquet table that is partitioned by shard (key modulo shards), read back; empty shards have no files."""
    sharded = rows.withColumn("shard_id", (F.pmod(F.col(key), F.lit(shards))).cast("int"))
    sharded.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
    return rows.sparkSession.read.schema(sharded.schema).parquet(path)
