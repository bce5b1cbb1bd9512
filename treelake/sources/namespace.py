"""A namespace derived from the star schema: directories from regions, nations and customers, files from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..schema import DIR_MODE, FILE_MODE, INODE_COLUMNS, ROOT_ID


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ident(x: Column) -> Column:
    return F.shiftleft(x.cast("long"), 12)


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent_id, name, inodeid; the root is its own parent 0."""
    root = spark.range(1).select(F.lit(0).cast("long").alias("parent_id"), F.lit("/").alias("name"), F.lit(ROOT_ID).cast("long").alias("inodeid"))
    region = table(spark, sf_dir, "region").select(F.lit(ROOT_ID).cast("long"), F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))), ident(100 + F.col("r_regionkey")))
    nation = table(spark, sf_dir, "nation").select(ident(100 + F.col("n_regionkey")), F.lower("n_name"), ident(200 + F.col("n_nationkey")))
    customer = table(spark, sf_dir, "customer").select(ident(200 + F.col("c_nationkey")), F.concat(F.lit("c"), F.col("c_custkey").cast("string")), ident(1000 + F.col("c_custkey")))
    return root.union(region).union(nation).union(customer)


def nodes(spark: SparkSession, n: int = 4) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("node_id"))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice for every line item; offsets run on inside a chunk, ids over all rows in their order."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(
        ident(10_000_000 + F.col("l_orderkey")).alias("inodeid"),
        F.col("l_linenumber").cast("int").alias("chunkid"),
        (F.col("l_quantity").cast("int") * 4096).alias("slicesize"),
        F.col("l_suppkey").cast("int").alias("sliceloc1"),
        F.col("l_partkey").cast("int").alias("sliceloc2"),
        F.col("l_extendedprice").alias("price"),
    )
    order = ["slicesize", "sliceloc1", "sliceloc2", "price"]
    within = F.expr(f"sum(slicesize) over (partition by inodeid, chunkid order by {', '.join(order)} rows between unbounded preceding and current row) - slicesize")
    return rows.select(
        "inodeid", "chunkid", "slicesize", within.cast("int").alias("sliceoffset"), F.col("slicesize").alias("slicelen"), "sliceloc1", "sliceloc2",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inode rows of the files."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("int").cast("long") * 4096).alias("size"))
    rows = table(spark, sf_dir, "orders").join(sizes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    parent, name, ino = ident(1000 + F.col("o_custkey")), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), ident(10_000_000 + F.col("o_orderkey"))
    time = F.col("o_orderdate").cast("timestamp_ntz")
    return inode_rows(rows, parent, name, ino, FILE_MODE, 1, F.coalesce("size", F.lit(0)).cast("long"), (F.col("o_custkey") % 7).cast("int"), time, (H.unsigned_mod(H.hash64(ino), 4) + 1).cast("int"))


def inode_rows(rows, parent, name, ino, mode, nlink, size, uid, time, node) -> DataFrame:
    lit = lambda v, t: F.lit(v).cast(t)
    values = {
        "name": name, "st_ino": ino, "parentid_partid": H.combine(parent, H.part_id(name)), "st_dev": lit(0, "long"), "st_mode": lit(mode, "int"),
        "st_nlink": lit(nlink, "long"), "st_uid": uid, "st_gid": lit(0, "int"), "st_rdev": lit(0, "long"), "st_size": size, "st_blksize": lit(0, "long"),
        "st_blocks": lit(0, "long"), "st_atim": time, "st_mtim": time, "st_ctim": time, "etag": F.lit(""), "update_version": lit(0, "long"),
        "primary_nodeid": node, "backup_nodeid": lit(-1, "int"),
    }
    return rows.select(*[values[c].alias(c) for c in INODE_COLUMNS])


def inodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inode rows of files and directories."""
    dirs = directories(spark, sf_dir)
    epoch = F.lit("1992-01-01").cast("timestamp_ntz")
    lit = lambda v, t: F.lit(v).cast(t)
    rows = inode_rows(dirs.filter("parent_id <> 0"), F.col("parent_id"), F.col("name"), F.col("inodeid"), DIR_MODE, 2, lit(0, "long"), lit(0, "int"), epoch, lit(-1, "int"))
    return files(spark, sf_dir).unionByName(rows)


def file_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """req_id, path of every file, and of four odd paths."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = F.broadcast(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    text = lambda c: F.col(c).cast("string")
    path = F.concat(F.lit("/"), F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))), F.lit("/"), F.lower("n_name"), F.lit("/c"), text("c_custkey"), F.lit("/o"), text("o_orderkey"))
    odd = spark.createDataFrame([(-1, "/nope/x"), (-2, "/asia/missing"), (-3, "relative"), (-4, "/asia/"), (-5, "/")], "req_id long, path string")
    return rows.select(F.col("o_orderkey").cast("long").alias("req_id"), path.alias("path")).unionByName(odd)


def kv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    n = F.ceil(F.col("n_chars") / 2048).cast("int")
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    return docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("user_key"),
        F.col("n_chars").cast("int").alias("value_len"),
        n.cast("short").alias("slice_num"),
        F.transform(at, lambda i: F.col("doc_id") * 1000 + i).alias("value_key"),
        F.transform(at, lambda i: (i * 2048).cast("long")).alias("location"),
        F.transform(at, lambda i: F.least(F.lit(2048), (F.col("n_chars") - i * 2048).cast("int"))).alias("slice_len"),
    )


def xattrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    each = F.expr("stack(2, 'quality', cast(quality as string), 'toxic', cast(toxic as string)) as (xKey, xValue)")
    rows = table(spark, sf_dir, "labels").select("doc_id", each)
    return rows.select(H.combine(F.lit(ROOT_ID), H.part_id(name)).alias("parentid_partid"), name.alias("name"), "xKey", "xValue")


def servers(spark: SparkSession, workers: int = 4) -> DataFrame:
    i = F.col("id").cast("int")
    text = i.cast("string")
    return spark.range(0, workers + 1).select(
        i.alias("server_id"), F.when(i == 0, F.lit("cn")).otherwise(F.concat(F.lit("worker_"), text)).alias("server_name"), F.concat(F.lit("10.0.0."), text).alias("host"),
        (5520 + i).alias("port"), (i == 0).alias("is_local"), F.lit("admin").alias("user_name"),
    )


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts (UTC), client, opcode, latency_us."""
    kind = F.col("event_type")
    opcode = F.when(kind == "view", 6).when(kind == "click", 5).when(kind == "purchase", 4).when(kind == "signup", 1).otherwise(8)
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("client"), opcode.alias("opcode"), F.col("value").alias("latency_us"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, opcode, ts_ns: checkpoints of a request, some of them missing (0)."""
    rows = oplog(spark, sf_dir)
    k = F.col("event_id") % 6
    stamps = F.transform(F.sequence(F.lit(0).cast("long"), 8 + k), lambda g: F.when((F.col("event_id") + g) % 41 == 0, F.lit(0).cast("long")).otherwise(1 + g * 1000 + (F.col("event_id") * 7 + g * k) % 997))
    return rows.select("event_id", "opcode", stamps.alias("ts_ns"))


def cache_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inode, size, atime, refs of all files; every tenth is in use."""
    return files(spark, sf_dir).select(F.col("st_ino").alias("inode"), F.col("st_size").alias("size"), F.col("st_atim").alias("atime"), F.when((F.col("st_ino") / 4096).cast("long") % 10 == 0, 1).otherwise(0).alias("refs"))
