"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java-regex form of a word: anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, local sessions (tests) get a
    temporary one; on a cluster executors would not see it, so that is an error."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = getattr(spark.sparkContext, "_treelake_shared", None)
        if found is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="spark-treelake-")
            spark.sparkContext._treelake_shared = found
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns a frame over those files, so that later jobs neither
    recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_unique(left: DataFrame, right: DataFrame, key: str, many: int = 1 << 16) -> DataFrame:
    """left joined (left outer) with right, whose keys are unique. Keys that more than ``many`` rows of left have, which are at
    most rows / many, are joined by broadcast, so that none of them fills one task."""
    hot = left.groupBy(key).count().filter((F.col("count") > many) & F.col(key).isNotNull()).select(key)
    found = right.join(F.broadcast(hot), key, "left_semi")
    # A key that right lacks has a row here too: its rows of left stay, with nulls.
    few = F.broadcast(hot.join(F.broadcast(found), key, "left"))
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
    return rest.unionByName(left.join(few, key))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(col: Column) -> Column:
    """Content address of a text: its SHA-256 in hexadecimal digits."""
    return F.sha2(col.cast("binary"), 256)


def row_chunks(batch, columns: list[str], max_bytes: int = 8 << 20, text_column: str | None = None):
    """Cuts an Arrow batch into lists of columns of at most max_bytes of text (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    text = batch.column(columns.index(text_column) if text_column else len(columns) - 1)
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > max_bytes:
            part = batch.slice(start, i - start)
            yield [part.column(k).to_pylist() for k in range(len(columns))]
            start, total = i, 0
        total += size
    part = batch.slice(start)
    yield [part.column(k).to_pylist() for k in range(len(columns))]
