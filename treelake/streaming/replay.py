"""An ordered log of requests, replayed on directories and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import lit_code, op
from ..sources.stores import scratch

DIRECTORIES = "dir string, made_at bigint"
FILES = "dir string, name string, present boolean"
RESULTS = "event_id bigint, opcode int, error_code int"
#: Every so many batches the whole state is written, and readers go no further back.
WHOLE = 16


def replay(directories: DataFrame, files: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results (event_id, opcode, error_code) of requests (event_id, opcode, dir, name), one after another by event_id, and the
    directories and files that they changed. Each request sees the effect of those before it.

    MKDIR makes dir (PATH_EXISTS if it is there), CREATE and UNLINK a file of it, any other opcode looks the file up. A file in
    a directory that isn't there yet is PATH_IS_INVALID. As directories stay, the first MKDIR dates them; what a request on a
    file meets is then the last CREATE or UNLINK of that file before it, or else the state before the log. Nothing is folded: one
    join on dir, one on the file, one window in the order of each file's requests.

    event_id is unique; a request without one comes first. Requests without dir or name are PATH_IS_INVALID."""
    makes = F.col("opcode") == op("MKDIR")
    first = requests.filter(makes & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.coalesce("event_id", F.lit(-1))).alias("_first"))
    made = first.join(directories, "dir", "full_outer").select("dir", F.when(F.col("made_at").isNotNull(), -2).otherwise(F.col("_first")).cast("long").alias("_made"), F.col("made_at").isNull().alias("_new"))
    at = F.coalesce("event_id", F.lit(-1))
    rows = requests.join(made, "dir", "left").join(files, ["dir", "name"], "left").withColumn("_there", F.coalesce((F.col("_made") < at) & F.col("name").isNotNull(), F.lit(False)))
    changes = F.when(F.col("_there") & F.col("opcode").isin(op("CREATE"), op("UNLINK")), F.col("opcode") == op("CREATE"))
    before = F.expr("last(_to, true) over (partition by dir, name order by event_id rows between unbounded preceding and 1 preceding)")
    rows = rows.withColumn("_to", changes).withColumn("_had", F.coalesce(before, "present", F.lit(False)))
    code = F.when(F.col("dir").isNull(), lit_code("PATH_IS_INVALID"))
    code = code.when(makes, F.when(F.col("_new") & (F.col("_made") == at), lit_code("SUCCESS")).otherwise(lit_code("PATH_EXISTS")))
    code = code.when(~F.col("_there"), lit_code("PATH_IS_INVALID")).when(F.col("opcode") == op("CREATE"), F.when(F.col("_had"), lit_code("FILE_EXISTS")).otherwise(lit_code("SUCCESS")))
    results = rows.select("event_id", "opcode", code.when(F.col("_had"), lit_code("SUCCESS")).otherwise(lit_code("FILE_NOT_EXISTS")).alias("error_code"))
    touched = rows.filter("_to is not null").groupBy("dir", "name").agg(F.max_by("_to", at).alias("present"))
    return results, made.filter("_new").select("dir", F.col("_made").alias("made_at")), touched


def replay_stream(requests: DataFrame) -> DataFrame:
    """Results of a stream of requests, in micro-batches. Each batch reads the state that those before it left in the shared
    folder and writes what it changed under its own number, so that a repeated batch gives the same. Batches come in order."""
    spark = requests.sparkSession
    path = scratch(spark, f"replay-{uuid.uuid4().hex}")

    def state(name: str, schema: str, key: list[str], value: str, batch: int) -> DataFrame:
        since = (batch - 1) // WHOLE * WHOLE
        folders = [f"{path}/{name}/batch={b}" for b in range(max(since, 0), batch)]
        if not folders:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{path}/{name}").parquet(*folders)
        return rows.groupBy(*key).agg(F.max_by(value, "batch").alias(value))

    def apply(rows: DataFrame, batch: int) -> None:
        directories = state("directories", DIRECTORIES, ["dir"], "made_at", batch)
        files = state("files", FILES, ["dir", "name"], "present", batch)
        results, made, touched = replay(directories, files, rows)
        if batch % WHOLE == 0:
            made = directories.union(made)
            touched = files.join(touched, ["dir", "name"], "left_anti").union(touched)
        for name, table in (("results", results), ("directories", made), ("files", touched)):
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")

    requests.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(apply).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{RESULTS}, batch bigint").parquet(f"{path}/results").drop("batch")
