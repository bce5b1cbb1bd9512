"""Windows over the operation log, as streams and batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stores import scratch


def log_columns(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    opcode = F.when(kind == "view", 6).when(kind == "click", 5).when(kind == "purchase", 4).when(kind == "signup", 1).otherwise(8)
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("client"), opcode.alias("opcode"))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return log_columns(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet"))


def tumbling(log: DataFrame, length: str) -> DataFrame:
    """Counts per window and opcode; rows that are more than an hour late are dropped with their window's state."""
    rows = log.withWatermark("ts", "1 hour").groupBy(F.window("ts", length), "opcode").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    return rows.select(F.col("window.start").alias("start"), "opcode", "n", "last")


def first_of_each(log: DataFrame) -> DataFrame:
    """The first event of each client and opcode; later ones change nothing."""
    return log.groupBy("client", "opcode").agg(F.min("event_id").alias("first"))


def run(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs an aggregating stream over what is there now, in update mode, so that the watermark ends the state of old windows.
    Each batch writes the rows it changed to the shared folder (again, if it is repeated); of each key the last row counts."""
    spark = stream.sparkSession
    path = scratch(spark, f"stream-{uuid.uuid4().hex}")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    started = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start()
    started.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rest = [c for c in stream.columns if c not in keys]
    last = spark.read.schema(schema).parquet(f"{path}/out").groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in stream.columns])


def micro_batches(log: DataFrame) -> DataFrame:
    """Each micro-batch summed by itself, the sums added up."""
    spark = log.sparkSession
    path = scratch(spark, f"batches-{uuid.uuid4().hex}")

    def write(rows: DataFrame, batch: int) -> None:
        sums = rows.groupBy("opcode").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))
        sums.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    log.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("opcode").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def rates(log: DataFrame, length: str, seconds: int) -> DataFrame:
    """Operations of each window, the change from the one before, and the rate; windows are few."""
    counts = log.groupBy(F.window("ts", length).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
    return counts.select("start", "n", F.expr("n - coalesce(lag(n) over (order by start), 0)").alias("change"), (F.col("n") / seconds).alias("per_second"))


#: Numbers of events in a block of a client's log.
HANDLE_BLOCK = 1 << 16


def open_handles(log: DataFrame, opened: int, closed: int) -> DataFrame:
    """Opens of a client, how many are open after its log, and the most that were at once. Closes follow event_id and end one
    open each; a close with nothing open changes nothing.

    Each block of a client's events is walked by itself, from any count c on: after step i it holds max(c + sum, sum - least sum so far). The
    blocks, one row each, are then put together in order, so a busy client is spread over tasks."""
    step = F.when(F.col("opcode") == opened, 1).when(F.col("opcode") == closed, -1).otherwise(0)
    rows = log.select("client", "event_id", F.floor(F.col("event_id") / HANDLE_BLOCK).alias("_block"), step.cast("long").alias("_step"), (F.col("opcode") == opened).alias("_open"))
    so_far = "over (partition by client, _block order by event_id rows between unbounded preceding and current row)"
    walked = rows.withColumn("_sum", F.expr(f"sum(_step) {so_far}"))
    walked = walked.withColumn("_rise", F.col("_sum") - F.expr(f"min(_sum) {so_far}"))
    blocks = walked.groupBy("client", "_block").agg(
        F.count_if("_open").alias("opened"), F.sum("_step").alias("_sum"), F.min("_sum").alias("_low"), F.max("_sum").alias("_high"), F.max("_rise").alias("_rise"),
    )
    order = "partition by client order by _block rows between unbounded preceding and"
    chain = blocks.withColumn("_all", F.expr(f"coalesce(sum(_sum) over ({order} 1 preceding), 0)"))
    # the count at a block's start is the sum before it less the least sum before it (at most 0)
    chain = chain.withColumn("_least", F.least(F.lit(0), F.expr("min(_low + _all) over (partition by client order by _block rows between unbounded preceding and 1 preceding)")))
    chain = chain.withColumn("_c", F.col("_all") - F.col("_least"))
    end = F.sum("_sum") - F.least(F.lit(0), F.min(F.col("_all") + F.col("_low")))
    return chain.groupBy("client").agg(F.sum("opened").alias("opened"), end.alias("still_open"), F.max(F.greatest(F.lit(0), F.col("_c") + F.col("_high"), F.col("_rise"))).alias("peak"))


def client_states(log: DataFrame) -> DataFrame:
    """State of each client after its log: last operation, and creates less unlinks."""
    state = log.groupBy("client").agg(
        F.max_by("opcode", "event_id").alias("last_op"), F.max("event_id").alias("last_event"), (F.count_if(F.col("opcode") == 4) - F.count_if(F.col("opcode") == 8)).alias("balance"),
    )
    return run(state, ["client"])
