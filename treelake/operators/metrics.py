"""Latency break-downs, counters and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats


def valid_traces(traces: DataFrame) -> DataFrame:
    """Requests with two checkpoints at least."""
    return traces.filter(F.size("ts_ns") >= 2)


def end_to_end() -> Column:
    first, last = F.element_at("ts_ns", 1), F.element_at("ts_ns", -1)
    return F.when((first > 0) & (last > first), last - first).otherwise(F.lit(0).cast("long"))


def by_opcode(traces: DataFrame) -> DataFrame:
    """requests, e2e_sum_ns, e2e_avg_us, most_checkpoints of each opcode."""
    rows = valid_traces(traces).select("opcode", end_to_end().alias("e2e"), F.size("ts_ns").alias("n"))
    out = rows.groupBy("opcode").agg(F.count(F.lit(1)).alias("requests"), F.sum("e2e").alias("e2e_sum_ns"), F.max("n").alias("most_checkpoints"))
    return out.select("opcode", "requests", "e2e_sum_ns", (F.col("e2e_sum_ns") / F.col("requests") / 1000).alias("e2e_avg_us"), "most_checkpoints")


def gaps(traces: DataFrame) -> DataFrame:
    """event_id, opcode, stage (the checkpoint that ends it), gap_ns; 0 if a stamp is missing or they are reversed."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("ts_ns") - 1), lambda g: F.struct(g.alias("stage"), F.get("ts_ns", g - 1).alias("a"), F.get("ts_ns", g).alias("b")))
    rows = valid_traces(traces).select("event_id", "opcode", F.inline(pairs))
    return rows.select("event_id", "opcode", "stage", F.when((F.col("a") > 0) & (F.col("b") > F.col("a")), F.col("b") - F.col("a")).otherwise(F.lit(0).cast("long")).alias("gap_ns"))


def gap_summary(traces: DataFrame) -> DataFrame:
    """Sum, count, least, most, average and share of the opcode's whole time of each stage."""
    stages = gaps(traces).groupBy("opcode", "stage").agg(F.sum("gap_ns").alias("sum_ns"), F.count(F.lit(1)).alias("n"), F.min("gap_ns").alias("min_ns"), F.max("gap_ns").alias("max_ns"))
    whole = by_opcode(traces).select("opcode", "e2e_sum_ns")
    rows = stages.join(F.broadcast(whole), "opcode")  # at most one row an opcode
    pct = F.when(F.col("e2e_sum_ns") > 0, F.col("sum_ns") * 100.0 / F.col("e2e_sum_ns")).otherwise(F.lit(0.0))
    return rows.select("opcode", "stage", "sum_ns", "n", "min_ns", "max_ns", (F.col("sum_ns") / F.col("n") / 1000).alias("avg_us"), pct.cast("double").alias("pct"))


#: Counters in their order, and how partial values of nodes are merged.
OPS = ["read", "write", "open", "release", "stat", "lookup", "create", "unlink", "mkdir"]


def merge_nodes(partials: DataFrame) -> DataFrame:
    """metric, value over nodes: the highest for metrics that end in _max, else the sum."""
    out = partials.groupBy("metric").agg(F.sum("value").alias("_s"), F.max("value").alias("_m"))
    return out.select("metric", F.when(F.col("metric").endswith("_max"), F.col("_m")).otherwise(F.col("_s")).alias("value"))


def rollup(counters: DataFrame) -> DataFrame:
    """Per node: all metadata operations, all operations (data, metadata), whole and highest latency."""
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("metric").isin(*names), F.col("value"))), F.lit(0))
    meta = [n for n in OPS if n not in ("read", "write")]
    peak = F.coalesce(F.max(F.when(F.col("metric").endswith("_max"), F.col("value"))), F.lit(0))
    rows = counters.groupBy("node_id").agg(of(*meta).alias("meta_ops"), of("read", "write").alias("data_ops"), of("read_lat", "write_lat").alias("data_lat"), of("meta_lat").alias("meta_lat"), peak.alias("lat_max"))
    return rows.select("node_id", "meta_ops", (F.col("data_ops") + F.col("meta_ops")).alias("all_ops"), (F.col("data_lat") + F.col("meta_lat")).alias("all_lat"), "lat_max")


def dashboard(wide: DataFrame) -> DataFrame:
    """Shown columns of wide (node_id, ops, latency_us, latency_max_us, stat, lookup, read_bytes)."""
    return wide.select(
        "node_id",
        formats.count_text(F.col("ops")).alias("ops"),
        formats.average_ms(F.col("latency_us"), F.col("ops")).alias("latency_ms"),
        formats.average_ms(F.col("latency_max_us"), F.lit(1)).alias("latency_max_ms"),
        formats.count_text(F.col("stat") + F.col("lookup")).alias("stats"),
        formats.bytes_text(F.col("read_bytes")).alias("read"),
    )


def throughput(rounds: DataFrame) -> DataFrame:
    """ops a second and latency an operation of each round (round, ops, seconds, latency_us)."""
    return rounds.groupBy("round").agg(
        F.sum("ops").alias("ops"), (F.sum("ops") / F.nullif(F.max("seconds"), F.lit(0))).alias("ops_per_second"), (F.sum("latency_us") / F.nullif(F.sum("ops"), F.lit(0))).alias("us_per_op"),
    )


RESULT_LINE = r"\[FINISH\] Round (\d+), Time ([\d.]+), OPs (\d+), Throughput ([\d.]+), Average Latency ([\d.]+)"


def host_totals(lines: DataFrame) -> DataFrame:
    """round, hosts, throughput: result lines of hosts added up."""
    part = lambda k: F.regexp_extract("line", RESULT_LINE, k)
    rows = lines.filter(F.col("line").rlike(RESULT_LINE)).select(part(1).cast("int").alias("round"), part(4).cast("double").alias("t"))
    return rows.groupBy("round").agg(F.count(F.lit(1)).alias("hosts"), F.sum("t").alias("throughput"))


def store_stat(stats: DataFrame) -> DataFrame:
    """Blocks and files over the nodes that answer."""
    names = ["blocks", "bfree", "bavail", "files", "ffree"]
    return stats.filter("reachable").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def quota_stat(usage: DataFrame) -> DataFrame:
    """used and free blocks of 4096 bytes of each bucket (bucket, capacity, quota); quota 0 is unlimited (free null)."""
    used = F.ceil(F.col("capacity") / 4096).cast("long")
    return usage.select("bucket", used.alias("used"), F.when(F.col("quota") > 0, F.floor(F.col("quota") / 4096).cast("long") - used).alias("free"))


def recovery(events: DataFrame) -> DataFrame:
    """action, n, passed, failed_inject, failed_recover of fault actions."""
    count = lambda c: F.count_if(c)
    return events.groupBy("action").agg(F.count(F.lit(1)).alias("n"), count(F.col("injected") & F.col("recovered")).alias("passed"), count(~F.col("injected")).alias("failed_inject"), count(F.col("injected") & ~F.col("recovered")).alias("failed_recover"))
