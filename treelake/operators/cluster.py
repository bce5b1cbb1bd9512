"""Caches, transactions and cluster management."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evict(items: DataFrame, need_bytes: int, need_files: int, partitions: str = "inode % 64") -> DataFrame:
    """inode, size of the victims: unpinned items, oldest first, until both needs are met (one item at least).

    Items are summed by day first, so only the day in which the needs are met is walked item by item."""
    free = items.filter("refs = 0").withColumn("_day", F.to_date("atime"))
    days = free.groupBy("_day").agg(F.sum("size").alias("_b"), F.count(F.lit(1)).alias("_f"))
    before = days.withColumn("_bytes", F.expr("sum(_b) over (order by _day) - _b")).withColumn("_files", F.expr("sum(_f) over (order by _day) - _f")).drop("_b", "_f")
    met = (F.col("_bytes") >= need_bytes) & (F.col("_files") >= need_files) & (F.col("_files") > 0)
    open_ = free.join(F.broadcast(before.filter(~met)), "_day")  # one row a day
    over = "over (partition by _day order by atime, inode rows between unbounded preceding and current row)"
    walked = open_.withColumn("_b", F.col("_bytes") + F.expr(f"sum(size) {over}") - F.col("size")).withColumn("_f", F.col("_files") + F.expr(f"count(1) {over}") - 1)
    return walked.filter(~((F.col("_b") >= need_bytes) & (F.col("_f") >= need_files) & (F.col("_f") > 0))).select("inode", "size")


def merge_intervals(spans: DataFrame, key: str) -> DataFrame:
    """Touching or overlapping [start, stop) spans of a key as one."""
    reach = F.expr(f"max(stop) over (partition by {key} order by start, stop rows between unbounded preceding and 1 preceding)")
    marked = spans.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    island = marked.withColumn("_island", F.expr(f"sum(_new) over (partition by {key} order by start, stop rows between unbounded preceding and current row)"))
    return island.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


WRITE_BUFFER = 256 * 1024


def coalesce_writes(writes: DataFrame, key: str, limit: int = WRITE_BUFFER) -> DataFrame:
    """key, flush, start, bytes: writes (seq, start, size) of a key in order are gathered while each goes on where the
    last ended; a gap, or a write that would pass the limit, flushes first. A write without start or size stands alone.

    Gaps cut a key into runs that don't depend on each other. Runs are spread over tasks and each is read in order as a
    stream, of which only the open buffer is held."""
    before = f"over (partition by {key} order by seq, start, size)"
    gaps = writes.withColumn("_gap", F.expr(f"coalesce(cast(start != lag(start + size) {before} as int), 1)"))
    runs = gaps.withColumn("_run", F.expr(f"sum(_gap) over (partition by {key} order by seq, start, size rows between unbounded preceding and current row)"))
    rows = runs.select(key, "_run", "seq", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"))
    dealt = rows.repartition(key, "_run").sortWithinPartitions(key, "_run", "seq", "start", "size")

    kinds = dict(rows.dtypes)

    def pack(batches):
        import pyarrow as pa

        run, first, start, size, names = None, 0, 0, 0, None  # the open buffer
        for batch in batches:
            done, names = [], pa.schema([batch.schema.field(0), pa.field("_first", batch.schema.field("seq").type), pa.field("start", pa.int64()), pa.field("bytes", pa.int64())])
            for k, r, seq, at, n in zip(*(column.to_pylist() for column in batch.columns)):
                if (k, r) == run and size + n <= limit:
                    size += n
                    continue
                if run is not None:
                    done.append((run[0], first, start, size))
                run, first, start, size = (k, r), seq, at, n
            yield pa.RecordBatch.from_pylist([dict(zip(names.names, row)) for row in done], schema=names)
        if run is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names.names, (run[0], first, start, size)))], schema=names)

    flushes = dealt.mapInArrow(pack, f"`{key}` {kinds[key]}, _first {kinds['seq']}, start bigint, bytes bigint")
    return flushes.select(key, F.expr(f"row_number() over (partition by {key} order by _first, start) - 1").alias("flush"), "start", "bytes")


def read_blocks(files: DataFrame, block: int = 1 << 20, pipes: int = 3) -> DataFrame:
    """inode, block, pipe: blocks of a file and the pipe that serves each."""
    n = F.ceil(F.col("size") / block).cast("long")
    rows = files.withColumn("_n", n).filter("_n > 0")
    return rows.select("inode", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("block")).select("inode", "block", (F.col("block") % F.least("_n", F.lit(pipes))).alias("pipe"))


def settle_transactions(first: DataFrame, running: DataFrame, logged: DataFrame, second: DataFrame) -> DataFrame:
    """gid, action of two-phase commit repair. first and second: prepared at the two readings; running: in progress;
    logged: decided to commit."""
    flag = lambda df, name: df.select("gid").distinct().withColumn(name, F.lit(True))
    rows = flag(logged, "c").join(flag(first, "a"), "gid", "full_outer").join(flag(running, "b"), "gid", "left").join(flag(second, "d"), "gid", "left")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    action = F.when(on("c") & ~on("b") & ~on("d"), F.lit("drop")).when(on("c") & ~on("b") & on("a"), F.lit("commit")).when(on("c") & ~on("b"), F.lit("wait")).when(on("a") & ~on("b") & ~on("c"), F.lit("rollback"))
    return rows.select("gid", action.alias("action")).filter("action is not null")


def elect(candidates: DataFrame, members: int) -> DataFrame:
    """cluster, leader: the candidate with the highest log position (the first by place among equals), if more than half
    of the members stand and the position is above 0."""
    best = F.max_by("host", F.struct(F.col("lsn"), -F.col("place")))
    rows = candidates.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"), F.max("lsn").alias("_top"), best.alias("leader"))
    return rows.filter((F.col("_n") >= members // 2 + 1) & (F.col("_top") > 0)).select("cluster", "leader")


def ready(nodes: DataFrame, replicas: int) -> DataFrame:
    """cluster, ready: one leader and exactly `replicas` replicas."""
    return nodes.groupBy("cluster").agg(((F.count_if(F.col("role") == "leader") == 1) & (F.count_if(F.col("role") == "replica") == replicas)).alias("ready"))


def compare_views(registered: DataFrame, known: DataFrame) -> DataFrame:
    """node, state: same, changed, only_registered or only_known."""
    joined = registered.select("node", F.col("endpoint").alias("a")).join(known.select("node", F.col("endpoint").alias("b")), "node", "full_outer")
    state = F.when(F.col("b").isNull(), F.lit("only_registered")).when(F.col("a").isNull(), F.lit("only_known")).when(F.col("a") == F.col("b"), F.lit("same")).otherwise(F.lit("changed"))
    return joined.select("node", state.alias("state"))


def refresh_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """node, action for a new view of nodes: drop those missing or whose host changed (the port doesn't count; the latter
    are added again), keep equal ones, add the rest."""
    from ..functions.formats import host_of

    joined = old.select("node", host_of(F.col("endpoint")).alias("a")).join(new.select("node", host_of(F.col("endpoint")).alias("b")), "node", "full_outer")
    action = F.when(F.col("b").isNull(), F.lit("drop")).when(F.col("a").isNull(), F.lit("add")).when(F.col("a") == F.col("b"), F.lit("keep")).otherwise(F.lit("replace"))
    return joined.select("node", action.alias("action"))


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two frames hold the same rows, however often."""
    return a.subtract(b).union(b.subtract(a)).agg((F.count(F.lit(1)) == 0).alias("same"))


def find_cluster(hosts: DataFrame, members: DataFrame) -> DataFrame:
    """host, cluster by the member lists; coordinators (kind 'cn') belong to cn only, workers to the others; the rest is
    spare."""
    rows = hosts.join(members, "host", "left").withColumn("_fits", (F.col("kind") == "cn") == (F.col("cluster") == "cn"))
    return rows.groupBy("host").agg(F.coalesce(F.min(F.when(F.col("_fits"), F.col("cluster"))), F.lit("spare")).alias("cluster"))


def supplement(tickets: DataFrame, spares: DataFrame) -> DataFrame:
    """ticket, host: the nth ticket of a kind gets the nth spare of that kind."""
    left = tickets.withColumn("_n", F.expr("row_number() over (partition by kind order by ticket)"))
    right = spares.withColumn("_n", F.expr("row_number() over (partition by kind order by host)"))
    return left.join(right, ["kind", "_n"]).select("ticket", "kind", "host")


def assign_clusters(hosts: DataFrame, replicas: int, spares: int) -> DataFrame:
    """host, cluster: hosts by name in groups of replicas + 1, as many as the spares leave room for; the rest is spare."""
    size = replicas + 1
    rows = hosts.withColumn("_i", F.expr("row_number() over (order by host) - 1")).withColumn("_all", F.expr("count(1) over ()"))
    clusters = F.floor((F.col("_all") - spares) / size)
    group = F.floor(F.col("_i") / size)
    return rows.select("host", F.when(group < clusters, F.concat(F.lit("dn"), group.cast("string"))).otherwise(F.lit("spare")).alias("cluster"))


def lost_nodes(checks: DataFrame, wait: int, step: int = 10) -> DataFrame:
    """host, check_no: checks at which a host has been gone so long that it is evicted. Missed checks in a row add a step
    each from the second on; a return starts anew."""
    island = checks.withColumn("_i", F.expr("sum(cast(alive as int)) over (partition by host order by check_no rows between unbounded preceding and current row)"))
    gone = island.filter("not alive").withColumn("_lost", F.expr(f"(row_number() over (partition by host, _i order by check_no) - 1) * {step}"))
    return gone.filter(F.col("_lost") >= wait - step).groupBy("host").agg(F.min("check_no").alias("check_no"))


def stable_since(samples: DataFrame, window: int) -> DataFrame:
    """target, start, stop of stretches of healthy samples that last window seconds or more."""
    island = samples.withColumn("_i", F.expr("sum(cast(not healthy as int)) over (partition by target order by second rows between unbounded preceding and current row)"))
    runs = island.filter("healthy").groupBy("target", "_i").agg(F.min("second").alias("start"), F.max("second").alias("stop"))
    return runs.filter(F.col("stop") - F.col("start") >= window).select("target", "start", "stop")


def adjust_wait(loads: DataFrame, batch: int, top: int = 512, block: int = 4096) -> DataFrame:
    """pool, wait: from 1, doubled (at most top, a power of two) when a load is at most twice the batch, else halved (at least
    1). seq numbers the events of a pool.

    A step moves the exponent of the wait by one within 0..log2(top), and a run of steps acts as x -> min(max(x + by, low), high).
    So blocks of `block` numbers are summed up by themselves, then blocks of blocks, and no row holds all events of a pool."""
    high = top.bit_length() - 1
    if top != 1 << high:
        raise ValueError("top must be a power of two")
    by = F.when(F.col("load") <= 2 * batch, 1).otherwise(-1).cast("long")
    rows = loads.select("pool", F.col("seq").cast("long").alias("seq"), by.alias("by"), F.lit(0).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))
    nothing = F.struct(F.lit(0).cast("long").alias("by"), F.lit(0).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))

    def then(f: Column, g: Column) -> Column:
        end = lambda c: F.least(F.greatest(f[c] + g["by"], g["low"]), g["high"])
        return F.struct((f["by"] + g["by"]).alias("by"), end("low").alias("low"), end("high").alias("high"))

    for last in (False, False, True):
        group = ["pool"] if last else ["pool", F.floor(F.col("seq") / block).alias("seq")]
        steps = F.array_sort(F.collect_list(F.struct("seq", "by", "low", "high")))
        rows = rows.groupBy(*group).agg(F.aggregate(steps, nothing, then).alias("f")).select("pool", *([] if last else ["seq"]), "f.by", "f.low", "f.high")
    exponent = F.least(F.greatest(F.col("by"), F.col("low")), F.col("high"))
    return rows.select("pool", F.pow(F.lit(2), exponent).cast("long").alias("wait"))


def missing_servers(have: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(have.select("server_id"), "server_id", "left_anti")


def fan_out(servers: DataFrame, commands: DataFrame, but: list[int]) -> DataFrame:
    """Every command to every server but some; servers are few, so they go to all tasks."""
    return commands.crossJoin(F.broadcast(servers.filter(~F.col("server_id").isin(but)).select("server_id")))
