"""Aggregations, windows and set operations."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from ..functions import hashing as H
from ..operators import cluster, metrics, placement, records
from ..sources import namespace as S
from . import base as B
from . import query
from .functions import average_sql, scaled_sql

LOOKED_UP = "SELECT st_ino, st_size, s.range_point, s.server_id FROM (SELECT st_ino, st_size, hash FROM files JOIN part_hash ON part = parentid_partid & 8191) f ASOF JOIN shard_map s ON f.hash <= s.range_point"
PLACED = (B.DIRECTORY, B.FILES, B.part_hash(), B.shard_map(), f"placed AS ({LOOKED_UP})")


WORKERS = 4


def placed(spark, d):
    rows = S.files(spark, d).select("st_ino", "st_size", "parentid_partid")
    return placement.with_shard(rows, H.part_of(F.col("parentid_partid")), placement.build(spark, 50, WORKERS)).select("st_ino", "st_size", "range_point", "server_id")


@query(B.with_(*PLACED, body="SELECT range_point, count(*) AS requests, min(st_ino) AS first, sum(st_size)::BIGINT AS bytes FROM placed GROUP BY 1"))
def agg_group_shard(spark, d):
    return placed(spark, d).groupBy("range_point").agg(F.count(F.lit(1)).alias("requests"), F.min("st_ino").alias("first"), F.sum("st_size").alias("bytes"))


@query(B.with_(*PLACED, body="SELECT server_id, count(*) AS requests, count(DISTINCT range_point) AS shards FROM placed GROUP BY 1"))
def agg_group_server(spark, d):
    return placed(spark, d).groupBy("server_id").agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("range_point").alias("shards"))


VALID = "SELECT *, CASE WHEN ts_ns[1] > 0 AND ts_ns[-1] > ts_ns[1] THEN ts_ns[-1] - ts_ns[1] ELSE 0 END AS e2e FROM traces WHERE len(ts_ns) >= 2"
GAPS = "SELECT event_id, opcode, g::INTEGER AS stage, CASE WHEN ts_ns[g] > 0 AND ts_ns[g + 1] > ts_ns[g] THEN ts_ns[g + 1] - ts_ns[g] ELSE 0 END::BIGINT AS gap_ns FROM (SELECT *, unnest(range(1, len(ts_ns))) AS g FROM traces WHERE len(ts_ns) >= 2)"
TRACED = (B.OPLOG, B.TRACES)


@query(B.with_(*TRACED, body=f"SELECT opcode, count(*) AS requests, sum(e2e)::BIGINT AS e2e_sum_ns, sum(e2e)::BIGINT / count(*) / 1000 AS e2e_avg_us, max(len(ts_ns))::INTEGER AS most_checkpoints FROM ({VALID}) GROUP BY 1"))
def agg_opcode(spark, d):
    return metrics.by_opcode(S.traces(spark, d))


@query(B.with_(*TRACED, body="SELECT opcode, max(len(ts_ns))::INTEGER AS most FROM traces GROUP BY 1"))
def agg_maxckpt(spark, d):
    return metrics.by_opcode(S.traces(spark, d)).select("opcode", F.col("most_checkpoints").alias("most"))


@query(B.with_(*TRACED, body=GAPS))
def win_gap(spark, d):
    return metrics.gaps(S.traces(spark, d))


@query(B.with_(*TRACED, body=f"""SELECT g.opcode, stage, sum_ns, n, min_ns, max_ns, sum_ns / n / 1000 AS avg_us, CASE WHEN e > 0 THEN sum_ns * 100.0::DOUBLE / e ELSE 0 END::DOUBLE AS pct
    FROM (SELECT opcode, stage, sum(gap_ns)::BIGINT AS sum_ns, count(*) AS n, min(gap_ns) AS min_ns, max(gap_ns) AS max_ns FROM ({GAPS}) GROUP BY 1, 2) g
    JOIN (SELECT opcode, sum(e2e)::BIGINT AS e FROM ({VALID}) GROUP BY 1) v ON g.opcode = v.opcode"""))
def agg_gap(spark, d):
    return metrics.gap_summary(S.traces(spark, d))


@query(B.with_(*TRACED, body="SELECT opcode, count(*) FILTER (list_contains(ts_ns, 0)) AS dropped, count(*) AS n FROM traces GROUP BY 1"))
def agg_drop(spark, d):
    return S.traces(spark, d).groupBy("opcode").agg(F.count_if(F.array_contains("ts_ns", 0)).alias("dropped"), F.count(F.lit(1)).alias("n"))


NAMES = ["read", "write", "open", "release", "stat", "lookup", "create", "unlink", "mkdir", "read_lat", "write_lat", "meta_lat", "read_lat_max", "write_lat_max"]
COUNTERS = f"counters AS (SELECT ([{', '.join(repr(n) for n in NAMES)}])[(event_id % {len(NAMES)})::INTEGER + 1] AS metric, user_id % 4 AS node_id, (event_id * 31) % 1000 AS value FROM events)"


def counters(spark, d):
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES)).cast("int"))
    return S.table(spark, d, "events").select(name.alias("metric"), (F.col("user_id") % 4).alias("node_id"), (F.col("event_id") * 31 % 1000).alias("value"))


@query(f"WITH {COUNTERS} SELECT metric, CASE WHEN metric LIKE '%_max' THEN max(value) ELSE sum(value) END::BIGINT AS value FROM counters GROUP BY 1")
def agg_partial_final(spark, d):
    return metrics.merge_nodes(counters(spark, d))


@query(f"""WITH {COUNTERS} SELECT node_id, m AS meta_ops, d + m AS all_ops, dl + ml AS all_lat, lat_max FROM (SELECT node_id,
    coalesce(sum(value) FILTER (metric IN ('open', 'release', 'stat', 'lookup', 'create', 'unlink', 'mkdir')), 0)::BIGINT AS m, coalesce(sum(value) FILTER (metric IN ('read', 'write')), 0)::BIGINT AS d,
    coalesce(sum(value) FILTER (metric IN ('read_lat', 'write_lat')), 0)::BIGINT AS dl, coalesce(sum(value) FILTER (metric = 'meta_lat'), 0)::BIGINT AS ml, coalesce(max(value) FILTER (metric LIKE '%_max'), 0)::BIGINT AS lat_max
    FROM counters GROUP BY 1)""")
def agg_rollup_meta(spark, d):
    return metrics.rollup(counters(spark, d))


@query(f"""WITH w AS (SELECT user_id % 8 AS node_id, count(*) AS ops, sum(event_id * 7 % 5000)::BIGINT AS lat, max(event_id * 7 % 5000) AS peak, count(*) FILTER (event_type = 'click') AS s, count(*) FILTER (event_type = 'view') AS l, sum(event_id * 997)::BIGINT AS b FROM events GROUP BY 1)
    SELECT node_id, {scaled_sql('ops', ['', 'K', 'M', 'G'])} AS ops, {average_sql('lat', 'ops')} AS latency_ms, {average_sql('peak', '1')} AS latency_max_ms, {scaled_sql('(s + l)', ['', 'K', 'M', 'G'])} AS stats, {scaled_sql('b', ['B', 'K', 'M', 'G', 'T', 'P'])} AS read FROM w""")
def agg_dashboard(spark, d):
    e = S.table(spark, d, "events")
    lat = F.col("event_id") * 7 % 5000
    wide = e.groupBy((F.col("user_id") % 8).alias("node_id")).agg(
        F.count(F.lit(1)).alias("ops"), F.sum(lat).alias("latency_us"), F.max(lat).alias("latency_max_us"), F.count_if(F.col("event_type") == "click").alias("stat"),
        F.count_if(F.col("event_type") == "view").alias("lookup"), F.sum(F.col("event_id") * 997).alias("read_bytes"),
    )
    return metrics.dashboard(wide)


@query("SELECT coalesce(sum(s_suppkey * 100), 0)::BIGINT AS blocks, sum(s_suppkey * 10)::BIGINT AS bfree, sum(s_suppkey * 9)::BIGINT AS bavail, sum(s_suppkey)::BIGINT AS files, sum(s_suppkey % 7)::BIGINT AS ffree FROM supplier WHERE s_suppkey % 4 <> 0")
def agg_statfs(spark, d):
    k = F.col("s_suppkey")
    return metrics.store_stat(S.table(spark, d, "supplier").select((k * 100).alias("blocks"), (k * 10).alias("bfree"), (k * 9).alias("bavail"), k.alias("files"), (k % 7).alias("ffree"), (k % 4 != 0).alias("reachable")))


@query("SELECT source AS bucket, (c + 4095) // 4096 AS used, CASE WHEN q > 0 THEN q // 4096 - (c + 4095) // 4096 END AS free FROM (SELECT source, sum(n_chars)::BIGINT AS c, (CASE WHEN source LIKE '%1' THEN 0 ELSE 1000000000 END)::BIGINT AS q FROM documents GROUP BY 1)")
def agg_obs_statfs(spark, d):
    usage = S.table(spark, d, "documents").groupBy(F.col("source").alias("bucket")).agg(F.sum("n_chars").alias("capacity"))
    return metrics.quota_stat(usage.withColumn("quota", F.when(F.col("bucket").endswith("1"), 0).otherwise(1_000_000_000).cast("long")))


CANDIDATES = "(SELECT n_regionkey AS cluster, n_name AS host, n_nationkey AS place, CASE WHEN n_regionkey = 3 THEN 0 ELSE n_nationkey % 3 * 100 END::BIGINT AS lsn FROM nation WHERE n_regionkey <> 4 OR n_nationkey % 3 = 0)"


@query(f"SELECT cluster, arg_max(host, lsn * 1000 - place) AS leader FROM {CANDIDATES} GROUP BY 1 HAVING count(*) >= 3 AND max(lsn) > 0")
def agg_argmax_lsn(spark, d):
    rows = S.table(spark, d, "nation").filter("n_regionkey <> 4 or n_nationkey % 3 = 0")
    lsn = F.when(F.col("n_regionkey") == 3, 0).otherwise(F.col("n_nationkey") % 3 * 100).cast("long")
    return cluster.elect(rows.select(F.col("n_regionkey").alias("cluster"), F.col("n_name").alias("host"), F.col("n_nationkey").alias("place"), lsn.alias("lsn")), members=5)


@query("SELECT cluster, count(*) FILTER (role = 'leader') = 1 AND count(*) FILTER (role = 'replica') = 2 AS ready FROM (SELECT s_suppkey // 3 AS cluster, CASE WHEN s_suppkey % 3 = 0 THEN 'leader' WHEN s_suppkey % 11 = 1 THEN 'lost' ELSE 'replica' END AS role FROM supplier) GROUP BY 1")
def agg_cluster_ready(spark, d):
    k = F.col("s_suppkey")
    role = F.when(k % 3 == 0, "leader").when(k % 11 == 1, "lost").otherwise("replica")
    return cluster.ready(S.table(spark, d, "supplier").select(F.floor(k / 3).cast("long").alias("cluster"), role.alias("role")), replicas=2)


@query("SELECT user_id % 10 AS round, count(*) AS ops, count(*) / max(event_id % 60 + 1) AS ops_per_second, sum(event_id % 900)::BIGINT / count(*) AS us_per_op FROM events GROUP BY 1")
def agg_throughput(spark, d):
    e = F.col("event_id")
    return metrics.throughput(S.table(spark, d, "events").select((F.col("user_id") % 10).alias("round"), F.lit(1).cast("long").alias("ops"), (e % 60 + 1).alias("seconds"), (e % 900).alias("latency_us")))


@query("SELECT (o_orderkey % 12)::INTEGER AS round, count(*) AS hosts, sum((o_custkey % 100)::DOUBLE + 0.5) AS throughput FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1")
def agg_total_remote(spark, d):
    text = lambda c: c.cast("string")
    line = F.concat(F.lit("x [FINISH] Round "), text(F.col("o_orderkey") % 12), F.lit(", Time 10.5, OPs 77, Throughput "), text(F.col("o_custkey") % 100), F.lit(".5, Average Latency 3.2"))
    return metrics.host_totals(S.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, "noise").otherwise(line).alias("line")))


@query("SELECT event_type AS action, count(*) AS n, count(*) FILTER (event_id % 3 <> 0 AND event_id % 5 <> 0) AS passed, count(*) FILTER (event_id % 3 = 0) AS failed_inject, count(*) FILTER (event_id % 3 <> 0 AND event_id % 5 = 0) AS failed_recover FROM events GROUP BY 1")
def agg_chaos(spark, d):
    e = F.col("event_id")
    return metrics.recovery(S.table(spark, d, "events").select(F.col("event_type").alias("action"), (e % 3 != 0).alias("injected"), (e % 5 != 0).alias("recovered")))


@query(B.with_(B.SLICES, body="SELECT inodeid, list(slicelen ORDER BY chunkid, sliceoffset, slicelen, sliceloc1) AS lengths, count(*) AS n FROM slices GROUP BY 1"))
def agg_slices_array(spark, d):
    entry = F.struct("chunkid", "sliceoffset", "slicelen", "sliceloc1")
    rows = S.slices(spark, d).groupBy("inodeid").agg(F.array_sort(F.collect_list(entry)).alias("s"), F.count(F.lit(1)).alias("n"))
    return rows.select("inodeid", F.col("s.slicelen").alias("lengths"), "n")


@query(B.with_(B.DIRECTORY, B.FILES, B.CACHE, body="SELECT sum(size)::BIGINT AS used, count(*) AS inodes, count(*) FILTER (refs > 0) AS pinned FROM cache"))
def agg_usage(spark, d):
    return S.cache_items(spark, d).agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("inodes"), F.count_if(F.col("refs") > 0).alias("pinned"))


@query(B.with_(B.DIRECTORY, B.FILES, B.CACHE, body="SELECT inode, size FROM (SELECT *, coalesce(sum(size) OVER w, 0) AS b, count(*) OVER w AS f FROM cache WHERE refs = 0 WINDOW w AS (ORDER BY atime, inode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE NOT (b >= 300000000 AND f >= 900 AND f > 0)"))
def win_evict(spark, d):
    return cluster.evict(S.cache_items(spark, d), 300_000_000, 900)


@query(B.with_(B.DIRECTORY, B.FILES, B.CACHE, body="SELECT inode, row_number() OVER (ORDER BY atime, inode)::INTEGER AS place FROM cache"))
def sort_atime(spark, d):
    return S.cache_items(spark, d).orderBy("atime", "inode").select("inode", F.expr("row_number() over (order by atime, inode)").alias("place"))


@query(B.with_(B.OPLOG, body="SELECT event_id, client, sum(s) OVER (PARTITION BY client ORDER BY event_id)::BIGINT AS run FROM (SELECT *, CASE WHEN opcode = 1 OR opcode IS DISTINCT FROM lag(opcode) OVER (PARTITION BY client ORDER BY event_id) THEN 1 ELSE 0 END AS s FROM oplog)"))
def win_runs(spark, d):
    return records.batch_runs(S.oplog(spark, d), "event_id", "opcode", F.col("opcode") == 1).select("event_id", "client", F.col("run").cast("long").alias("run"))


@query(B.with_(B.OPLOG, body="SELECT event_id, (row_number() OVER (PARTITION BY opcode ORDER BY event_id) - 1) // 512 AS batch FROM oplog"))
def win_batch_cut(spark, d):
    return records.batches(S.oplog(spark, d), "opcode", "event_id", 512).select("event_id", "batch")


@query(B.with_(B.OPLOG, body="SELECT event_id, (row_number() OVER (PARTITION BY opcode ORDER BY event_id) - 1) // 8 AS batch FROM oplog"))
def win_group8(spark, d):
    return records.batches(S.oplog(spark, d), "opcode", "event_id", 8).select("event_id", "batch")


@query("""WITH RECURSIVE l AS (SELECT user_id % 20 AS pool, event_id % 40 AS load, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS k FROM events),
    f(pool, k, wait) AS (SELECT DISTINCT pool, 0::BIGINT, 1::BIGINT FROM l UNION ALL SELECT l.pool, l.k, CASE WHEN load <= 20 THEN least(wait * 2, 512) ELSE greatest(wait // 2, 1) END FROM f JOIN l ON l.pool = f.pool AND l.k = f.k + 1)
    SELECT pool, arg_max(wait, k) AS wait FROM f GROUP BY 1""")
def win_adjust(spark, d):
    return cluster.adjust_wait(S.table(spark, d, "events").select((F.col("user_id") % 20).alias("pool"), F.col("event_id").alias("seq"), (F.col("event_id") % 40).alias("load")), batch=10)


SPANS = "(SELECT l_partkey AS part, l_orderkey % 1000 AS start, l_orderkey % 1000 + l_quantity::BIGINT AS stop FROM lineitem)"


@query(f"""SELECT part, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(n) OVER (PARTITION BY part ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY part ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM {SPANS})) GROUP BY part, island""")
def win_interval_merge(spark, d):
    start = F.col("l_orderkey") % 1000
    return cluster.merge_intervals(S.table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("stop")), "part")


WRITES = "(SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, (o_orderkey % 5 + 1) * 32768 AS size, o_orderkey FROM orders)"


@query(f"""WITH RECURSIVE w AS (SELECT file, seq, size, coalesce(sum(size) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS start FROM {WRITES}),
    f(file, seq, flush, start, bytes) AS (SELECT file, seq, 0::BIGINT, start, size FROM w WHERE seq = 1
        UNION ALL SELECT w.file, w.seq, CASE WHEN w.start = f.start + f.bytes AND f.bytes + w.size <= 262144 THEN f.flush ELSE f.flush + 1 END,
            CASE WHEN w.start = f.start + f.bytes AND f.bytes + w.size <= 262144 THEN f.start ELSE w.start END, CASE WHEN w.start = f.start + f.bytes AND f.bytes + w.size <= 262144 THEN f.bytes + w.size ELSE w.size END
        FROM f JOIN w ON w.file = f.file AND w.seq = f.seq + 1)
    SELECT file, flush::INTEGER AS flush, min(start) AS start, max(bytes) AS bytes FROM f GROUP BY file, flush""")
def win_coalesce_writes(spark, d):
    size = (F.col("o_orderkey") % 5 + 1) * 32768
    rows = S.table(spark, d, "orders").select(F.col("o_custkey").alias("file"), "o_orderkey", size.alias("size"))
    rows = rows.withColumn("seq", F.expr("row_number() over (partition by file order by o_orderkey)"))
    before = F.expr("coalesce(sum(size) over (partition by file order by o_orderkey rows between unbounded preceding and 1 preceding), 0)")
    return cluster.coalesce_writes(rows.withColumn("start", before + F.when(F.col("o_orderkey") % 6 == 0, 1).otherwise(0)), "file")


@query(B.with_(B.DIRECTORY, B.FILES, body="SELECT st_ino AS inode, b AS block, b % least(n, 3) AS pipe FROM (SELECT st_ino, n, unnest(range(n)) AS b FROM (SELECT st_ino, (st_size + 262143) // 262144 AS n FROM files))"))
def win_read_blocks(spark, d):
    return cluster.read_blocks(S.files(spark, d).select(F.col("st_ino").alias("inode"), F.col("st_size").alias("size")), block=262_144)


SAMPLES = "(SELECT user_id % 50 AS target, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id)::BIGINT * 10 AS second, event_id % 9 <> 0 AS healthy FROM events)"


def samples(spark, d):
    rows = S.table(spark, d, "events").select((F.col("user_id") % 50).alias("target"), "event_id", (F.col("event_id") % 9 != 0).alias("healthy"))
    return rows.withColumn("second", F.expr("row_number() over (partition by target order by event_id)").cast("long") * 10)


@query(f"SELECT target, min(second) AS start, max(second) AS stop FROM (SELECT *, sum((NOT healthy)::INT) OVER (PARTITION BY target ORDER BY second ROWS UNBOUNDED PRECEDING) AS i FROM {SAMPLES}) WHERE healthy GROUP BY target, i HAVING max(second) - min(second) >= 30")
def win_stable(spark, d):
    return cluster.stable_since(samples(spark, d), 30)


@query(f"SELECT target AS host, min(second) AS check_no FROM (SELECT target, second, (row_number() OVER (PARTITION BY target, i ORDER BY second) - 1) * 10 AS lost FROM (SELECT *, sum((NOT healthy)::INT) OVER (PARTITION BY target ORDER BY second ROWS UNBOUNDED PRECEDING) AS i FROM {SAMPLES}) WHERE healthy) WHERE lost >= 50 GROUP BY 1")
def win_lost_time(spark, d):
    """Here a healthy sample stands for a missed check."""
    rows = samples(spark, d).select(F.col("target").alias("host"), F.col("second").alias("check_no"), (~F.col("healthy")).alias("alive"))
    return cluster.lost_nodes(rows, wait=60)


TXN = "SELECT 'g' || o_orderkey AS gid, o_orderkey % 2 = 0 AS a, o_orderkey % 7 = 0 AS b, o_orderkey % 3 = 0 AS c, o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 AS d FROM orders"


@query(f"SELECT gid, action FROM (SELECT gid, CASE WHEN c AND NOT b AND NOT d THEN 'drop' WHEN c AND NOT b AND a THEN 'commit' WHEN c AND NOT b THEN 'wait' WHEN a AND NOT b AND NOT c THEN 'rollback' END AS action FROM ({TXN})) WHERE action IS NOT NULL")
def set_2pc(spark, d):
    rows = S.table(spark, d, "orders").select(F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("gid"), F.col("o_orderkey").alias("k"))
    return cluster.settle_transactions(rows.filter("k % 2 = 0"), rows.filter("k % 7 = 0"), rows.filter("k % 3 = 0"), rows.filter("k % 5 <> 0 and k % 2 = 0"))


@query(f"SELECT gid FROM ({TXN}) WHERE c AND a AND d AND NOT b")
def join_self_2pc(spark, d):
    rows = S.table(spark, d, "orders").select(F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("gid"), F.col("o_orderkey").alias("k"))
    some = lambda c: rows.filter(c).select("gid")
    return some("k % 3 = 0").join(some("k % 2 = 0"), "gid", "left_semi").join(some("k % 5 <> 0 and k % 2 = 0"), "gid", "left_semi").join(some("k % 7 = 0"), "gid", "left_anti")


@query(B.with_(*PLACED, body="SELECT st_ino, server_id FROM placed"))
def set_union_shards(spark, d):
    """The listings of all servers of the map, one after another."""
    rows = placed(spark, d).select("st_ino", "server_id")
    return functools.reduce(DataFrame.unionByName, [rows.filter(F.col("server_id") == server) for server in range(1, WORKERS + 1)])


assert formats
