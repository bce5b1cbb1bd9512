"""Placement and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import cluster, placement
from ..operators import namespace as N
from ..plans import rebalance as R
from ..sources import namespace as S
from . import base as B
from . import query

SHARDS = B.shard_map()


def shards(spark):
    return placement.build(spark, 50, 4)


@query(B.with_(*B.NAMESPACE, body="SELECT req_id, parent_path IS NOT NULL AND path LIKE '/%' AS ok, CASE WHEN path LIKE '/%' THEN parent_id END AS parent_id FROM (SELECT r.req_id, r.path, t.path AS parent_path, t.inodeid AS parent_id FROM requests r LEFT JOIN tree t ON t.path = regexp_replace(rtrim(r.path, '/'), '/[^/]*$', ''))"))
def join_path_resolve(spark, d):
    rows = N.resolve(S.file_requests(spark, d), S.directories(spark, d))
    return rows.select("req_id", F.col("parent_id").isNotNull().alias("ok"), "parent_id")


@query(B.with_(B.DIRECTORY, B.FILES, B.part_hash(), SHARDS, body="SELECT st_ino, s.range_point, s.server_id FROM (SELECT st_ino, hash FROM files JOIN part_hash ON part = parentid_partid & 8191) f ASOF JOIN shard_map s ON f.hash <= s.range_point"))
def join_shard_lookup(spark, d):
    return placement.with_shard(S.files(spark, d).select("st_ino", "parentid_partid"), H.part_of(F.col("parentid_partid")), shards(spark)).select("st_ino", "range_point", "server_id")


RENEWED = "SELECT coalesce(lag(range_point) OVER (ORDER BY range_point) + 1, 0)::INTEGER AS range_min, range_point AS range_max, host, port, m.server_id FROM shard_map m LEFT JOIN servers s ON m.server_id = s.server_id"


@query(B.with_(SHARDS, B.SERVERS, body=RENEWED))
def join_shard_server(spark, d):
    return placement.renew(shards(spark), S.servers(spark))


@query(B.with_(SHARDS, body="SELECT range_point, server_id, coalesce(lag(range_point) OVER (ORDER BY range_point) + 1, 0)::INTEGER AS range_min FROM shard_map"))
def win_range_min(spark, d):
    return placement.ranges(shards(spark))


@query(B.with_(SHARDS, B.SERVERS, body=f"SELECT bool_and(range_min = due) AND max(range_max) = 2147483647 AS valid FROM (SELECT *, coalesce(lag(range_max) OVER (ORDER BY range_min) + 1, 0) AS due FROM ({RENEWED}))"))
def win_range_check(spark, d):
    return placement.check(placement.renew(shards(spark), S.servers(spark)))


@query(B.with_(B.shard_map(300, 7), body="SELECT * FROM shard_map"))
def win_round_robin(spark, d):
    return placement.build(spark, 300, 7)


@query(B.with_(SHARDS, body="SELECT * FROM shard_map"))
def scan_ordered(spark, d):
    return shards(spark).orderBy("range_point")


@query(B.with_(SHARDS, body="SELECT range_point, server_id FROM shard_map ORDER BY range_point DESC LIMIT 1"))
def topk_last(spark, d):
    return shards(spark).orderBy(F.desc("range_point")).limit(1)


@query(B.with_(SHARDS, body="SELECT count(*) AS n, max(range_point) AS last FROM shard_map"))
def agg_count_max(spark, d):
    return shards(spark).agg(F.count(F.lit(1)).alias("n"), F.max("range_point").alias("last"))


@query(B.with_(SHARDS, body="SELECT server_id, count(*) AS shards FROM shard_map GROUP BY 1"))
def agg_shards_per_server(spark, d):
    return shards(spark).groupBy("server_id").agg(F.count(F.lit(1)).alias("shards"))


@query(B.with_(SHARDS, body="SELECT coalesce(s.range_point, u.p)::INTEGER AS range_point, coalesce(u.i, s.server_id)::INTEGER AS server_id FROM shard_map s FULL JOIN (SELECT unnest([42949672, 85899345, 7]) AS p, unnest([4, 4, 2]) AS i) u ON s.range_point = u.p"))
def upd_shard_map(spark, d):
    return placement.update_map(shards(spark), spark.createDataFrame([([42949672, 85899345, 7], [4, 4, 2])], "range_points array<int>, server_ids array<int>"))


@query(B.with_(SHARDS, body="SELECT range_point, CASE WHEN range_point IN (42949672, 2147483647) THEN 3 ELSE server_id END::INTEGER AS server_id FROM shard_map"))
def op_move_shard(spark, d):
    return placement.move(shards(spark), spark.createDataFrame([(42949672, 3), (2147483647, 3)], "range_point int, to_server int"))


@query(B.with_(B.DIRECTORY, B.FILES, B.part_hash(), SHARDS, body="""SELECT st_ino, CASE WHEN range_point IN (42949672, 2147483647) THEN 3 ELSE server_id END::INTEGER AS server_id
    FROM (SELECT st_ino, hash FROM files JOIN part_hash ON part = parentid_partid & 8191) f ASOF JOIN shard_map s ON f.hash <= s.range_point"""))
def sink_copy_binary(spark, d):
    """Where each file's row lies after two shards have moved."""
    return placement.with_shard(S.files(spark, d).select("st_ino", "parentid_partid"), H.part_of(F.col("parentid_partid")), op_move_shard(spark, d)).select("st_ino", "server_id")


@query(B.with_(SHARDS, body="""
SELECT range_point, from_server, to_server FROM (
    SELECT range_point, server_id AS from_server, row_number() OVER (ORDER BY server_id, range_point DESC) AS k
    FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY range_point) AS n FROM shard_map) WHERE server_id NOT IN (1, 2, 5, 6) OR n > 13
) JOIN (
    SELECT to_server, row_number() OVER (ORDER BY round, to_server) AS k
    FROM (SELECT t AS to_server, unnest(range(1, greatest(13 - coalesce(held, 0), 0) + 1)) AS round FROM (SELECT unnest([1, 2, 5, 6]) AS t) LEFT JOIN (SELECT server_id, count(*) AS held FROM shard_map GROUP BY 1) ON server_id = t)
) USING (k)"""))
def plan_rebalance(spark, d):
    return R.rebalance_to(shards(spark), spark.createDataFrame([(i,) for i in (1, 2, 5, 6)], "server_id int"))


@query(B.with_(*B.NAMESPACE, body="SELECT req_id, st_ino, st_size FROM located"))
def join_req_inode(spark, d):
    return N.with_inode(N.resolve(S.file_requests(spark, d), S.directories(spark, d)), S.inodes(spark, d)).select("req_id", "st_ino", "st_size")


@query(B.with_(*B.NAMESPACE, body="SELECT st_ino, parentid_partid, name FROM located WHERE error_code = 0"))
def scan_index_eq(spark, d):
    """Inode rows by (parentid_partid, name), a batch of keys at a time."""
    keys = N.resolve(S.file_requests(spark, d), S.directories(spark, d)).select(H.combine(F.col("parent_id"), H.part_id(F.col("name"))).alias("parentid_partid"), "name")
    return S.inodes(spark, d).join(keys, ["parentid_partid", "name"]).select("st_ino", "parentid_partid", "name")


@query(B.with_(B.DIRECTORY, B.FILES, B.INODE, body="SELECT st_ino, name FROM inode WHERE parentid_partid BETWEEN (1000 + 1)::BIGINT * 4096 * 8192 AND (1000 + 400)::BIGINT * 4096 * 8192 + 8191"))
def scan_index_range(spark, d):
    """Children of a range of directories, by bounds on the key."""
    low, high = (1001 << 12) << 13, ((1400 << 12) << 13) | 8191
    return S.inodes(spark, d).filter(F.col("parentid_partid").between(low, high)).select("st_ino", "name")


@query("SELECT doc_id FROM documents WHERE source LIKE 'src1%' OR lang LIKE '_s'")
def scan_prefix_like(spark, d):
    return S.table(spark, d, "documents").filter(F.col("source").startswith("src1") | F.col("lang").like("_s")).select("doc_id")


@query(B.with_(B.DIRECTORY, body="SELECT name AS file_name, parent_id, inodeid, CASE WHEN inodeid % 3 = 0 THEN 'locked' ELSE 'no lock' END AS is_acquired FROM directory"))
def scan_dir_cache(spark, d):
    return S.directories(spark, d).select(F.col("name").alias("file_name"), "parent_id", "inodeid", F.when(F.col("inodeid") % 3 == 0, "locked").otherwise("no lock").alias("is_acquired"))


@query(B.with_(B.DIRECTORY, B.FILES, B.INODE, body="SELECT d.inodeid, count(i.st_ino) AS children FROM directory d LEFT JOIN inode i ON i.parent = d.inodeid GROUP BY 1"))
def join_children(spark, d):
    inode = S.inodes(spark, d).select(H.parent_of(F.col("parentid_partid")).alias("inodeid"), "st_ino")
    counts = inode.groupBy("inodeid").agg(F.count("st_ino").alias("children"))
    return S.directories(spark, d).join(counts, "inodeid", "left").select("inodeid", F.coalesce("children", F.lit(0)).cast("long").alias("children"))


@query(B.with_(B.DIRECTORY, B.FILES, B.INODE, body="SELECT inodeid FROM directory WHERE inodeid IN (SELECT parent FROM inode)"))
def join_nonempty(spark, d):
    return S.directories(spark, d).join(S.inodes(spark, d).select(H.parent_of(F.col("parentid_partid")).alias("inodeid")), "inodeid", "left_semi").select("inodeid")


@query(B.with_(B.DIRECTORY, B.FILES, B.INODE, body="SELECT inodeid FROM directory WHERE inodeid NOT IN (SELECT parent FROM inode)"))
def join_empty(spark, d):
    return S.directories(spark, d).join(S.inodes(spark, d).select(H.parent_of(F.col("parentid_partid")).alias("inodeid")), "inodeid", "left_anti").select("inodeid")


@query(B.with_(B.SERVERS, body="SELECT server_id, host FROM (SELECT unnest(range(3, 9))::INTEGER AS server_id, 'h' || unnest(range(3, 9)) AS host) WHERE server_id NOT IN (SELECT server_id FROM servers)"))
def join_existing(spark, d):
    wanted = spark.range(3, 9).select(F.col("id").cast("int").alias("server_id"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"))
    return cluster.missing_servers(S.servers(spark), wanted)


@query(B.with_(B.SERVERS, body="SELECT n_nationkey, server_id FROM nation, servers WHERE server_id NOT IN (0, 2)"))
def join_broadcast_dim(spark, d):
    return cluster.fan_out(S.servers(spark), S.table(spark, d, "nation").select("n_nationkey"), [0, 2])


@query(B.with_(B.SERVERS, body="SELECT server_id, server_name FROM servers WHERE server_id NOT IN (0, 2)"))
def set_except_ids(spark, d):
    return S.servers(spark).filter(~F.col("server_id").isin(0, 2)).select("server_id", "server_name")


@query(B.with_(B.KV, body="SELECT 'doc_' || item_id AS user_key, value_len FROM benchmark LEFT JOIN kv ON user_key = 'doc_' || item_id"))
def join_req_kv(spark, d):
    wanted = S.table(spark, d, "benchmark").select(F.concat(F.lit("doc_"), F.col("item_id").cast("string")).alias("user_key"))
    return wanted.join(S.kv_rows(spark, d).select("user_key", "value_len"), "user_key", "left")


@query(B.with_(B.SLICES, body="SELECT st, count(inodeid) AS n, coalesce(sum(slicelen), 0)::BIGINT AS total FROM (SELECT (10000000 + o_orderkey) * 4096 AS st FROM orders) LEFT JOIN slices ON inodeid = st GROUP BY 1"))
def join_req_slice(spark, d):
    wanted = S.table(spark, d, "orders").select(S.ident(10_000_000 + F.col("o_orderkey")).alias("st"))
    sums = S.slices(spark, d).groupBy(F.col("inodeid").alias("st")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("slicelen").cast("long")).alias("total"))
    return wanted.join(sums, "st", "left").select("st", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))


VIEWS = "(SELECT s_suppkey AS node, '10.0.0.' || s_suppkey || ':55' AS endpoint FROM supplier WHERE s_suppkey % 5 <> 0) a FULL JOIN (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 7 = 0 THEN '10.9.0.' || s_suppkey || ':55' ELSE '10.0.0.' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ':55' ELSE ':66' END END AS endpoint FROM supplier WHERE s_suppkey % 3 <> 0) b ON a.node = b.node"


def views(spark, d):
    k = F.col("s_suppkey")
    text = k.cast("string")
    supplier = S.table(spark, d, "supplier")
    one = supplier.filter(k % 5 != 0).select(k.alias("node"), F.concat(F.lit("10.0.0."), text, F.lit(":55")).alias("endpoint"))
    two = F.when(k % 7 == 0, F.concat(F.lit("10.9.0."), text, F.lit(":55"))).otherwise(F.concat(F.lit("10.0.0."), text, F.when(k % 2 == 0, ":55").otherwise(":66")))
    return one, supplier.filter(k % 3 != 0).select(k.alias("node"), two.alias("endpoint"))


@query(f"SELECT coalesce(a.node, b.node) AS node, CASE WHEN b.node IS NULL THEN 'only_registered' WHEN a.node IS NULL THEN 'only_known' WHEN a.endpoint = b.endpoint THEN 'same' ELSE 'changed' END AS state FROM {VIEWS}")
def join_cluster_check(spark, d):
    return cluster.compare_views(*views(spark, d))


@query(f"SELECT coalesce(a.node, b.node) AS node, CASE WHEN b.node IS NULL THEN 'drop' WHEN a.node IS NULL THEN 'add' WHEN split_part(a.endpoint, ':', 1) = split_part(b.endpoint, ':', 1) THEN 'keep' ELSE 'replace' END AS action FROM {VIEWS}")
def set_view_diff(spark, d):
    return cluster.refresh_nodes(*views(spark, d))


@query("SELECT false AS same")
def set_equal(spark, d):
    return cluster.same_sets(*views(spark, d))


HOSTS = "(SELECT 'h' || s_suppkey AS host, CASE WHEN s_suppkey % 4 = 0 THEN 'cn' ELSE 'dn' END AS kind, s_suppkey AS k FROM supplier)"


def hosts(spark, d):
    k = F.col("s_suppkey")
    return S.table(spark, d, "supplier").select(F.concat(F.lit("h"), k.cast("string")).alias("host"), F.when(k % 4 == 0, "cn").otherwise("dn").alias("kind"), k.alias("k"))


@query(f"SELECT host, CASE WHEN k % 3 = 0 THEN 'spare' WHEN kind = 'cn' THEN CASE WHEN k % 2 = 0 THEN 'cn' END ELSE 'dn' || k % 5 END AS cluster FROM {HOSTS}")
def join_find_cluster(spark, d):
    rows = hosts(spark, d)
    members = rows.filter("k % 3 <> 0").select("host", F.when(F.col("kind") == "cn", "cn").otherwise(F.concat(F.lit("dn"), (F.col("k") % 5).cast("string"))).alias("cluster"))
    return cluster.find_cluster(rows.select("host", "kind"), members)


@query(f"WITH t AS (SELECT kind, k AS ticket, row_number() OVER (PARTITION BY kind ORDER BY k) AS n FROM {HOSTS} WHERE k % 3 = 0), s AS (SELECT kind, host, row_number() OVER (PARTITION BY kind ORDER BY host) AS n FROM {HOSTS} WHERE k % 3 = 1 AND k % 2 = 0) SELECT ticket, kind, host FROM t JOIN s USING (kind, n)")
def join_supplement(spark, d):
    rows = hosts(spark, d)
    return cluster.supplement(rows.filter("k % 3 = 0").select("kind", F.col("k").alias("ticket")), rows.filter("k % 3 = 1 and k % 2 = 0").select("kind", "host"))


@query(f"SELECT host, CASE WHEN i // 3 < (a - 4) // 3 THEN 'dn' || i // 3 ELSE 'spare' END AS cluster FROM (SELECT host, row_number() OVER (ORDER BY host) - 1 AS i, count(*) OVER () AS a FROM {HOSTS})")
def win_cluster_assign(spark, d):
    return cluster.assign_clusters(hosts(spark, d).select("host"), replicas=2, spares=4)
