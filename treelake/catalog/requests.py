"""Requests on the namespace, records and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import namespace as N
from ..operators import placement, records
from ..schema import FILE_TYPE
from ..sources import namespace as S
from . import base as B
from . import query

NOW = "2026-01-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def state(spark: SparkSession, d: str):
    return S.directories(spark, d), S.inodes(spark, d)


def some_requests(spark: SparkSession, d: str) -> DataFrame:
    return S.file_requests(spark, d)


STAT = ", ".join(N.STAT_COLUMNS)


@query(B.with_(*B.NAMESPACE, body=f"SELECT req_id, error_code, {STAT} FROM located"))
def op_stat(spark, d):
    return N.stat(some_requests(spark, d), *state(spark, d))


@query(
    B.with_(
        *B.NAMESPACE,
        body="""SELECT req_id, error_code, st_ino, st_size, st_nlink, st_mode, primary_nodeid, CASE WHEN error_code = 0 THEN 0 END::INTEGER AS st_uid, CASE WHEN error_code = 0 THEN 0 END::INTEGER AS st_gid,
        CASE WHEN error_code = 0 THEN 0 END::BIGINT AS update_version, CASE WHEN error_code = 0 THEN '' END AS etag FROM located""",
    )
)
def op_open(spark, d):
    return N.open_files(some_requests(spark, d), *state(spark, d))


def changed(rows: DataFrame, old: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("st_ino", *columns)


@query(B.with_(*B.NAMESPACE, body=f"SELECT i.st_ino, CASE WHEN r.st_ino IS NULL THEN i.st_size ELSE r.req_id * 10 END::BIGINT AS st_size, CASE WHEN r.st_ino IS NULL THEN i.primary_nodeid ELSE 3 END::INTEGER AS primary_nodeid, CASE WHEN r.st_ino IS NULL THEN i.st_mtim ELSE TIMESTAMP '{NOW}' END AS st_mtim FROM inode i LEFT JOIN (SELECT * FROM located WHERE error_code = 0 AND req_id > 0) r ON i.st_ino = r.st_ino"))
def op_close(spark, d):
    requests = some_requests(spark, d).filter("req_id > 0").withColumn("new_size", F.col("req_id") * 10).withColumn("node_id", F.lit(3))
    return N.close(requests, *state(spark, d), now())[1].select("st_ino", "st_size", "primary_nodeid", "st_mtim")


@query(B.with_(*B.NAMESPACE, body=f"SELECT i.st_ino, CASE WHEN r.st_ino IS NULL THEN i.st_atim WHEN r.req_id % 2 = 0 THEN TIMESTAMP '{NOW}' ELSE make_timestamp(1609459200000000) END AS st_atim, CASE WHEN r.st_ino IS NULL THEN i.st_mtim WHEN r.req_id % 2 = 0 THEN TIMESTAMP '{NOW}' ELSE make_timestamp(1640995200000000) END AS st_mtim FROM inode i LEFT JOIN (SELECT * FROM located WHERE error_code = 0 AND req_id > 0) r ON i.st_ino = r.st_ino"))
def op_utimens(spark, d):
    requests = some_requests(spark, d).filter("req_id > 0").withColumn("new_atim", F.when(F.col("req_id") % 2 == 0, -1).otherwise(1609459200000000).cast("long")).withColumn("new_mtim", F.lit(1640995200000000).cast("long"))
    return N.utimens(requests, *state(spark, d), now())[1].select("st_ino", "st_atim", "st_mtim")


@query(B.with_(*B.NAMESPACE, body="SELECT i.st_ino, CASE WHEN r.st_ino IS NULL THEN i.st_uid ELSE (r.req_id % 100) END::INTEGER AS st_uid, CASE WHEN r.st_ino IS NULL THEN i.st_gid ELSE 5 END::INTEGER AS st_gid FROM inode i LEFT JOIN (SELECT * FROM located WHERE error_code = 0 AND req_id > 0) r ON i.st_ino = r.st_ino"))
def op_chown(spark, d):
    requests = some_requests(spark, d).filter("req_id > 0").withColumn("new_uid", (F.col("req_id") % 100).cast("int")).withColumn("new_gid", F.lit(5))
    return N.chown(requests, *state(spark, d))[1].select("st_ino", "st_uid", "st_gid")


@query(B.with_(*B.NAMESPACE, body="SELECT i.st_ino, CASE WHEN r.st_ino IS NULL THEN i.st_mode ELSE (i.st_mode & ~511) | (384 & 511) END::INTEGER AS st_mode FROM inode i LEFT JOIN (SELECT * FROM located WHERE error_code = 0) r ON i.st_ino = r.st_ino"))
def op_chmod(spark, d):
    return N.chmod(some_requests(spark, d).withColumn("new_mode", F.lit(0o600)), *state(spark, d))[1].select("st_ino", "st_mode")


CREATE_SQL = """, wanted AS (
    SELECT req_id, path FROM requests WHERE req_id > 0 AND req_id % 3 = 0
    UNION ALL SELECT req_id + 100000000, regexp_replace(path, 'o([0-9]+)$', 'n\\1') FROM requests WHERE req_id > 0 AND req_id % 5 = 0
    UNION ALL SELECT req_id + 200000000, regexp_replace(path, 'o([0-9]+)$', 'n\\1') FROM requests WHERE req_id > 0 AND req_id % 10 = 0
    UNION ALL SELECT -1, '/nope/x'
), placed AS (
    SELECT w.*, t.inodeid AS parent, p.st_ino AS old, p.st_mode AS m, p.st_nlink AS l, p.st_size AS s, p.primary_nodeid AS n, row_number() OVER (PARTITION BY w.path ORDER BY w.req_id) AS turn
    FROM wanted w LEFT JOIN tree t ON t.path = regexp_replace(w.path, '/[^/]*$', '') LEFT JOIN places p ON p.full_path = w.path
), coded AS (
    SELECT *, CASE WHEN parent IS NULL THEN 1 WHEN old IS NOT NULL OR turn > 1 THEN 13 ELSE 0 END AS error_code FROM placed
), fresh AS (
    SELECT path, parent, (500000000 - 1 + row_number() OVER (ORDER BY path, req_id)) * 4096 AS made FROM coded WHERE error_code = 0
)"""


def create_requests(spark, d):
    rows = some_requests(spark, d).filter("req_id > 0")
    renamed = F.regexp_replace("path", "o([0-9]+)$", "n$1")
    one = rows.filter("req_id % 5 = 0").select(F.col("req_id") + 100_000_000, renamed)
    two = rows.filter("req_id % 10 = 0").select(F.col("req_id") + 200_000_000, renamed)
    return rows.filter("req_id % 3 = 0").union(one).union(two).union(spark.createDataFrame([(-1, "/nope/x")], "req_id long, path string"))


@query(B.with_(*B.NAMESPACE, body="").rstrip() + CREATE_SQL + """
SELECT req_id, error_code, coalesce(old, made) AS st_ino, CASE WHEN made IS NOT NULL AND old IS NULL THEN 33188 ELSE m END::INTEGER AS st_mode, CASE WHEN made IS NOT NULL AND old IS NULL THEN 1 ELSE l END::BIGINT AS st_nlink,
    CASE WHEN made IS NOT NULL AND old IS NULL THEN 0 ELSE s END::BIGINT AS st_size, CASE WHEN made IS NOT NULL AND old IS NULL THEN -1 ELSE n END::INTEGER AS primary_nodeid
FROM coded LEFT JOIN fresh USING (path)""")
def op_create(spark, d):
    return N.create(create_requests(spark, d), *state(spark, d), 500_000_000, now())[0]


@query(B.with_(*B.NAMESPACE, body="").rstrip() + CREATE_SQL + f"""
SELECT st_ino, parentid_partid, name FROM inode UNION ALL SELECT made, {B.combine('parent', 'name')}, name FROM (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM fresh)""")
def op_create_state(spark, d):
    return N.create(create_requests(spark, d), *state(spark, d), 500_000_000, now())[1].select("st_ino", "parentid_partid", "name")


MKDIR_SQL = """, wanted(req_id, path) AS (
    SELECT c_custkey, '/asia/new_' || (c_custkey % 20) FROM customer
    UNION ALL SELECT c_custkey + 1000000, '/asia/new_' || (c_custkey % 20) || '/sub_' || c_custkey FROM customer
    UNION ALL SELECT unnest([-1, -2, -3, -4]), unnest(['/asia', '/nope/a', 'x', '/nope/a/b'])
), coded AS (
    SELECT req_id, path, CASE WHEN path NOT LIKE '/%' THEN 1 WHEN path = '/asia' THEN 3 WHEN path LIKE '/nope/%' THEN 1
        WHEN row_number() OVER (PARTITION BY path ORDER BY req_id) > 1 THEN 3 ELSE 0 END AS error_code FROM wanted
), ids AS (
    SELECT path, (900000 - 1 + row_number() OVER (ORDER BY replace(path, '/', chr(1)))) * 4096 AS st_ino FROM (SELECT DISTINCT path FROM wanted WHERE path LIKE '/%')
)"""


def mkdir_requests(spark, d):
    customer = S.table(spark, d, "customer").select("c_custkey")
    top = F.concat(F.lit("/asia/new_"), (F.col("c_custkey") % 20).cast("string"))
    one = customer.select(F.col("c_custkey").alias("req_id"), top.alias("path"))
    two = customer.select(F.col("c_custkey") + 1_000_000, F.concat(top, F.lit("/sub_"), F.col("c_custkey").cast("string")))
    return one.union(two).union(spark.createDataFrame([(-1, "/asia"), (-2, "/nope/a"), (-3, "x"), (-4, "/nope/a/b")], "req_id long, path string"))


@query(B.with_(B.DIRECTORY, body="").rstrip() + MKDIR_SQL + " SELECT req_id, error_code, CASE WHEN error_code = 0 THEN st_ino END AS st_ino FROM coded LEFT JOIN ids USING (path)")
def op_mkdir(spark, d):
    return N.mkdir(mkdir_requests(spark, d), *state(spark, d), 900_000, now())[0]


@query(B.with_(B.DIRECTORY, body="").rstrip() + MKDIR_SQL + """
SELECT * FROM directory UNION ALL SELECT CASE WHEN path LIKE '/asia/%/%' THEN p.st_ino ELSE (100 + 2) * 4096 END, regexp_extract(path, '[^/]*$'), i.st_ino
FROM (SELECT * FROM coded WHERE error_code = 0) c JOIN ids i USING (path) LEFT JOIN ids p ON p.path = regexp_replace(c.path, '/[^/]*$', '')""")
def op_mkdir_sub_mkdir(spark, d):
    return N.mkdir(mkdir_requests(spark, d), *state(spark, d), 900_000, now())[1]


@query(B.with_(*B.NAMESPACE, body="").rstrip() + MKDIR_SQL + " SELECT i.st_ino, 16877 AS st_mode, 2::BIGINT AS st_nlink, 0::BIGINT AS st_size FROM coded JOIN ids i USING (path) WHERE error_code = 0")
def op_mkdir_sub_create(spark, d):
    made = N.mkdir(mkdir_requests(spark, d), *state(spark, d), 900_000, now())[2]
    return made.filter(f"st_mode = 16877 and st_ctim = timestamp_ntz'{NOW}'").select("st_ino", "st_mode", "st_nlink", "st_size")


def unlink_requests(spark, d):
    rows = some_requests(spark, d).filter("req_id % 4 = 0 or req_id < 0")
    return rows.union(rows.filter("req_id % 8 = 0 and req_id > 0").select(F.col("req_id") + 100_000_000, "path"))


UNLINK_SQL = """, wanted AS (
    SELECT * FROM located WHERE req_id % 4 = 0 OR req_id < 0 UNION ALL SELECT l.* REPLACE (req_id + 100000000 AS req_id) FROM located l WHERE req_id % 8 = 0 AND req_id > 0
), coded AS (
    SELECT * EXCLUDE (error_code), CASE WHEN error_code <> 0 THEN error_code WHEN st_mode & 61440 <> 32768 THEN 6 WHEN row_number() OVER (PARTITION BY st_ino ORDER BY req_id) > 1 THEN 14 ELSE 0 END AS error_code FROM wanted
)"""


@query(B.with_(*B.NAMESPACE, body="").rstrip() + UNLINK_SQL + " SELECT req_id, error_code, CASE WHEN error_code = 0 THEN st_ino END AS st_ino, CASE WHEN error_code = 0 THEN st_size END AS st_size, CASE WHEN error_code = 0 THEN primary_nodeid END AS primary_nodeid FROM coded")
def op_unlink(spark, d):
    return N.unlink(unlink_requests(spark, d), *state(spark, d))[0]


@query(B.with_(*B.NAMESPACE, body="").rstrip() + UNLINK_SQL + " SELECT st_ino, name FROM inode WHERE st_ino NOT IN (SELECT st_ino FROM coded WHERE error_code = 0)")
def op_unlink_state(spark, d):
    return N.unlink(unlink_requests(spark, d), *state(spark, d))[1].select("st_ino", "name")


SHARDED = (B.DIRECTORY, B.FILES, B.INODE, B.part_hash(), B.shard_map())
READDIR = """SELECT parent AS dir_id, (SELECT min(range_point) FROM shard_map WHERE range_point >= h.hash) AS range_point, parentid_partid, name, st_mode
    FROM inode JOIN part_hash h ON h.part = parentid_partid & 8191 WHERE parent IN (SELECT inodeid FROM directory WHERE parent_id <> 0)"""


def all_dirs(spark, d):
    return S.directories(spark, d).filter("parent_id <> 0").select(F.col("inodeid").alias("dir_id"))


@query(B.with_(*SHARDED, body=READDIR))
def op_readdir(spark, d):
    return N.readdir(all_dirs(spark, d), S.inodes(spark, d), placement.build(spark, 50, 4))


@query(B.with_(*SHARDED, body=f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY dir_id ORDER BY range_point, parentid_partid, name) AS n FROM ({READDIR})) WHERE n <= 5"))
def limit_page(spark, d):
    return N.readdir(all_dirs(spark, d), S.inodes(spark, d), placement.build(spark, 50, 4), most=5)


@query(B.with_(*SHARDED, body=f"SELECT * FROM ({READDIR}) WHERE (range_point, parentid_partid, name) > (1000000000, 0, '')"))
def scan_index_gt(spark, d):
    return N.readdir(all_dirs(spark, d), S.inodes(spark, d), placement.build(spark, 50, 4), after=(1_000_000_000, 0, ""))


@query(B.with_(*SHARDED, body=f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY range_point, parentid_partid, name) AS n FROM (SELECT r.*, m.server_id FROM ({READDIR}) r JOIN shard_map m USING (range_point))) WHERE n <= 100"))
def limit_client_merge(spark, d):
    rows = N.readdir(all_dirs(spark, d), S.inodes(spark, d), placement.build(spark, 50, 4)).join(F.broadcast(placement.build(spark, 50, 4)), "range_point")
    return rows.withColumn("n", F.expr("row_number() over (partition by server_id order by range_point, parentid_partid, name)")).filter("n <= 100").drop("n")


DIR_REQUESTS = """wanted AS (
    SELECT c_custkey AS req_id, '/' || lower(replace(r_name, ' ', '_')) || '/' || lower(n_name) || '/c' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '' END AS path
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT unnest([-1, -2, -3]), unnest(['/', '/asia/none', 'asia'])
)"""


def dir_requests(spark, d):
    rows = S.table(spark, d, "customer").join(S.table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(S.table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    path = F.concat(F.lit("/"), F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))), F.lit("/"), F.lower("n_name"), F.lit("/c"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "/").otherwise(""))
    return rows.select(F.col("c_custkey").alias("req_id"), path.alias("path")).union(spark.createDataFrame([(-1, "/"), (-2, "/asia/none"), (-3, "asia")], "req_id long, path string"))


OPENDIR = "SELECT req_id, CASE WHEN path NOT LIKE '/%' THEN 1 WHEN t.inodeid IS NULL THEN 4 ELSE 0 END AS error_code, t.inodeid AS st_ino FROM (SELECT req_id, w.path, rtrim(w.path, '/') AS clean FROM wanted w) LEFT JOIN (SELECT inodeid, path AS whole FROM tree) t ON whole = clean AND path LIKE '/%'"


@query(B.with_(B.DIRECTORY, B.TREE, DIR_REQUESTS, body=OPENDIR))
def op_opendir(spark, d):
    return N.opendir(dir_requests(spark, d), S.directories(spark, d))


RMDIR = f"""coded AS (SELECT req_id, st_ino, CASE WHEN error_code <> 0 THEN error_code WHEN st_ino = 4096 THEN 2 WHEN st_ino IN (SELECT parent FROM inode) THEN 11 ELSE 0 END AS error_code FROM ({OPENDIR}))"""


def emptied(spark, d):
    """The state without the files of every third customer."""
    dirs, inode = state(spark, d)
    return dirs, inode.filter(~((F.col("st_mode") == 33188) & ((H.parent_of(F.col("parentid_partid")) / 4096).cast("long") % 3 == 0)))


EMPTIED = B.INODE.replace("inode AS (", "inode AS (SELECT * FROM (").rstrip(")").rstrip() + ") WHERE NOT (st_mode = 33188 AND (parent // 4096) % 3 = 0))"


@query(B.with_(B.DIRECTORY, B.FILES, EMPTIED, B.TREE, DIR_REQUESTS, RMDIR, body="SELECT req_id, error_code FROM coded"))
def op_rmdir(spark, d):
    return N.rmdir(dir_requests(spark, d), *emptied(spark, d))[0]


@query(B.with_(B.DIRECTORY, B.FILES, EMPTIED, B.TREE, DIR_REQUESTS, RMDIR, body="SELECT * FROM directory WHERE inodeid NOT IN (SELECT st_ino FROM coded WHERE error_code = 0)"))
def op_rmdir_sub_rmdir(spark, d):
    return N.rmdir(dir_requests(spark, d), *emptied(spark, d))[1]


@query(B.with_(B.DIRECTORY, B.FILES, EMPTIED, B.TREE, DIR_REQUESTS, RMDIR, body="SELECT st_ino, name FROM inode WHERE st_ino NOT IN (SELECT st_ino FROM coded WHERE error_code = 0)"))
def op_rmdir_sub_unlink(spark, d):
    return N.rmdir(dir_requests(spark, d), *emptied(spark, d))[2].select("st_ino", "name")


RENAMES = """wanted AS (
    SELECT req_id, path AS src, CASE WHEN req_id % 3 = 0 THEN path || '_moved' WHEN req_id % 3 = 1 THEN '/asia/f' || (req_id % 50) ELSE path END AS dst FROM requests WHERE req_id > 0
    UNION ALL SELECT unnest([-1, -2, -3, -4]), unnest(['/asia/china', '/asia/china', '/none/a', '/asia/none']), unnest(['/europe/china', '/asia/china/x', '/asia/y', '/asia/z'])
), coded AS (
    SELECT w.*, s.st_ino AS src_ino, s.parentid_partid AS src_key, t.inodeid AS dst_parent, CASE
        WHEN sp.inodeid IS NULL OR t.inodeid IS NULL THEN 1 WHEN dst LIKE src || '/%' THEN 5 WHEN s.st_ino IS NULL THEN 14 WHEN x.st_ino IS NOT NULL THEN 13
        WHEN row_number() OVER (PARTITION BY dst ORDER BY req_id) > 1 THEN 13 ELSE 0 END AS error_code
    FROM wanted w LEFT JOIN places s ON s.full_path = src LEFT JOIN places x ON x.full_path = dst
    LEFT JOIN tree sp ON sp.path = regexp_replace(src, '/[^/]*$', '') LEFT JOIN tree t ON t.path = regexp_replace(dst, '/[^/]*$', '')
)"""


def rename_requests(spark, d):
    rows = some_requests(spark, d).filter("req_id > 0")
    dst = F.when(F.col("req_id") % 3 == 0, F.concat("path", F.lit("_moved"))).when(F.col("req_id") % 3 == 1, F.concat(F.lit("/asia/f"), (F.col("req_id") % 50).cast("string"))).otherwise(F.col("path"))
    odd = [(-1, "/asia/china", "/europe/china"), (-2, "/asia/china", "/asia/china/x"), (-3, "/none/a", "/asia/y"), (-4, "/asia/none", "/asia/z")]
    return rows.select("req_id", F.col("path").alias("src"), dst.alias("dst")).union(spark.createDataFrame(odd, "req_id long, src string, dst string"))


@query(B.with_(*B.NAMESPACE, RENAMES, body="SELECT req_id, error_code FROM coded"))
def op_rename(spark, d):
    return N.rename(rename_requests(spark, d), *state(spark, d))[0]


@query(B.with_(*B.NAMESPACE, RENAMES, body=f"SELECT i.st_ino, coalesce(c.new_name, i.name) AS name, coalesce({B.combine('c.dst_parent', 'c.new_name')}, i.parentid_partid) AS parentid_partid, i.st_size FROM inode i LEFT JOIN (SELECT *, regexp_extract(dst, '[^/]*$') AS new_name FROM coded WHERE error_code = 0) c ON c.src_ino = i.st_ino"))
def op_rename_local(spark, d):
    return N.rename(rename_requests(spark, d), *state(spark, d))[2].select("st_ino", "name", "parentid_partid", "st_size")


@query(B.with_(*B.NAMESPACE, RENAMES, B.part_hash(), B.shard_map(), body=f"""
SELECT c.src_ino AS st_ino, '' AS etag, 0::BIGINT AS update_version, -1 AS backup_nodeid FROM (SELECT *, {B.part_id("regexp_extract(dst, '[^/]*$')")} AS to_part FROM coded WHERE error_code = 0) c
JOIN part_hash a ON a.part = src_key & 8191 JOIN part_hash b ON b.part = c.to_part
WHERE (SELECT arg_min(server_id, range_point) FROM shard_map WHERE range_point >= a.hash) <> (SELECT arg_min(server_id, range_point) FROM shard_map WHERE range_point >= b.hash)"""))
def op_rename_create(spark, d):
    """Rows that a rename takes to another server: their tag and version start anew. Before it, every row has some."""
    dirs, inode = state(spark, d)
    inode = inode.withColumns({"etag": F.concat(F.lit("e"), "name"), "update_version": F.lit(7).cast("long"), "backup_nodeid": F.lit(2)})
    after = N.rename(rename_requests(spark, d), dirs, inode, shard_map=placement.build(spark, 50, 4))[2]
    return after.filter("update_version = 0").select("st_ino", "etag", "update_version", "backup_nodeid")


KV_REQUESTS = """wanted AS (
    SELECT doc_id AS req_id, 'doc_' || doc_id AS user_key FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id + 1000000, 'new_' || (doc_id % 40) FROM documents WHERE doc_id % 5 = 0
)"""


def kv_requests(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id")
    one = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("req_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("user_key"))
    return one.union(docs.filter("doc_id % 5 = 0").select(F.col("doc_id") + 1_000_000, F.concat(F.lit("new_"), (F.col("doc_id") % 40).cast("string"))))


@query(B.with_(B.KV, KV_REQUESTS, body="SELECT user_key, value_len, slice_num, value_key, location, slice_len FROM kv UNION ALL SELECT user_key, (min(req_id) % 1000)::INTEGER, 1::SMALLINT, [min(req_id)], [0::BIGINT], [4096] FROM wanted WHERE user_key NOT IN (SELECT user_key FROM kv) GROUP BY user_key"))
def op_kv_put(spark, d):
    rows = kv_requests(spark, d).select(
        "req_id", "user_key", (F.col("req_id") % 1000).cast("int").alias("value_len"), F.lit(1).cast("short").alias("slice_num"), F.array("req_id").alias("value_key"),
        F.array(F.lit(0).cast("long")).alias("location"), F.array(F.lit(4096)).alias("slice_len"),
    )
    return records.kv_put(rows, S.kv_rows(spark, d))[1]


@query(B.with_(B.KV, KV_REQUESTS, body="SELECT req_id, CASE WHEN kv.user_key IS NULL THEN 11 ELSE 0 END AS error_code, value_len, slice_num, value_key, location, slice_len FROM wanted LEFT JOIN kv USING (user_key)"))
def op_kv_get(spark, d):
    return records.kv_get(kv_requests(spark, d), S.kv_rows(spark, d))


@query(B.with_(B.KV, KV_REQUESTS, body="SELECT req_id, CASE WHEN kv.user_key IS NULL OR row_number() OVER (PARTITION BY wanted.user_key ORDER BY req_id) > 1 THEN 11 ELSE 0 END AS error_code FROM wanted LEFT JOIN kv USING (user_key)"))
def op_kv_del(spark, d):
    return records.kv_delete(kv_requests(spark, d), S.kv_rows(spark, d))[0]


CHUNKS = """wanted AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS req_id, (10000000 + o_orderkey) * 4096 AS inodeid, (o_orderkey % 8)::INTEGER AS chunkid FROM orders)"""


def chunk_requests(spark, d):
    orders = S.table(spark, d, "orders").select("o_orderkey").distinct()
    return N.ranked(orders, ["o_orderkey"], "req_id").select("req_id", S.ident(10_000_000 + F.col("o_orderkey")).alias("inodeid"), (F.col("o_orderkey") % 8).cast("int").alias("chunkid"))


@query(B.with_(B.SLICES, CHUNKS, body="""SELECT req_id, CASE WHEN s.inodeid IS NULL THEN 14 ELSE 0 END AS error_code, s.* EXCLUDE (inodeid, chunkid) FROM wanted LEFT JOIN (
    SELECT inodeid, chunkid, list(sliceoffset ORDER BY sliceoffset, slicesize, slicelen, sliceloc1, sliceloc2) AS sliceoffset, list(slicesize ORDER BY sliceoffset, slicesize, slicelen, sliceloc1, sliceloc2) AS slicesize,
        list(slicelen ORDER BY sliceoffset, slicesize, slicelen, sliceloc1, sliceloc2) AS slicelen, list(sliceloc1 ORDER BY sliceoffset, slicesize, slicelen, sliceloc1, sliceloc2) AS sliceloc1,
        list(sliceloc2 ORDER BY sliceoffset, slicesize, slicelen, sliceloc1, sliceloc2) AS sliceloc2 FROM slices GROUP BY 1, 2) s USING (inodeid, chunkid)"""))
def op_slice_get(spark, d):
    return records.slice_get(chunk_requests(spark, d), S.slices(spark, d))


@query(B.with_(B.SLICES, CHUNKS, body="SELECT * FROM slices WHERE (inodeid, chunkid) NOT IN (SELECT inodeid, chunkid FROM wanted)"))
def op_slice_del(spark, d):
    return records.slice_delete(chunk_requests(spark, d), S.slices(spark, d))[1]


@query("SELECT l_orderkey AS req_id, l_orderkey AS inodeid, 7 AS chunkid, (l_orderkey * 2 + i)::BIGINT AS sliceid, 4096 AS slicesize, (i * 4096)::INTEGER AS sliceoffset, 4096 AS slicelen, (1 + i)::INTEGER AS sliceloc1, (3 + i)::INTEGER AS sliceloc2 FROM (SELECT DISTINCT o_orderkey AS l_orderkey FROM orders), (SELECT unnest(range(2)) AS i)")
def op_slice_put(spark, d):
    k = F.col("o_orderkey")
    two = lambda a, b: F.array(F.lit(a), F.lit(b))
    rows = S.table(spark, d, "orders").select("o_orderkey").distinct().select(
        k.alias("req_id"), F.array(k, k).alias("inodeid"), two(7, 7).alias("chunkid"), F.array(k * 2, k * 2 + 1).alias("sliceid"), two(4096, 4096).alias("slicesize"),
        two(0, 4096).alias("sliceoffset"), two(4096, 4096).alias("slicelen"), two(1, 2).alias("sliceloc1"), two(3, 4).alias("sliceloc2"),
    )
    return records.slice_put(rows)


IDS = "SELECT event_id AS req_id, (event_id % 2)::INTEGER AS kind, (event_id % 7 + 1)::BIGINT AS count FROM events"


@query(f"SELECT req_id, kind, (sum(count) OVER w - count)::BIGINT AS first, (sum(count) OVER w)::BIGINT AS last FROM ({IDS}) WINDOW w AS (PARTITION BY kind ORDER BY req_id ROWS UNBOUNDED PRECEDING)")
def op_fetch_slice_id(spark, d):
    rows = S.table(spark, d, "events").select(F.col("event_id").alias("req_id"), (F.col("event_id") % 2).cast("int").alias("kind"), (F.col("event_id") % 7 + 1).alias("count"))
    return records.reserve_ids(rows)


win_id_range = query(f"SELECT kind, count(*) AS ranges, (max(last) - min(first))::BIGINT AS width, sum(last - first)::BIGINT AS given FROM (SELECT kind, sum(count) OVER w - count AS first, sum(count) OVER w AS last FROM ({IDS}) WINDOW w AS (PARTITION BY kind ORDER BY req_id ROWS UNBOUNDED PRECEDING)) GROUP BY kind")


@win_id_range
def win_id_range(spark, d):
    """Ranges do not overlap: together they are as wide as what they give."""
    return op_fetch_slice_id(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("ranges"), (F.max("last") - F.min("first")).alias("width"), F.sum(F.col("last") - F.col("first")).alias("given"))


@query(B.with_(*B.NAMESPACE, body="""SELECT i.st_ino, CASE WHEN st_mode = 33188 AND st_ino % 3 = 0 THEN 0 ELSE st_size END::BIGINT AS st_size, CASE WHEN st_mode = 33188 AND st_ino % 3 = 0 THEN 2 ELSE st_nlink END::BIGINT AS st_nlink,
    CASE WHEN st_mode = 33188 AND st_ino % 3 = 0 THEN update_version + 1 ELSE update_version END::BIGINT AS update_version FROM inode i WHERE NOT (st_mode = 33188 AND st_ino % 3 = 0 AND (st_ino // 4096) % 5 = 0)"""))
def upd_inode(spark, d):
    """New size and version for every third row if it is a file; of those, every fifth loses its last link, the others gain one."""
    inode = S.inodes(spark, d)
    links = F.when((F.expr("st_ino div 4096") % 5 == 0) & (F.col("st_mode") == 33188), -1).otherwise(1)
    changes = inode.filter("st_ino % 3 = 0").select("parentid_partid", "name", F.lit(0).cast("long").alias("st_size"), (F.col("update_version") + 1).alias("update_version"), links.alias("nlink_change"))
    return N.update_rows(inode, changes, ["st_size", "update_version"], FILE_TYPE).select("st_ino", "st_size", "st_nlink", "update_version")

