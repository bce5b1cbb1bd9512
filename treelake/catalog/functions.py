"""Scalar functions, each over a table of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats, hashing, paths
from ..operators import placement
from ..schema import BATCHED, ERRNO, ERROR_CODES, OPCODES, TRANSPORT_OPCODES, errno, error_name
from ..sources import namespace as S
from . import base as B
from . import query

URL_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"


def url_paths(spark, d):
    """page_id, path: URLs without scheme, host, query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    return S.table(spark, d, "pages").select("page_id", path.alias("path"))


def listed(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


@query(f"SELECT c_custkey, {B.part_id('c_name')} AS part FROM customer UNION ALL SELECT -page_id, {B.part_id('url')} FROM pages")
def fn_part_id(spark, d):
    one = S.table(spark, d, "customer").select("c_custkey", hashing.part_id(F.col("c_name")).alias("part"))
    return one.union(S.table(spark, d, "pages").select(-F.col("page_id"), hashing.part_id(F.col("url"))))


@query(f"SELECT c_custkey, {B.combine('c_custkey * 4096', 'c_name')} AS combined FROM customer")
def fn_combine(spark, d):
    return S.table(spark, d, "customer").select("c_custkey", hashing.combine(F.col("c_custkey") * 4096, hashing.part_id(F.col("c_name"))).alias("combined"))


@query(B.with_(B.DIRECTORY, B.FILES, body="SELECT st_ino, parentid_partid // 8192 AS parent, parentid_partid & 8191 AS part FROM files"))
def fn_split(spark, d):
    key = F.col("parentid_partid")
    return S.files(spark, d).select("st_ino", hashing.parent_of(key).alias("parent"), hashing.part_of(key).alias("part"))


@query(B.with_(B.part_hash(), body="SELECT part, hash FROM part_hash"))
def fn_shard_hash(spark, d):
    return spark.range(8192).select(F.col("id").alias("part"), hashing.shard_hash(F.col("id")).alias("hash"))


@query("SELECT o_orderkey, o_orderkey * 4096 + (o_custkey & 4095) AS ino FROM orders")
def fn_inode_id(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", hashing.inode_id(F.col("o_orderkey"), F.col("o_custkey")).alias("ino"))


@query("SELECT o_orderkey, (o_orderkey // 32) * 32 + 1 + o_orderkey % 32 AS seq FROM orders")
def fn_seq_block(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", hashing.sequence_block(F.col("o_orderkey")).alias("seq"))


@query(f"SELECT o_orderkey, CAST(({B.hash64('(o_orderkey * 4096)')})::UBIGINT % 9223372036854775807 AS BIGINT) AS h, CAST(({B.hash64('(o_orderkey * 4096)')}) % 7 AS BIGINT) AS m FROM orders")
def fn_hash64(spark, d):
    x = hashing.hash64(F.col("o_orderkey") * 4096)
    most = (1 << 63) - 1
    folded = F.when(x >= 0, F.when(x == most, F.lit(0)).otherwise(x)).otherwise(x.bitwiseAND(F.lit(most)) + 1)
    return S.table(spark, d, "orders").select("o_orderkey", F.when(folded == most, F.lit(0)).otherwise(folded).cast("long").alias("h"), hashing.unsigned_mod(x, 7).alias("m"))


@query(f"SELECT o_orderkey, ([1, 2, 3, 4, 7])[({B.hash64('(o_orderkey * 4096)')} % 5)::INTEGER + 1] AS node_id FROM orders")
def fn_alloc_node(spark, d):
    nodes = spark.createDataFrame([(n,) for n in (7, 1, 3, 2, 4)], "node_id int")
    return placement.alloc_node(S.table(spark, d, "orders"), F.col("o_orderkey") * 4096, nodes).select("o_orderkey", "node_id")


@query("SELECT s_suppkey AS node_id, coalesce(lead(s_suppkey) OVER (ORDER BY s_suppkey), min(s_suppkey) OVER ()) AS next_id FROM supplier")
def fn_next_node(spark, d):
    return placement.next_nodes(S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id")))


DJB = "list_reduce(list_prepend(5381::UHUGEINT, list_transform({b}, lambda b: b::UHUGEINT)), lambda h, b: (h * 33 + CASE WHEN b > 127 THEN b + 18446744073709551616::UHUGEINT - 256 ELSE b END) % 18446744073709551616::UHUGEINT)"


@query(f"SELECT page_id, CAST({DJB.format(b=B.signed_bytes('url'))} % 1000003 AS BIGINT) AS h FROM pages WHERE url <> ''")
def fn_djb2(spark, d):
    return S.table(spark, d, "pages").filter("url <> ''").select("page_id", hashing.unsigned_mod(hashing.djb2(F.col("url")), 1_000_003).alias("h"))


PARTS = "list_filter(string_split(path, '/'), lambda p: p <> '')"


@query(f"SELECT page_id, regexp_replace(path, '/[^/]*$', '') AS up, '/' || array_to_string(list_transform({PARTS}[1:greatest(CASE WHEN len({PARTS}) >= 3 THEN 2 ELSE len({PARTS}) - 1 END, 0)], lambda p: p || '/'), '') AS third FROM (SELECT page_id, {URL_PATH} AS path FROM pages)")
def fn_parent_path(spark, d):
    return url_paths(spark, d).select("page_id", paths.parent_path(F.col("path")).alias("up"), paths.parent_path(F.col("path"), 3).alias("third"))


@query(f"SELECT page_id, ([1, 2, 3, 4])[(CASE WHEN up = '' THEN {B.hash64('5381')} % 4 ELSE list_transform([({DJB.format(b=B.signed_bytes('up'))})::UBIGINT], lambda v: {B.hash64('v')} % 4)[1] END)::INTEGER + 1] AS node_id FROM (SELECT page_id, regexp_replace({URL_PATH}, '/[^/]*$', '') AS up FROM pages)")
def fn_path_node(spark, d):
    rows = url_paths(spark, d).withColumn("h", hashing.djb2(paths.parent_path(F.col("path"))))
    return placement.alloc_node(rows, F.col("h"), S.nodes(spark)).select("page_id", "node_id")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 9 WHEN o_orderkey % 3 = 1 THEN o_custkey % 4 + 1 ELSE ({B.hash64('(o_orderkey * 4096)')} % 4 + 1)::BIGINT END::BIGINT AS node_id FROM orders")
def fn_alloc_policy(spark, d):
    """The local node where asked for and there is room, else by path, else by number."""
    rows = placement.alloc_node(S.table(spark, d, "orders"), F.col("o_orderkey") * 4096, S.nodes(spark))
    k = F.col("o_orderkey") % 3
    node = F.when(k == 0, F.lit(9)).when(k == 1, F.col("o_custkey") % 4 + 1).otherwise(F.col("node_id"))
    return rows.select("o_orderkey", node.cast("long").alias("node_id"))


@query("SELECT o_orderkey, '/cache/' || (o_orderkey * 4096) % 100 || '/' || o_orderkey * 4096 || '-large' AS file FROM orders")
def fn_file_path(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", paths.cache_file("/cache", F.col("o_orderkey") * 4096, 100).alias("file"))


@query(f"SELECT page_id, CASE WHEN path = '' OR path NOT LIKE '/%' THEN 1 WHEN path = '/' OR path LIKE '%/' THEN 6 ELSE 0 END AS file_code, CASE WHEN path = '' OR path NOT LIKE '/%' THEN 1 ELSE 0 END AS any_code FROM (SELECT page_id, {URL_PATH} AS path FROM pages UNION ALL SELECT -page_id, url FROM pages)")
def fn_verify_path(spark, d):
    rows = url_paths(spark, d).union(S.table(spark, d, "pages").select(-F.col("page_id"), "url"))
    return rows.select("page_id", paths.verify(F.col("path"), directory=False).alias("file_code"), paths.verify(F.col("path")).alias("any_code"))


PATHS_SORTED = f"SELECT page_id, row_number() OVER (ORDER BY replace(path, '/', chr(1)), page_id)::INTEGER AS place FROM (SELECT page_id, {URL_PATH} AS path FROM pages)"


@query(PATHS_SORTED)
def fn_pathcmp(spark, d):
    return url_paths(spark, d).withColumn("_k", paths.sort_key(F.col("path"))).select("page_id", F.expr("row_number() over (order by _k, page_id)").alias("place"))


@query(PATHS_SORTED)
def sort_path(spark, d):
    """Parents before children."""
    rows = url_paths(spark, d).orderBy(paths.sort_key(F.col("path")), "page_id").withColumn("_k", paths.sort_key(F.col("path")))
    return rows.select("page_id", F.expr("row_number() over (order by _k, page_id)").alias("place"))


@query(f"SELECT page_id, CASE WHEN path = '/' THEN '/' ELSE regexp_extract(regexp_replace(path, '(.)/$', '\\1'), '([^/]*)$', 1) END AS name FROM (SELECT page_id, {URL_PATH} AS path FROM pages)")
def fn_route_name(spark, d):
    return url_paths(spark, d).select("page_id", paths.route_name(F.col("path")).alias("name"))


@query(B.with_(B.DIRECTORY, B.FILES, B.INODE, body="SELECT st_ino, CASE WHEN st_mode & 61440 = 32768 THEN 'file' WHEN st_mode & 61440 = 16384 THEN 'dir' ELSE 'other' END AS kind, st_mode & 511 AS bits FROM inode"))
def fn_mode_type(spark, d):
    return S.inodes(spark, d).select("st_ino", formats.file_type(F.col("st_mode")).alias("kind"), F.col("st_mode").bitwiseAND(F.lit(0o777)).alias("bits"))


@query("SELECT event_id, epoch_us(ts) - 946684800000000 AS pg, epoch_us(ts) AS unix FROM events")
def fn_pg_epoch(spark, d):
    micros = F.unix_micros("ts")
    rows = S.oplog(spark, d).select("event_id", formats.to_pg_micros(micros).alias("pg"))
    return rows.select("event_id", "pg", formats.from_pg_micros(F.col("pg")).alias("unix"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 99 WHEN 1 THEN 7 ELSE event_id * 1000000000 + 5 END::BIGINT AS ns FROM events")
def fn_utimens_resolve(spark, d):
    nanos = F.when(F.col("event_id") % 3 == 0, formats.UTIME_NOW).when(F.col("event_id") % 3 == 1, formats.UTIME_OMIT).otherwise(5)
    return S.table(spark, d, "events").select("event_id", formats.resolved_time(F.col("event_id"), nanos, F.lit(7), F.lit(99)).cast("long").alias("ns"))


@query(f"SELECT o_orderkey, ({listed([ERRNO.get(n, 5) for n in ERROR_CODES])})[(o_orderkey % {len(ERROR_CODES)})::INTEGER + 1]::INTEGER AS errno, ({listed(ERROR_CODES)})[(o_orderkey % {len(ERROR_CODES)})::INTEGER + 1] AS name FROM orders")
def fn_errno(spark, d):
    c = (F.col("o_orderkey") % len(ERROR_CODES)).cast("int")
    return S.table(spark, d, "orders").select("o_orderkey", errno(c).alias("errno"), error_name(c).alias("name"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 17 WHEN ascii(substr(text, 9, 1)) - 64 BETWEEN 1 AND {len(ERROR_CODES) - 1} THEN ascii(substr(text, 9, 1)) - 64 ELSE 25 END::INTEGER AS error_code FROM documents")
def fn_error_from_msg(spark, d):
    message = F.when(F.col("doc_id") % 10 != 0, F.col("text"))
    return S.table(spark, d, "documents").select("doc_id", formats.error_of_message(message).cast("int").alias("error_code"))


def scaled_sql(x: str, units: list[str]) -> str:
    steps = "".join(f" WHEN ({x} >> {10 * k}) < 10000 THEN ({x} >> {10 * k}) || '{u}'" for k, u in enumerate(units[:-1]))
    return f"CASE WHEN {x} = 0 THEN '0'{steps} ELSE ({x} >> {10 * (len(units) - 1)}) || '{units[-1]}' END"


AMOUNT = "(o_orderkey * o_orderkey * (o_custkey % 5) * (1 + (o_custkey % 3) * 100000))"


def amount():
    """As a decimal: from keys of some millions on it passes 64 bits."""
    k, c = F.col("o_orderkey").cast("decimal(20,0)"), F.col("o_custkey")
    factor = ((c % 5) * (1 + (c % 3) * 100_000)).cast("decimal(7,0)")
    return k * k * factor


@query(f"SELECT o_orderkey, {scaled_sql(AMOUNT, ['B', 'K', 'M', 'G', 'T', 'P'])} AS shown FROM orders")
def fn_fmt_bytes(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", formats.bytes_text(amount()).alias("shown"))


@query(f"SELECT o_orderkey, {scaled_sql(AMOUNT, ['', 'K', 'M', 'G'])} AS shown FROM orders")
def fn_fmt_ops(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", formats.count_text(amount()).alias("shown"))


def average_sql(micros: str, ops: str) -> str:
    t = f"({micros}::DOUBLE / nullif({ops} * 1000, 0))"
    to = lambda p: f"floor({t} * {p} + 0.5) / {p}"
    shown = f"CASE WHEN {t} < 10 THEN {to(1000)} WHEN {t} < 100 THEN {to(100)} WHEN {t} < 1000 THEN {to(10)} ELSE {to(1)} END"
    return f"CASE WHEN {ops} = 0 THEN {micros}::DOUBLE WHEN {shown} < 0.001 THEN 0.0::DOUBLE ELSE {shown} END"


@query(f"SELECT o_orderkey, {average_sql('(o_orderkey * 37)', '(o_custkey % 9)')} AS ms FROM orders")
def fn_avg_ms(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", formats.average_ms(F.col("o_orderkey") * 37, F.col("o_custkey") % 9).alias("ms"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE (o_custkey % 16) * 4294967296 + o_orderkey END::BIGINT AS lsn FROM orders")
def fn_lsn(spark, d):
    text = F.when(F.col("o_orderkey") % 11 != 0, F.concat_ws("/", F.hex(F.col("o_custkey") % 16), F.hex("o_orderkey")))
    return S.table(spark, d, "orders").select("o_orderkey", formats.log_position(text).alias("lsn"))


@query("SELECT s_suppkey, '10.0.' || s_suppkey % 7 || '.' || s_suppkey AS host, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (5000 + s_suppkey % 100 + 10)::INTEGER END AS port FROM supplier")
def fn_coord_endpoint(spark, d):
    k = F.col("s_suppkey")
    host = F.concat(F.lit("10.0."), (k % 7).cast("string"), F.lit("."), k.cast("string"))
    endpoint = F.when(k % 5 == 0, host).otherwise(F.concat(host, F.lit(":"), (5000 + k % 100).cast("string")))
    return S.table(spark, d, "supplier").select("s_suppkey", formats.host_of(endpoint).alias("host"), formats.pool_port(endpoint).alias("port"))


@query("SELECT s_suppkey, '10.0.0.' || s_suppkey % 9 AS host FROM supplier")
def fn_split_ip(spark, d):
    endpoint = F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % 9).cast("string"), F.lit(":55"))
    return S.table(spark, d, "supplier").select("s_suppkey", formats.host_of(endpoint).alias("host"))


@query("SELECT doc_id, to_base64(encode(source)) AS encoded, source AS decoded, NULL::BLOB IS NULL AS bad FROM documents")
def fn_base64(spark, d):
    rows = S.table(spark, d, "documents").select("doc_id", F.base64(F.encode("source", "UTF-8")).alias("encoded"))
    return rows.select("doc_id", "encoded", F.decode(F.unbase64("encoded"), "UTF-8").alias("decoded"), F.try_to_binary(F.lit("a?b="), F.lit("base64")).isNull().alias("bad"))


@query("SELECT n_nationkey, list_concat(range(n_nationkey, n_nationkey + 3), [(50 + n_nationkey)::BIGINT])::INTEGER[] AS points FROM nation")
def fn_range_list(spark, d):
    k = F.col("n_nationkey")
    text = F.concat(k.cast("string"), F.lit("-"), (k + 2).cast("string"), F.lit(","), (k + 50).cast("string"))
    return S.table(spark, d, "nation").select("n_nationkey", formats.range_list(text).alias("points"))


@query(f"SELECT page_id, len(list_filter({PARTS}, lambda p: octet_length(encode(p)) > 8)) = 0 AS fits FROM (SELECT page_id, {URL_PATH} AS path FROM pages)")
def fn_meta_type(spark, d):
    return url_paths(spark, d).select("page_id", paths.within_limits(F.col("path"), 8).alias("fits"))


@query(f"SELECT o_orderkey, coalesce(({listed([n if n in BATCHED else 'NOT_SUPPORT' for n in OPCODES])})[(o_orderkey % 30)::INTEGER + 1], 'NOT_SUPPORT') AS batch FROM orders")
def fn_batchable(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", formats.batch_class((F.col("o_orderkey") % 30).cast("int")).alias("batch"))


@query(f"SELECT o_orderkey, ({listed([OPCODES.index(n) for n in TRANSPORT_OPCODES])})[(o_orderkey % 30)::INTEGER + 1]::INTEGER AS opcode FROM orders")
def fn_transport_opcode(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", formats.transport_opcode((F.col("o_orderkey") % 30).cast("int") + 1).alias("opcode"))


@query("SELECT o_orderkey, (o_orderkey + 511) // 512 * 512 AS sector, (o_orderkey + 3) // 4 * 4 AS word FROM orders")
def fn_aligned(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", formats.aligned(F.col("o_orderkey"), 512).alias("sector"), formats.aligned(F.col("o_orderkey"), 4).alias("word"))


@query(B.with_(B.KV, body="SELECT user_key, len(value_key) AS n, list_sum(slice_len)::BIGINT AS total, false AS has_null, value_key[1] AS first FROM kv"))
def arr_ops(spark, d):
    total = F.aggregate("slice_len", F.lit(0).cast("long"), lambda a, x: a + x)
    return S.kv_rows(spark, d).select("user_key", F.size("value_key").cast("long").alias("n"), total.alias("total"), F.exists("slice_len", lambda x: x.isNull()).alias("has_null"), F.get("value_key", F.lit(0)).alias("first"))
