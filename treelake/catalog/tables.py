"""Sources, sinks, streams and pass-through SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import placement, records
from ..plans import passthrough
from ..schema import code, op
from ..sources import config, shards, stores
from ..sources import namespace as S
from ..streaming import replay, windows
from . import base as B
from . import query


@query("SELECT o_orderkey AS req_id, (o_orderkey * 10 + i)::BIGINT AS value_key, (i * 2048)::BIGINT AS location FROM orders, (SELECT unnest(range(3)) AS i) WHERE i < o_orderkey % 4")
def src_serialized(spark, d):
    """Parallel arrays of a request as rows."""
    k = F.col("o_orderkey")
    n = (k % 4).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = S.table(spark, d, "orders").select(k.alias("req_id"), F.transform(at, lambda i: k * 10 + i).alias("value_key"), F.transform(at, lambda i: (i * 2048).cast("long")).alias("location"))
    return rows.select("req_id", F.inline(F.arrays_zip("value_key", "location")))


@query("SELECT n_nationkey AS id, n_name AS name, n_nationkey * 10 AS cache_size, n_nationkey % 2 = 0 AS enabled, 0.5::DOUBLE AS ratio, 'a' || n_nationkey || ',b' AS hosts FROM nation")
def src_json_config(spark, d):
    k = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit('{"main": {"name": "'), "n_name", F.lit('", "cache_size": '), (F.col("n_nationkey") * 10).cast("string"), F.lit(', "enabled": '), F.when(F.col("n_nationkey") % 2 == 0, "true").otherwise("false"), F.lit(', "ratio": 0.5, "hosts": ["a'), k, F.lit('", "b"]}}'))
    keys = {"name": "string", "cache_size": "int", "enabled": "boolean", "ratio": "double", "hosts": "array"}
    return config.properties(S.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), text.alias("json")), keys)


@query(B.with_(B.DIRECTORY, body="SELECT * FROM directory UNION ALL SELECT 4096, 'extra_' || n_nationkey, (700000 + n_nationkey) * 4096::BIGINT FROM nation"))
def sink_insert(spark, d):
    rows = S.table(spark, d, "nation").select(F.lit(4096).cast("long").alias("parent_id"), F.concat(F.lit("extra_"), F.col("n_nationkey").cast("string")).alias("name"), S.ident(700_000 + F.col("n_nationkey")).alias("inodeid"))
    return records.insert(S.directories(spark, d), rows)


@query(B.with_(B.SERVERS, body="SELECT server_id, server_name, CASE WHEN server_id = 2 THEN '10.1.1.1' ELSE host END AS host, CASE WHEN server_id IN (2, 3) THEN 6000 ELSE port END::INTEGER AS port, is_local, user_name FROM servers"))
def sink_update(spark, d):
    changes = spark.createDataFrame([(2, "10.1.1.1", 6000), (3, None, 6000)], "server_id int, host string, port int")
    return records.update(S.servers(spark), changes, ["server_id"], ["host", "port"])


@query(B.with_(B.SERVERS, body="SELECT * FROM servers WHERE server_id <> 4 UNION ALL SELECT 9, 'worker_9', '10.0.0.9', 5529, false, 'admin'"))
def upd_server(spark, d):
    new = spark.createDataFrame([(9, "worker_9", "10.0.0.9", 5529, False, "admin")], S.servers(spark).schema)
    return records.upsert(records.delete(S.servers(spark), spark.createDataFrame([(4,)], "server_id int"), ["server_id"]), new, ["server_id"])


@query(B.with_(B.DIRECTORY, body="SELECT * FROM directory WHERE inodeid % 3 <> 0"))
def sink_delete(spark, d):
    return records.delete(S.directories(spark, d), S.directories(spark, d).filter("inodeid % 3 = 0"), ["parent_id", "name"])


@query(B.with_(B.DIRECTORY, body="SELECT * FROM directory LIMIT 0"))
def sink_truncate(spark, d):
    return records.truncate(S.directories(spark, d))


@query("SELECT 'doc_' || doc_id AS name, unnest(['quality', 'toxic']) AS xKey, unnest([quality, toxic])::VARCHAR AS xValue FROM labels")
def scan_xattr(spark, d):
    return S.xattrs(spark, d).select("name", "xKey", "xValue")


@query()
def scan_cache_dir(spark, d):
    """Files of a folder as cache items, oldest first."""
    return stores.cache_files(spark, d)


@query(f"SELECT *, (parentid_partid % 16)::INTEGER AS shard_id FROM (SELECT {B.combine('4096::BIGINT', 'name')} AS parentid_partid, name, unnest(['quality', 'toxic']) AS xKey, unnest([quality, toxic])::VARCHAR AS xValue FROM (SELECT 'doc_' || doc_id AS name, quality, toxic FROM labels))")
def sink_ddl(spark, d):
    """An empty table a shard, as one partitioned table; what is written to it and read back."""
    return stores.partitioned_copy(S.xattrs(spark, d), stores.scratch(spark, f"ddl-{uuid.uuid4().hex}"), "parentid_partid")


@query(B.with_(B.part_hash(), B.shard_map(), f"""x AS (SELECT {B.combine('4096::BIGINT', 'name')} AS parentid_partid, name, unnest(['quality', 'toxic']) AS xKey, unnest([quality, toxic])::VARCHAR AS xValue FROM (SELECT 'doc_' || doc_id AS name, quality, toxic FROM labels))""",
    body="""SELECT parentid_partid, name, xKey, xValue, s.range_point FROM (SELECT x.*, hash FROM x JOIN part_hash ON part = parentid_partid & 8191) f ASOF JOIN shard_map s ON f.hash <= s.range_point
        WHERE s.server_id = 1 AND s.range_point <> (SELECT min(range_point) FROM shard_map WHERE server_id = 1)"""))  # fmt: skip
def sink_ddl_points(spark, d):
    """The tables of one server, its attributes written to them, and the shard of its least range point dropped."""
    base = f"ddl_{uuid.uuid4().hex}"
    shard_map = placement.build(spark, 50, 4)
    shards.create(spark, base, shard_map, 1)
    shards.load(S.xattrs(spark, d), base, "xattr", H.part_of(F.col("parentid_partid")), shard_map)
    shards.drop_at(spark, base, shards.points_of(spark, base, "xattr").agg(F.min("range_point")).first()[0])
    return spark.table(f"{base}.xattr")


@query("SELECT event_id AS index, event_type AS action, event_id % 3 <> 0 AS injected, value AS recover_seconds FROM events")
def sink_jsonl(spark, d):
    """Events as JSON lines, written and read back."""
    rows = S.table(spark, d, "events").select(F.col("event_id").alias("index"), F.col("event_type").alias("action"), (F.col("event_id") % 3 != 0).alias("injected"), F.col("value").alias("recover_seconds"))
    return stores.json_copy(rows, stores.scratch(spark, f"jsonl-{uuid.uuid4().hex}"))


PLAIN = "SELECT c_mktsegment AS segment, count(*) AS n, sum(c_custkey) AS total FROM customer GROUP BY c_mktsegment"


@query(f"SELECT segment, n::VARCHAR AS n, total::BIGINT::VARCHAR AS total FROM ({PLAIN})")
def op_plain(spark, d):
    return passthrough.plain_command(spark, d, PLAIN)


@query("SELECT n_name, count(*) AS orders, sum(o_orderkey)::BIGINT AS keys, rank() OVER (ORDER BY count(*) DESC, n_name)::INTEGER AS place FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def plain_join_rank(spark, d):
    return passthrough.sql(spark, d, "SELECT n_name, count(*) AS orders, sum(o_orderkey) AS keys, rank() OVER (ORDER BY count(*) DESC, n_name) AS place FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS quantity, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY CUBE (l_returnflag, l_linestatus)")
def plain_cube(spark, d):
    return passthrough.sql(spark, d, "SELECT l_returnflag, l_linestatus, cast(sum(l_quantity) as bigint) AS quantity, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY CUBE (l_returnflag, l_linestatus)")


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders UNION ALL SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def plain_sets(spark, d):
    return passthrough.sql(spark, d, "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders UNION ALL SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")


WINDOWED = "SELECT time_bucket(INTERVAL '{s} seconds', ts) AS start, opcode, count(*) AS n, max(event_id) AS last FROM oplog GROUP BY 1, 2"


@query(B.with_(B.OPLOG, body=WINDOWED.format(s=60)))
def st_tumble_60s(spark, d):
    return windows.run(windows.tumbling(windows.read_events(spark, d), "60 seconds"), ["start", "opcode"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(B.with_(B.OPLOG, body=WINDOWED.format(s=1)))
def st_tumble_1s(spark, d):
    return windows.run(windows.tumbling(windows.read_events(spark, d), "1 second"), ["start", "opcode"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(B.with_(B.OPLOG, body="SELECT start, n, n - coalesce(lag(n) OVER (ORDER BY start), 0) AS change, n / 3600 AS per_second FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM oplog GROUP BY 1)"))
def st_rate(spark, d):
    return windows.rates(S.oplog(spark, d), "1 hour", 3600)


@query(B.with_(B.OPLOG, body="SELECT client, opcode, min(event_id) AS first FROM oplog GROUP BY 1, 2"))
def st_dedupe(spark, d):
    return windows.run(windows.first_of_each(windows.read_events(spark, d)), ["client", "opcode"])


@query(B.with_(B.OPLOG, body="SELECT opcode, count(*) AS n, sum(event_id)::BIGINT AS total FROM oplog GROUP BY 1"))
def st_microbatch(spark, d):
    return windows.micro_batches(windows.read_events(spark, d))


@query(B.with_(B.OPLOG, body="""SELECT client, max(opened) AS opened, arg_max(s - least(0, low), event_id)::BIGINT AS still_open, max(s - least(0, low))::BIGINT AS peak FROM (
    SELECT *, min(s) OVER (PARTITION BY client ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS low FROM (SELECT client, event_id, count(*) FILTER (opcode = 6) OVER (PARTITION BY client) AS opened,
        sum(CASE opcode WHEN 6 THEN 1 WHEN 5 THEN -1 ELSE 0 END) OVER (PARTITION BY client ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM oplog)) GROUP BY 1"""))
def st_state_fd(spark, d):
    """Open handles of each client, its opens and closes taken in order."""
    return windows.open_handles(S.oplog(spark, d), opened=6, closed=5)


@query(B.with_(B.OPLOG, body="SELECT client, arg_max(opcode, event_id) AS last_op, max(event_id) AS last_event, count(*) FILTER (opcode = 4) - count(*) FILTER (opcode = 8) AS balance FROM oplog GROUP BY 1"))
def st_client_state(spark, d):
    return windows.client_states(windows.read_events(spark, d))


@query(B.with_(B.OPLOG, """r AS (SELECT event_id, opcode, 'u' || client AS dir, 'f' || event_id % 7 AS name, min(event_id) FILTER (opcode = MKDIR) OVER (PARTITION BY client) AS made FROM oplog)""",
    """s AS (SELECT *, coalesce(made < event_id, false) AS there, last_value(CASE WHEN made < event_id AND opcode IN (CREATE_, UNLINK_) THEN opcode = CREATE_ END IGNORE NULLS) OVER (PARTITION BY dir, name ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had FROM r)""",
    body="""SELECT event_id, opcode, (CASE WHEN opcode = MKDIR THEN CASE WHEN event_id = made THEN 0 ELSE PATH_EXISTS END WHEN NOT there THEN PATH_IS_INVALID
        WHEN opcode = CREATE_ THEN CASE WHEN had THEN FILE_EXISTS ELSE 0 END WHEN had THEN 0 ELSE FILE_NOT_EXISTS END)::INTEGER AS error_code FROM s""")
    .replace("MKDIR", str(op("MKDIR"))).replace("CREATE_", str(op("CREATE"))).replace("UNLINK_", str(op("UNLINK"))).replace("PATH_EXISTS", str(code("PATH_EXISTS"))).replace("PATH_IS_INVALID", str(code("PATH_IS_INVALID")))
    .replace("FILE_NOT_EXISTS", str(code("FILE_NOT_EXISTS"))).replace("FILE_EXISTS", str(code("FILE_EXISTS"))))
def st_oplog_apply(spark, d):
    """The log replayed on directories and files: a directory a client, seven file names in each."""
    log = windows.read_events(spark, d)
    name = F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string"))
    return replay.replay_stream(log.select("event_id", "opcode", F.concat(F.lit("u"), F.col("client").cast("string")).alias("dir"), name.alias("name")))
