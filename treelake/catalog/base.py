"""Pieces of the SQL twins: the namespace and its hashes in DuckDB's dialect."""

from __future__ import annotations


def signed_bytes(n: str, most: int | None = None) -> str:
    size = f"octet_length(encode({n}))" if most is None else f"least(octet_length(encode({n})), {most})"
    return f"list_transform(range(1, {size}::INT + 1), lambda i: ('0x' || substr(hex(encode({n})), (2 * i - 1)::INT, 2))::BIGINT)"


def part_id(n: str) -> str:
    folded = f"list_reduce(list_prepend(0::BIGINT, {signed_bytes(n, 256)}), lambda h, b: (h * 31 + CASE WHEN b > 127 THEN b - 256 ELSE b END) & 65535) & 8191"
    return f"(CASE WHEN {n} = '' THEN 0::BIGINT ELSE {folded} END)"


def combine(parent: str, name: str) -> str:
    return f"({parent} * 8192 + {part_id(name)})"


def hash64(x: str) -> str:
    """As UBIGINT."""
    mod = "18446744073709551616::UHUGEINT"
    one = f"((xor({x}::UBIGINT, {x}::UBIGINT >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % {mod})::UBIGINT"
    two = f"list_transform([{one}], lambda y: ((xor(y, y >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % {mod})::UBIGINT)"
    return f"list_transform({two}, lambda z: xor(z, z >> 31))[1]"


#: part -> hash for all 8192 parts.
ROTATIONS = [("c", "b", 14), ("a", "c", 11), ("b", "a", 25), ("c", "b", 16), ("a", "c", 4), ("b", "a", 14), ("c", "b", 24)]


def part_hash() -> str:
    start = (0x9E3779B9 + 4 + 3923095) & 0xFFFFFFFF
    inner = f"SELECT part, ({start} + part) & 4294967295 AS a, {start}::BIGINT AS b, {start}::BIGINT AS c FROM (SELECT unnest(range(8192)) AS part)"
    for x, y, r in ROTATIONS:
        turned = f"((({y} << {r}) & 4294967295) | ({y} >> {32 - r}))"
        columns = ", ".join(f"(xor({x}, {y}) + 4294967296 - {turned}) & 4294967295 AS {x}" if v == x else v for v in "abc")
        inner = f"SELECT part, {columns} FROM ({inner})"
    return f"part_hash AS (SELECT part, c & 2147483647 AS hash FROM ({inner}))"


DIRECTORY = """directory AS (
    SELECT 0::BIGINT AS parent_id, '/' AS name, 4096::BIGINT AS inodeid
    UNION ALL SELECT 4096, lower(replace(r_name, ' ', '_')), (100 + r_regionkey) * 4096::BIGINT FROM region
    UNION ALL SELECT (100 + n_regionkey) * 4096::BIGINT, lower(n_name), (200 + n_nationkey) * 4096::BIGINT FROM nation
    UNION ALL SELECT (200 + c_nationkey) * 4096::BIGINT, 'c' || c_custkey, (1000 + c_custkey) * 4096 FROM customer
)"""
FILES = f"""files AS (
    SELECT name, st_ino, {combine("parent", "name")} AS parentid_partid, 0::BIGINT AS st_dev, 33188 AS st_mode, 1::BIGINT AS st_nlink, st_uid, 0 AS st_gid,
        0::BIGINT AS st_rdev, st_size, 0::BIGINT AS st_blksize, 0::BIGINT AS st_blocks, o_orderdate AS st_atim, o_orderdate AS st_mtim, o_orderdate AS st_ctim,
        '' AS etag, 0::BIGINT AS update_version, ({hash64("st_ino")} % 4 + 1)::INTEGER AS primary_nodeid, -1 AS backup_nodeid, parent
    FROM (
        SELECT 'o' || o_orderkey AS name, (10000000 + o_orderkey) * 4096 AS st_ino, (1000 + o_custkey) * 4096 AS parent, (o_custkey % 7)::INTEGER AS st_uid,
            coalesce(size, 0)::BIGINT AS st_size, o_orderdate
        FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity::INT::BIGINT * 4096) AS size FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
    )
)"""
INODE = f"""inode AS (
    SELECT * FROM files
    UNION ALL SELECT name, inodeid, {combine("parent_id", "name")}, 0, 16877, 2, 0, 0, 0, 0, 0, 0, TIMESTAMP '1992-01-01', TIMESTAMP '1992-01-01', TIMESTAMP '1992-01-01', '', 0, -1, -1, parent_id
    FROM directory WHERE parent_id <> 0
)"""
TREE = """tree(inodeid, path) AS (
    SELECT inodeid, '' FROM directory WHERE parent_id = 0
    UNION ALL SELECT d.inodeid, tree.path || '/' || d.name FROM directory d JOIN tree ON d.parent_id = tree.inodeid
)"""
REQUESTS = """requests AS (
    SELECT o_orderkey AS req_id, '/' || lower(replace(r_name, ' ', '_')) || '/' || lower(n_name) || '/c' || c_custkey || '/o' || o_orderkey AS path
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT unnest([-1, -2, -3, -4, -5]), unnest(['/nope/x', '/asia/missing', 'relative', '/asia/', '/'])
)"""
#: Requests with the full path of each inode row beside them.
PLACES = "places AS (SELECT i.*, t.path || '/' || i.name AS full_path FROM inode i JOIN tree t ON i.parent = t.inodeid)"
LOCATED = """located AS (
    SELECT r.req_id, r.path, p.* EXCLUDE (full_path), CASE
            WHEN NOT r.path LIKE '/%' OR t.inodeid IS NULL THEN 1
            WHEN p.st_ino IS NULL THEN 14 ELSE 0 END AS error_code
    FROM (SELECT *, rtrim(path, '/') AS clean FROM requests) r
    LEFT JOIN places p ON p.full_path = r.clean AND r.path LIKE '/%'
    LEFT JOIN tree t ON t.path = regexp_replace(r.clean, '/[^/]*$', '') AND r.path LIKE '/%'
)"""
SLICES = """slices AS (
    SELECT inodeid, chunkid, slicesize, (sum(slicesize) OVER (PARTITION BY inodeid, chunkid ORDER BY slicesize, sliceloc1, sliceloc2, price
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - slicesize)::INTEGER AS sliceoffset, slicesize AS slicelen, sliceloc1, sliceloc2
    FROM (SELECT (10000000 + l_orderkey) * 4096 AS inodeid, l_linenumber AS chunkid, l_quantity::INTEGER * 4096 AS slicesize,
        l_suppkey::INTEGER AS sliceloc1, l_partkey::INTEGER AS sliceloc2, l_extendedprice AS price FROM lineitem)
)"""
KV = """kv AS (
    SELECT 'doc_' || doc_id AS user_key, n_chars::INTEGER AS value_len, n::SMALLINT AS slice_num,
        list_transform(range(greatest(n, 1)), lambda i: doc_id * 1000 + i) AS value_key,
        list_transform(range(greatest(n, 1)), lambda i: i * 2048) AS location,
        list_transform(range(greatest(n, 1)), lambda i: least(2048, n_chars - i * 2048)::INTEGER) AS slice_len
    FROM (SELECT doc_id, n_chars, ceil(n_chars / 2048)::BIGINT AS n FROM documents)
)"""
SERVERS = """servers AS (
    SELECT i::INTEGER AS server_id, CASE WHEN i = 0 THEN 'cn' ELSE 'worker_' || i END AS server_name, '10.0.0.' || i AS host, (5520 + i)::INTEGER AS port,
        i = 0 AS is_local, 'admin' AS user_name FROM (SELECT unnest(range(5)) AS i)
)"""


def shard_map(shards: int = 50, workers: int = 4, name: str = "shard_map") -> str:
    return f"""{name} AS (
    SELECT (CASE WHEN i = {shards - 1} THEN 2147483647 ELSE 2147483647 * (i + 1) // {shards} END)::INTEGER AS range_point, (i % {workers} + 1)::INTEGER AS server_id
    FROM (SELECT unnest(range({shards})) AS i)
)"""


OPLOG = """oplog AS (
    SELECT event_id, ts, user_id AS client, CASE event_type WHEN 'view' THEN 6 WHEN 'click' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 1 ELSE 8 END AS opcode, value AS latency_us
    FROM events
)"""
TRACES = """traces AS (
    SELECT event_id, opcode, list_transform(range(9 + event_id % 6), lambda g: CASE WHEN (event_id + g) % 41 = 0 THEN 0 ELSE 1 + g * 1000 + (event_id * 7 + g * (event_id % 6)) % 997 END) AS ts_ns
    FROM oplog
)"""
CACHE = "cache AS (SELECT st_ino AS inode, st_size AS size, st_atim AS atime, CASE WHEN (st_ino // 4096) % 10 = 0 THEN 1 ELSE 0 END AS refs FROM files)"


def with_(*parts: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


NAMESPACE = (DIRECTORY, FILES, INODE, TREE, PLACES, REQUESTS, LOCATED)
