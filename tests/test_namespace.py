"""Requests on a small namespace."""

import pytest
from pyspark.sql import functions as F

from treelake.functions import hashing as H
from treelake.operators import namespace as N
from treelake.operators import placement, records
from treelake.schema import DIRECTORY_SCHEMA, KV_SCHEMA, code

def now():
    return F.lit("2026-01-01").cast("timestamp_ntz")



@pytest.fixture(scope="module")
def state(spark, tmp_path_factory):
    """Directories /a, /a/b and /c; files /a/f and /a/b/g."""
    rows = [(0, "/", 4096), (4096, "a", 100 << 12), (100 << 12, "b", 101 << 12), (4096, "c", 102 << 12)]
    directory = spark.createDataFrame(rows, DIRECTORY_SCHEMA)
    entry = lambda parent, name, ino: spark.range(1).select(F.lit(name).alias("name"), F.lit(ino << 12).alias("st_ino"), H.combine(F.lit(parent << 12), H.part_id(F.lit(name))).alias("parentid_partid"))
    dirs = entry(1, "a", 100).union(entry(100, "b", 101)).union(entry(1, "c", 102))
    files = entry(100, "f", 200).union(entry(101, "g", 201))
    inode = N.new_rows(dirs, 0o040755, 2, now()).union(N.new_rows(files, 0o100644, 1, now()))
    path = str(tmp_path_factory.mktemp("state") / "inode")
    inode.coalesce(1).write.parquet(path)
    return directory, spark.read.parquet(path)


def ask(spark, *paths):
    return spark.createDataFrame(list(enumerate(paths)), "req_id long, path string")


def codes(df):
    return [r.error_code for r in df.orderBy("req_id").collect()]


def test_listing(spark, state):
    directory, inode = state
    a = N.opendir(ask(spark, "/a"), directory).first().st_ino
    got = N.readdir(spark.createDataFrame([(a,)], "dir_id long"), inode, placement.build(spark, 8, 2)).collect()
    assert {r.name for r in got} == {"b", "f"} and a


def test_missing_and_bad_paths(spark, state):
    got = N.stat(ask(spark, "/a/f", "/a/none", "/x/y", "rel", "", "/a"), *state)
    assert codes(got) == [0, code("FILE_NOT_EXISTS"), code("PATH_IS_INVALID"), code("PATH_IS_INVALID"), code("PATH_IS_INVALID"), 0]


def test_create_twice(spark, state):
    result, inode = N.create(ask(spark, "/c/n", "/c/n", "/a/f", "/x/y", "/a"), *state, 300, now())
    assert codes(result) == [0, code("FILE_EXISTS"), code("FILE_EXISTS"), code("PATH_IS_INVALID"), code("FILE_EXISTS")]
    rows = {r.req_id: r for r in result.collect()}
    assert rows[1].st_ino == rows[0].st_ino and rows[2].st_size == 0
    assert inode.count() == state[1].count() + 1


def test_mkdir(spark, state):
    result, directory, inode = N.mkdir(ask(spark, "/c/d/e", "/c/d", "/a", "/a/f", "/x/y", "/c/d"), *state, 400, now())
    assert codes(result) == [0, 0, code("PATH_EXISTS"), code("FILE_EXISTS"), code("PATH_IS_INVALID"), code("PATH_EXISTS")]
    assert directory.count() == state[0].count() + 2 and inode.count() == state[1].count() + 2
    assert codes(N.opendir(ask(spark, "/c/d/e"), directory)) == [0]


def test_attributes(spark, state):
    asked = ask(spark, "/a/f").withColumn("new_mode", F.lit(0o600))
    result, inode = N.chmod(asked, *state)
    assert codes(result) == [0]
    row = N.stat(ask(spark, "/a/f"), state[0], inode).first()
    assert row.st_mode == 0o100600
    _, inode = N.close(ask(spark, "/a/f").withColumn("new_size", F.lit(1024)).withColumn("node_id", F.lit(2)), *state, now())
    assert N.stat(ask(spark, "/a/f"), state[0], inode).first().st_size == 1024


def test_unlink(spark, state):
    result, inode = N.unlink(ask(spark, "/a/f", "/a/f", "/a/b", "/a/x"), *state)
    assert codes(result) == [0, code("FILE_NOT_EXISTS"), code("PATH_VERIFY_FAILED"), code("FILE_NOT_EXISTS")]
    assert codes(N.stat(ask(spark, "/a/f", "/a/b"), state[0], inode)) == [code("FILE_NOT_EXISTS"), 0]


def test_rmdir(spark, state):
    result, directory, inode = N.rmdir(ask(spark, "/c", "/a", "/", "/none", "/a/f"), *state)
    assert codes(result) == [0, code("ARGUMENT_ERROR"), code("PATH_IS_ROOT"), code("PATH_NOT_EXISTS"), code("PATH_NOT_EXISTS")]
    assert codes(N.opendir(ask(spark, "/c", "/a"), directory)) == [code("PATH_NOT_EXISTS"), 0]


def test_rename(spark, state):
    asked = spark.createDataFrame([(0, "/a/f", "/c/f2"), (1, "/a/b", "/c/b2"), (2, "/a", "/a/b/z"), (3, "/none", "/c/q"), (4, "/a/b/g", "/a/f")], "req_id long, src string, dst string")
    result, directory, inode = N.rename(asked, *state)
    assert codes(result) == [0, 0, code("PATH_LOCK_CONFLICT"), code("FILE_NOT_EXISTS"), code("FILE_EXISTS")]
    got = N.stat(ask(spark, "/a/f", "/c/f2", "/c/b2/g", "/a/b/g"), directory, inode)
    assert codes(got) == [code("FILE_NOT_EXISTS"), 0, 0, code("PATH_IS_INVALID")]


def test_any_depth(spark, state):
    """Paths of 1 to 7 parts, by default and with a given depth."""
    deep = "/c" + "".join(f"/d{k}" for k in range(1, 7))
    parents = [deep[: deep.index(f"/d{k}") + len(f"/d{k}")] if k else "/c" for k in range(7)]
    result, directory, inode = N.mkdir(ask(spark, *parents[1:]), *state, 1000, now())
    assert codes(result) == [0] * 6
    got = N.resolve(ask(spark, *[p + "/x" for p in parents], deep.replace("/d5", "/no") + "/x"), directory).orderBy("req_id").collect()
    opened = [r.st_ino for r in N.opendir(ask(spark, *parents), directory).orderBy("req_id").collect()]
    assert [r.parent_id for r in got] == [*opened, None] and None not in opened and len(set(opened)) == 7
    short = N.resolve(ask(spark, "/a/b/x", "/c/d1/d2/x", "/c/d1/d2/d3/x"), directory, depth=4).orderBy("req_id").collect()
    assert [r.parent_id is None for r in short] == [False, False, True]
    assert codes(N.opendir(ask(spark, "/c/d1", "/c/d1/d2"), directory, depth=2)) == [0, code("PATH_IS_INVALID")]
    assert codes(N.mkdir(ask(spark, "/c/q", "/c/q/r"), *state, 1000, now(), depth=3)[0]) == [0, 0]
    assert codes(N.mkdir(ask(spark, "/c/q", "/c/q/r"), *state, 1000, now(), depth=1)[0]) == [code("PATH_IS_INVALID")] * 2


def test_shards_of_all_parts(spark):
    shard_map = placement.build(spark, 37, 3)
    points = sorted((r.range_point, r.server_id) for r in shard_map.collect())
    hashes = {r.id: r.h for r in spark.range(8192).select("id", H.shard_hash(F.col("id")).alias("h")).collect()}
    for row in placement.part_table(shard_map).collect():
        assert (row.range_point, row.server_id) == next(p for p in points if p[0] >= hashes[row.part])


def test_rename_to_another_server(spark, state):
    directory, inode = state
    inode = inode.withColumns({"etag": F.lit("old"), "update_version": F.lit(5).cast("long"), "backup_nodeid": F.lit(3)})
    asked = spark.createDataFrame([(k, "/a/f", f"/c/name{k}") for k in range(1)], "req_id long, src string, dst string")
    shard_map = placement.build(spark, 64, 64)
    row = N.stat(ask(spark, "/c/name0"), *N.rename(asked, directory, inode, shard_map=shard_map)[1:]).first()
    assert (row.etag, row.update_version, row.backup_nodeid, row.st_ino) == ("", 0, -1, 200 << 12)
    row = N.stat(ask(spark, "/c/name0"), *N.rename(asked, directory, inode, shard_map=placement.build(spark, 64, 1))[1:]).first()
    assert (row.etag, row.update_version, row.backup_nodeid) == ("old", 5, 3)


def test_shared_update(spark, state):
    inode = state[1]
    changes = inode.select("parentid_partid", "name", F.lit(9).cast("int").alias("st_uid"), F.when(F.col("name") == "f", -1).otherwise(1).alias("nlink_change"))
    after = {r.name: (r.st_uid, r.st_nlink) for r in N.update_rows(inode, changes, ["st_uid"], 0o100000).collect()}
    assert after == {"g": (9, 2), "a": (0, 2), "b": (0, 2), "c": (0, 2)}


def test_key_values(spark):
    kv = spark.createDataFrame([("k", 1, 1, [1], [2], [3])], KV_SCHEMA)
    put = spark.createDataFrame([(0, "k", 9, 1, [9], [9], [9]), (1, "n", 5, 1, [5], [5], [5]), (2, "n", 6, 1, [6], [6], [6])], f"req_id long, {KV_SCHEMA}")
    result, after = records.kv_put(put, kv)
    assert codes(result) == [0, 0, 0]
    assert {r.user_key: r.value_len for r in after.collect()} == {"k": 1, "n": 5}
    asked = spark.createDataFrame([(0, "k"), (1, "none"), (2, "k")], "req_id long, user_key string")
    assert codes(records.kv_get(asked, kv)) == [0, code("ARGUMENT_ERROR"), 0]
    assert codes(records.kv_delete(asked, kv)[0]) == [0, code("ARGUMENT_ERROR"), code("ARGUMENT_ERROR")]


def test_ids_do_not_overlap(spark):
    asked = spark.createDataFrame([(k, 0, 3) for k in range(8)], "req_id long, kind int, count long")
    got = sorted((r.first, r.last) for r in records.reserve_ids(asked).collect())
    assert got == [(3 * k, 3 * k + 3) for k in range(8)]


def test_numbers_of_many_rows(spark):
    """More rows than a range sample holds, in ranges that aren't put together; numbers are gapless and in order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 60_000, 1, 3).select(F.format_string("%08d", F.pmod(F.col("id") * 7919, F.lit(60_000))).alias("path"), F.col("id").alias("other"))
        got = sorted((r.st_ino, r.path) for r in N.numbered(rows, ["path"], 10).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [((10 + k) << 12, f"{k:08d}") for k in range(60_000)]


def test_no_task_orders_all_chunk_requests(spark):
    """Slice requests are numbered in ranges: no window of the plan is over all rows of orders."""
    from treelake.catalog.requests import chunk_requests

    rows = chunk_requests(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "Window [row_number()" in line and line.count("], [") < 2]
    assert not whole, whole
    assert sorted(r.req_id for r in rows.collect()) == list(range(1, 1501))


def test_requests_of_one_directory_are_spread(spark, state):
    """Requests below one directory, and those without one, don't end in one task; results stay whole."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        asked = spark.range(0, 60_000, 1, 4).select(F.col("id").alias("req_id"), F.expr("case when id % 3 = 0 then 'rel' when id = 1 then '/c/x' when id = 2 then '/x/y' else '/a/b/n' || id end").alias("path"))
        got = N.resolve(asked, state[0]).groupBy("parent_id", F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    total = {p: sum(r["count"] for r in got if r.parent_id == p) for p in (101 << 12, 102 << 12, None)}
    assert total == {101 << 12: 39_998, 102 << 12: 1, None: 20_001}
    assert max(r["count"] for r in got) < 15_000


def hashes(df):
    """How often the plan hashes a name."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("StringDecode.decode")


def test_state_after_update_is_one_join(spark, state):
    """The new state looks up no inode before it joins them, and hashes a request's name once; the last request counts."""
    asked = ask(spark, "/a/f", "/a/f", "/a/none", "/a/b", "rel").withColumns({"new_atim": F.col("req_id") * 1_000_000, "new_mtim": F.lit(5_000_000)})
    result, inode = N.utimens(asked, *state, now())
    assert codes(result) == [0, 0, code("FILE_NOT_EXISTS"), 0, code("PATH_IS_INVALID")]
    assert {r.name: r.st_atim.timestamp() for r in inode.filter("st_atim < timestamp_ntz'2000-01-01'").select("name", F.col("st_atim").cast("timestamp").alias("st_atim")).collect()} == {"f": 1, "b": 3}
    closing = asked.withColumns({"new_size": F.lit(1), "node_id": F.lit(2)})
    for _, after in (N.close(closing, *state, now()), N.utimens(asked, *state, now())):
        assert hashes(after) == 1


def test_rename_hashes_names_once(spark, state):
    """Two names a request, and none again for the move; both sides are resolved in one walk."""
    asked = spark.createDataFrame([(0, "/a/f", "/c/f2"), (1, "/a/b", "/c/f2"), (2, "/a/b/g", "/a/b/g"), (3, "x", "/c/y")], "req_id long, src string, dst string")
    result, directory, inode = N.rename(asked, *state)
    assert codes(result) == [0, code("FILE_EXISTS"), code("FILE_EXISTS"), code("PATH_IS_INVALID")]
    assert hashes(result) == 2 and hashes(inode) == 2
