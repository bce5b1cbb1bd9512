"""Requests on the namespace, a batch at a time.

Every operator takes the state (directory: parent_id, name, inodeid; inode: one row a file or directory) and requests with
a req_id and a path, and returns one row a request with its error code; those that change the state also return it. Codes
stand in a column and are never raised. Other result columns are null where the code isn't SUCCESS (CREATE gives the
attributes of the file that was there). Paths have any number of parts; where a depth is given, longer ones are
PATH_IS_INVALID. Nothing is collected. Paths are resolved a level at a time: each level joins the distinct prefixes of that
length with the directories below the ones found before; every CUT levels the result is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import paths as P
from ..schema import DIR_MODE, DIR_TYPE, FILE_MODE, FILE_TYPE, INODE_COLUMNS, ROOT_ID, TYPE_MASK, lit_code
from ..sources.stores import saved

#: Levels of paths whose joins stay in one plan.
CUT = 4
#: Directories with more requests than this are broadcast, so that no task gets all requests below one of them.
HOT = 20_000
STAT_COLUMNS = ["st_ino", "st_mode", "st_nlink", "st_uid", "st_gid", "st_size", "st_atim", "st_mtim", "st_ctim", "etag", "update_version", "primary_nodeid", "backup_nodeid"]


def prefixes(parts: Column) -> Column:
    """level, key, above, part of every prefix of the parts of a path, to be exploded; keys are parts joined by '/'."""
    joined = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    each = lambda n: F.struct(n.alias("level"), joined(n).alias("key"), joined(n - 1).alias("above"), F.get(parts, n - 1).alias("part"))
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), each))


def descend(steps: DataFrame, directory: DataFrame, settle) -> DataFrame:
    """Goes down the prefixes (level, key, above, part, and further columns) from the root. settle makes key, at (its inode, null
    where there is none) and further columns of a level from steps with parent (the inode above) and found (the directory's
    inode or null); prefixes of what has no inode are left out."""
    spark = steps.sparkSession
    edges = directory.filter(F.col("parent_id") != 0).select(F.col("parent_id").alias("_from"), F.col("name").alias("_part"), F.col("inodeid").alias("found"))
    steps = saved(steps, "prefixes")
    deepest = steps.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    reached = spark.range(1).select(F.lit("").alias("_above"), F.lit(ROOT_ID).cast("long").alias("parent"))
    out = None
    for level in range(1, max(1, deepest) + 1):
        here = steps.filter(F.col("level") == level).join(reached, F.col("above") == F.col("_above")).drop("_above")
        done = settle(here.join(edges, (F.col("parent") == F.col("_from")) & (F.col("part") == F.col("_part")), "left").drop("_from", "_part"))
        # The plan of a level holds those above it, so it is cut now and then.
        done = saved(done, "level") if level % CUT == 0 else done
        out = done if out is None else out.unionByName(done)
        reached = done.filter("at is not null").select(F.col("key").alias("_above"), F.col("at").alias("parent"))
    return out


def walk(dirs: DataFrame, directory: DataFrame) -> DataFrame:
    """Adds at: the inode that the parts in column parts lead to, from the root; null where one is missing."""
    steps = dirs.select(F.explode(prefixes(F.col("parts"))).alias("s")).select("s.*").distinct()
    reached = descend(steps, directory, lambda rows: rows.select("key", F.col("found").alias("at")))
    root = F.when(F.size("parts") == 0, F.lit(ROOT_ID).cast("long"))
    keyed = dirs.withColumn("_key", F.array_join("parts", "/")).join(reached.filter("at is not null").withColumnRenamed("key", "_reached"), F.col("_key") == F.col("_reached"), "left")
    return keyed.withColumn("at", F.coalesce(root, "at")).drop("_key", "_reached")


def fits(path: Column, depth: int | None) -> Column:
    """Whether a path is well formed and not deeper than depth."""
    fine = P.verify(path) == 0
    return fine if depth is None else fine & (F.size(P.components(path)) <= depth)


def resolve(requests: DataFrame, directory: DataFrame, depth: int | None = None, path: str = "path") -> DataFrame:
    """Adds name and parent_id (null where the parent can't be reached). Common directories are resolved once."""
    return resolve_all(requests, directory, depth, {path: ("name", "parent_id")})


def resolve_all(requests: DataFrame, directory: DataFrame, depth: int | None, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds name and parent of every path column (paths: column -> their names). The directories of all columns are counted,
    written and walked once."""
    keyed = requests
    for path, (name, parent) in paths.items():
        keyed = keyed.withColumn(f"_dir_{parent}", F.when(fits(F.col(path), depth), P.directory_of(F.col(path)))).withColumn(name, P.base_name(F.col(path)))
    every = keyed.select(F.explode(F.array(*[f"_dir_{parent}" for _, parent in paths.values()])).alias("_dir")).filter("_dir is not null")
    dirs = saved(every.groupBy("_dir").agg(F.count(F.lit(1)).alias("_asked")), "dirs")
    reached = saved(walk(dirs.withColumn("parts", P.components(F.col("_dir"))), directory).select("_dir", "_asked", "at"), "reached")
    for _, parent in paths.values():
        keyed = with_parent(keyed, reached, f"_dir_{parent}", parent)
    return keyed


def with_parent(rows: DataFrame, reached: DataFrame, key: str, parent: str) -> DataFrame:
    """Turns the directory in column key into its inode (parent). Those with over HOT requests are broadcast; their rows, and
    rows without a directory, go on under keys that no directory has, dealt by req_id."""
    hot = reached.filter(F.col("_asked") > HOT).select(F.col("_dir").alias("_hot"), F.col("at").alias("_hot_at"))
    cold = reached.filter(F.col("_asked") <= HOT).select(F.col("_dir").alias("_cold"), F.col("at").alias("_cold_at"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    nowhere = F.concat(F.lit("//"), F.pmod(F.xxhash64("req_id"), F.lit(4096)).cast("string"))
    met = met.withColumn("_seek", F.when(F.col(key).isNotNull() & F.col("_hot").isNull(), F.col(key)).otherwise(nowhere))
    joined = met.join(cold, F.col("_seek") == F.col("_cold"), "left")
    return joined.withColumn(parent, F.coalesce("_hot_at", "_cold_at")).drop(key, "_hot", "_hot_at", "_seek", "_cold", "_cold_at")


def lookup(rows: DataFrame, inode: DataFrame, parent: str, name: str, key: str, columns: dict[str, str]) -> DataFrame:
    """Adds key (of parent and name; -1 without a parent) and columns (inode column -> its name) of the inode row there, null
    where there is none. Keys are never null, so that Spark has no null filter to compute the hash for once more."""
    keyed = rows.withColumn(key, F.coalesce(H.combine(F.col(parent), H.part_id(F.col(name))), F.lit(-1).cast("long")))
    there = inode.select(F.coalesce("parentid_partid", F.lit(-2).cast("long")).alias("_there"), F.col("name").alias("_name"), *[F.col(c).alias(to) for c, to in columns.items()])
    return keyed.join(there, (F.col(key) == F.col("_there")) & (F.col(name) == F.col("_name")), "left").drop("_there", "_name")


def with_inode(resolved: DataFrame, inode: DataFrame) -> DataFrame:
    """Adds parentid_partid (-1 without a parent) and the other columns of the inode row that (parent_id, name) names, null
    where there is none."""
    return lookup(resolved, inode, "parent_id", "name", "parentid_partid", {c: c for c in INODE_COLUMNS if c not in ("name", "parentid_partid")})


def found_code(path: Column = None) -> Column:
    path = F.col("path") if path is None else path
    bad = F.col("parent_id").isNull() | (P.verify(path) != 0)
    return F.when(bad, lit_code("PATH_IS_INVALID")).when(F.col("st_ino").isNull(), lit_code("FILE_NOT_EXISTS")).otherwise(lit_code("SUCCESS"))


def located(requests: DataFrame, directory: DataFrame, inode: DataFrame, depth: int | None = None) -> DataFrame:
    """Requests with their inode's columns and error_code."""
    return with_inode(resolve(requests, directory, depth), inode).withColumn("error_code", found_code())


def stat(requests: DataFrame, directory: DataFrame, inode: DataFrame, depth: int | None = None) -> DataFrame:
    return located(requests, directory, inode, depth).select("req_id", "error_code", *STAT_COLUMNS)


def open_files(requests: DataFrame, directory: DataFrame, inode: DataFrame, depth: int | None = None) -> DataFrame:
    """Number, size, links, mode and node; the other attributes are 0 or empty."""
    ok = F.col("error_code") == 0
    zero = {c: F.when(ok, F.lit(0)).cast(t).alias(c) for c, t in (("st_uid", "int"), ("st_gid", "int"), ("update_version", "long"))}
    rows = located(requests, directory, inode, depth)
    return rows.select("req_id", "error_code", "st_ino", "st_size", "st_nlink", "st_mode", "primary_nodeid", *zero.values(), F.when(ok, F.lit("")).alias("etag"))


def update_rows(inode: DataFrame, changes: DataFrame, columns: list[str], kind: int | None = None) -> DataFrame:
    """The shared update: inode with the given columns replaced for the rows that changes (parentid_partid, name, columns, and
    maybe nlink_change) names. A row whose links come to 0 goes; with a kind, other rows of another type stay as they are."""
    links = "nlink_change" in changes.columns
    extra = [F.col("nlink_change").cast("long").alias("_links")] if links else [F.lit(0).cast("long").alias("_links")]
    new = changes.select(F.col("parentid_partid").alias("_key"), F.col("name").alias("_name"), F.lit(True).alias("_hit"), *extra, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = inode.join(new, (inode["parentid_partid"] == new["_key"]) & (inode["name"] == new["_name"]), "left")
    if links:
        joined = joined.filter("_hit is null or st_nlink + _links <> 0")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    if kind is not None:
        hit = hit & (F.col("st_mode").bitwiseAND(F.lit(TYPE_MASK)) == kind)
    value = {c: F.col(f"_{c}") for c in columns} | ({"st_nlink": F.col("st_nlink") + F.col("_links")} if links else {})
    return joined.select(*[F.when(hit, value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in INODE_COLUMNS])


def update_attributes(requests: DataFrame, directory: DataFrame, inode: DataFrame, new: dict[str, Column], depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The shared update: (results, new inode table). new gives each column's value from the request and the old row; of
    several requests for a row the last by req_id counts."""
    asked = resolve(requests, directory, depth)
    results = with_inode(asked, inode).select("req_id", found_code().alias("error_code"))
    fine = asked.filter(F.col("parent_id").isNotNull() & (P.verify(F.col("path")) == 0))
    keyed = fine.withColumn("_key", F.coalesce(H.combine(F.col("parent_id"), H.part_id(F.col("name"))), F.lit(-1).cast("long"))).withColumnRenamed("name", "_name")
    last = keyed.withColumn("_n", F.expr("row_number() over (partition by _key, _name order by req_id desc)")).filter("_n = 1")
    # A request is right where its row is there, so the state needs one join: the rows with their last request beside them.
    joined = inode.join(last, (F.col("parentid_partid") == F.col("_key")) & (F.col("name") == F.col("_name")), "left")
    hit = F.col("_key").isNotNull()
    return results, joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in INODE_COLUMNS])


def close(requests: DataFrame, directory: DataFrame, inode: DataFrame, now: Column, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Sets size and node (new_size, node_id) and the modification time to now."""
    return update_attributes(requests, directory, inode, {"st_size": F.col("new_size").cast("long"), "primary_nodeid": F.col("node_id").cast("int"), "st_mtim": now}, depth)


def utimens(requests: DataFrame, directory: DataFrame, inode: DataFrame, now: Column, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Sets both times from new_atim and new_mtim (microseconds); if either is -1 both become now."""
    either = (F.col("new_atim") == -1) | (F.col("new_mtim") == -1)
    time = lambda c: F.when(either, now).otherwise(F.timestamp_micros(c).cast("timestamp_ntz"))
    return update_attributes(requests, directory, inode, {"st_atim": time("new_atim"), "st_mtim": time("new_mtim")}, depth)


def chown(requests: DataFrame, directory: DataFrame, inode: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    return update_attributes(requests, directory, inode, {"st_uid": F.col("new_uid"), "st_gid": F.col("new_gid")}, depth)


def chmod(requests: DataFrame, directory: DataFrame, inode: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    from ..functions.formats import permissions

    return update_attributes(requests, directory, inode, {"st_mode": permissions(F.col("st_mode"), F.col("new_mode"))}, depth)


def new_rows(rows: DataFrame, mode: int, nlink: int, now: Column) -> DataFrame:
    """Inode rows for rows of parentid_partid, name, st_ino."""
    long, int_ = (lambda v: F.lit(v).cast("long")), (lambda v: F.lit(v).cast("int"))
    values = {
        "name": F.col("name"), "st_ino": F.col("st_ino"), "parentid_partid": F.col("parentid_partid"), "st_dev": long(0), "st_mode": int_(mode), "st_nlink": long(nlink),
        "st_uid": int_(0), "st_gid": int_(0), "st_rdev": long(0), "st_size": long(0), "st_blksize": long(0), "st_blocks": long(0), "st_atim": now, "st_mtim": now,
        "st_ctim": now, "etag": F.lit(""), "update_version": long(0), "primary_nodeid": int_(-1), "backup_nodeid": int_(-1),
    }
    return rows.select(*[values[c].alias(c) for c in INODE_COLUMNS])


def ranked(rows: DataFrame, order: list[str], to: str) -> DataFrame:
    """Adds column `to`: the place in the order, from 1. Ranges of the order are numbered by themselves and offset by the
    counts before them, so no task sees all rows. Bounds of ranges come from a sample that differs from job to job, so the
    rows are written with their range once."""
    ranged = saved(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()), "ranged")
    within = ranged.withColumn("_n", F.expr(f"row_number() over (partition by _part order by {', '.join(order)})"))
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.expr("sum(_c) over (order by _part) - _c"))
    return within.join(F.broadcast(starts.drop("_c")), "_part").withColumn(to, (F.col("_n") + F.col("_before")).cast("long")).drop("_part", "_n", "_before")


def numbered(rows: DataFrame, order: list[str], base: int) -> DataFrame:
    """Adds st_ino: base + the place in the order (from 0), shifted left."""
    return ranked(rows, order, "st_ino").withColumn("st_ino", F.shiftleft(F.lit(base - 1).cast("long") + F.col("st_ino"), 12))


def create(requests: DataFrame, directory: DataFrame, inode: DataFrame, first_id: int, now: Column, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert or get: a name that is there (or that an earlier request of the batch makes) gives FILE_EXISTS with its
    attributes. Ids go by (path, req_id) from first_id."""
    rows = with_inode(resolve(requests, directory, depth), inode)
    bad = F.col("parent_id").isNull() | (P.verify(F.col("path"), directory=False) != 0)
    turn = F.expr("row_number() over (partition by parentid_partid, name order by req_id)")
    rows = rows.withColumn("_bad", bad).withColumn("_turn", F.when(~F.col("_bad"), turn))
    code = F.when(F.col("_bad"), F.when(F.col("parent_id").isNull(), lit_code("PATH_IS_INVALID")).otherwise(lit_code("PATH_VERIFY_FAILED")))
    code = code.when(F.col("st_ino").isNotNull() | (F.col("_turn") > 1), lit_code("FILE_EXISTS")).otherwise(lit_code("SUCCESS"))
    rows = rows.withColumn("error_code", code)
    fresh = numbered(rows.filter("error_code = 0").select("path", "req_id", "parentid_partid", "name"), ["path", "req_id"], first_id)
    made = fresh.select(F.col("parentid_partid").alias("_key"), F.col("name").alias("_name"), F.col("st_ino").alias("_ino"))
    joined = rows.join(made, (rows["parentid_partid"] == made["_key"]) & (rows["name"] == made["_name"]), "left")
    new = F.col("_ino").isNotNull()
    pick = lambda c, v, t: F.when(new, F.lit(v).cast(t)).otherwise(F.col(c)).alias(c)
    result = joined.select(
        "req_id", "error_code", F.coalesce("st_ino", "_ino").alias("st_ino"), pick("st_mode", FILE_MODE, "int"), pick("st_nlink", 1, "long"), pick("st_size", 0, "long"), pick("primary_nodeid", -1, "int"),
    )
    return result, inode.unionByName(new_rows(fresh, FILE_MODE, 1, now))


def mkdir(requests: DataFrame, directory: DataFrame, inode: DataFrame, first_id: int, now: Column, depth: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Level by level, so that directories of the batch can be parents of others in it. Ids go by path (parents first)
    from first_id, over the distinct paths of the batch. Returns results, directory, inode."""
    parts = P.components(F.col("path"))
    rows = requests.withColumn("_bad", ~fits(F.col("path"), depth)).withColumn("_parts", parts).withColumn("_clean", F.array_join(parts, "/"))
    wanted = rows.filter("not _bad and size(_parts) > 0").groupBy("_clean").agg(F.min("req_id").alias("_lead"), F.first("_parts").alias("_parts"))
    wanted = saved(numbered(wanted.withColumn("_sort", P.sort_key(F.col("_clean"))), ["_sort"], first_id), "wanted")
    steps = wanted.select(F.explode(prefixes(F.col("_parts"))).alias("s")).select("s.*").distinct()
    steps = steps.join(wanted.select(F.col("_clean").alias("key"), "_lead", "st_ino"), "key", "left")
    file = inode.select(F.col("parentid_partid").alias("_k"), F.col("name").alias("_f"))

    def settle(level: DataFrame) -> DataFrame:
        keyed = level.withColumn("parentid_partid", H.combine(F.col("parent"), H.part_id(F.col("part"))))
        keyed = keyed.join(file, (F.col("parentid_partid") == F.col("_k")) & (F.col("part") == F.col("_f")), "left")
        code = F.when(F.col("found").isNotNull(), lit_code("PATH_EXISTS")).when(F.col("_k").isNotNull(), lit_code("FILE_EXISTS")).otherwise(lit_code("SUCCESS"))
        code = F.when(F.col("_lead").isNotNull(), code)
        return keyed.withColumn("error_code", code).select("key", F.coalesce("found", F.when(F.col("error_code") == 0, F.col("st_ino"))).alias("at"), "error_code", "_lead", "st_ino", "parent", F.col("part").alias("name"), "parentid_partid")

    made = saved(descend(steps, directory, settle), "made")
    fresh = made.filter("error_code = 0")
    joined = rows.join(made.filter("error_code is not null").select(F.col("key").alias("_clean"), "_lead", F.col("error_code").alias("_code"), F.col("st_ino").alias("_ino")), "_clean", "left")
    code = F.when(F.col("_bad"), lit_code("PATH_IS_INVALID")).when(F.size("_parts") == 0, lit_code("PATH_EXISTS")).when(F.col("_code").isNull(), lit_code("PATH_IS_INVALID"))
    code = code.when((F.col("_code") == 0) & (F.col("req_id") != F.col("_lead")), lit_code("PATH_EXISTS")).otherwise(F.col("_code"))
    result = joined.withColumn("error_code", code).select("req_id", "error_code", F.when(F.col("error_code") == 0, F.col("_ino")).alias("st_ino"))
    state = directory.unionByName(fresh.select(F.col("parent").alias("parent_id"), "name", F.col("st_ino").alias("inodeid")))
    return result, state, inode.unionByName(new_rows(fresh, DIR_MODE, 2, now))


def unlink(requests: DataFrame, directory: DataFrame, inode: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Removes regular files. A second request for a file finds it gone."""
    rows = located(requests, directory, inode, depth)
    kind = F.col("st_mode").bitwiseAND(F.lit(TYPE_MASK))
    turn = F.expr("row_number() over (partition by parentid_partid, name order by req_id)")
    code = F.when(F.col("error_code") != 0, F.col("error_code")).when(kind != FILE_TYPE, lit_code("PATH_VERIFY_FAILED")).when(F.col("st_nlink") != 1, lit_code("PROGRAM_ERROR"))
    rows = rows.withColumn("_turn", turn).withColumn("error_code", code.when(F.col("_turn") > 1, lit_code("FILE_NOT_EXISTS")).otherwise(lit_code("SUCCESS")))
    ok = F.col("error_code") == 0
    result = rows.select("req_id", "error_code", *[F.when(ok, F.col(c)).alias(c) for c in ("st_ino", "st_size", "primary_nodeid")])
    gone = rows.filter(ok).select("parentid_partid", "name")
    return result, inode.join(gone, ["parentid_partid", "name"], "left_anti").select(*INODE_COLUMNS)


def readdir(dir_ids: DataFrame, inode: DataFrame, shard_map: DataFrame, most: int = -1, after: tuple[int, int, str] | None = None) -> DataFrame:
    """range_point, parentid_partid, name, st_mode of the children of the directories (dir_id), in the order of shard,
    place and name; the rows after a cursor of those three, and at most `most` a directory."""
    from .placement import with_shard

    rows = inode.withColumn("dir_id", H.parent_of(F.col("parentid_partid"))).join(dir_ids.select("dir_id"), "dir_id")
    rows = with_shard(rows, H.part_of(F.col("parentid_partid")), shard_map)
    order = "range_point, parentid_partid, name"
    if after is not None:
        point, key, name = after
        rows = rows.filter((F.col("range_point") > point) | ((F.col("range_point") == point) & ((F.col("parentid_partid") > key) | ((F.col("parentid_partid") == key) & (F.col("name") > name)))))
    if most >= 0:
        rows = rows.withColumn("_n", F.expr(f"row_number() over (partition by dir_id order by {order})")).filter(F.col("_n") <= most)
    return rows.select("dir_id", "range_point", "parentid_partid", "name", "st_mode")


def opendir(requests: DataFrame, directory: DataFrame, depth: int | None = None) -> DataFrame:
    """The inode of a directory path; PATH_NOT_EXISTS for any other."""
    rows = requests.withColumn("_fine", fits(F.col("path"), depth)).withColumn("parts", P.components(F.col("path")))
    reached = walk(rows.filter("_fine").select("parts").distinct(), directory)
    joined = rows.join(reached, "parts", "left").withColumn("at", F.when(F.col("_fine"), F.col("at")))
    code = F.when(~F.col("_fine"), lit_code("PATH_IS_INVALID")).when(F.col("at").isNull(), lit_code("PATH_NOT_EXISTS")).otherwise(lit_code("SUCCESS"))
    return joined.select("req_id", code.alias("error_code"), F.col("at").alias("st_ino"))


def rmdir(requests: DataFrame, directory: DataFrame, inode: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removes directories without children. Returns results, directory, inode."""
    rows = opendir(requests, directory, depth)
    used = inode.select(H.parent_of(F.col("parentid_partid")).alias("st_ino")).distinct().withColumn("_used", F.lit(True))
    turn = F.expr("row_number() over (partition by st_ino order by req_id)")
    code = F.when(F.col("error_code") != 0, F.col("error_code")).when(F.col("st_ino") == ROOT_ID, lit_code("PATH_IS_ROOT")).when(F.col("_used"), lit_code("ARGUMENT_ERROR"))
    rows = rows.join(used, "st_ino", "left").withColumn("_turn", turn).withColumn("error_code", code.when(F.col("_turn") > 1, lit_code("PATH_NOT_EXISTS")).otherwise(lit_code("SUCCESS")))
    gone = rows.filter("error_code = 0").select(F.col("st_ino").alias("inodeid"))
    kept = inode.join(gone.withColumnRenamed("inodeid", "st_ino"), "st_ino", "left_anti").select(*INODE_COLUMNS)
    return rows.select("req_id", "error_code"), directory.join(gone, "inodeid", "left_anti").select("parent_id", "name", "inodeid"), kept


def placed(rows: DataFrame, key: str, shard_map: DataFrame, server: str) -> DataFrame:
    """Adds the server of the shard of a (parent, part) key."""
    from .placement import with_shard

    return with_shard(rows, H.part_of(F.col(key)), shard_map).withColumnRenamed("server_id", server).drop("range_point")


def rename(
    requests: DataFrame, directory: DataFrame, inode: DataFrame, depth: int | None = None, shard_map: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves files and directories (src to dst); a directory keeps its id, so what is below it stays. Requests of a batch
    are taken as independent: they see the state before it, and of several for one target the first by req_id wins
    (replay.py applies a log in order). With a shard map, a row that comes to another server is made anew there: its etag is
    empty, its update_version 0 and its backup_nodeid -1. Returns results, directory, inode."""
    under = F.col("dst").startswith(F.concat(F.regexp_replace("src", "/$", ""), F.lit("/")))
    bad = (P.verify(F.col("src")) != 0) | (P.verify(F.col("dst")) != 0)
    rows = resolve_all(requests.select("req_id", "src", "dst", bad.alias("_bad"), under.alias("_under")), directory, depth, {"src": ("src_name", "src_parent"), "dst": ("name", "parent_id")}).drop("src", "dst")
    both = lookup(rows, inode, "src_parent", "src_name", "_key", {"st_ino": "src_ino", "st_mode": "src_mode"})
    both = lookup(both, inode, "parent_id", "name", "_to_key", {"st_ino": "st_ino"})
    turn = F.expr("row_number() over (partition by _to_key, name order by req_id)")
    code = F.when(F.col("_bad") | F.col("src_parent").isNull() | F.col("parent_id").isNull(), lit_code("PATH_IS_INVALID"))
    code = code.when(F.col("_under"), lit_code("PATH_LOCK_CONFLICT")).when(F.col("src_ino").isNull(), lit_code("FILE_NOT_EXISTS")).when(F.col("st_ino").isNotNull(), lit_code("FILE_EXISTS"))
    both = both.withColumn("_turn", turn).withColumn("error_code", code.when(F.col("_turn") > 1, lit_code("FILE_EXISTS")).otherwise(lit_code("SUCCESS")))
    moved = both.filter("error_code = 0").select(
        "_key", F.col("src_name").alias("_name"), F.col("src_parent").alias("_from"), "_to_key", F.col("name").alias("_to"), F.col("parent_id").alias("_to_parent"), F.col("src_mode").alias("_mode"),
    )
    joined = inode.join(moved, (inode["parentid_partid"] == moved["_key"]) & (inode["name"] == moved["_name"]), "left")
    value = {"name": F.coalesce("_to", "name"), "parentid_partid": F.coalesce("_to_key", "parentid_partid")}
    if shard_map is not None:
        joined = placed(placed(joined, "_key", shard_map, "_old_server"), "_to_key", shard_map, "_new_server")
        anew = F.coalesce(F.col("_old_server") != F.col("_new_server"), F.lit(False))
        value |= {c: F.when(anew, F.lit(v).cast(t)).otherwise(F.col(c)) for c, v, t in (("etag", "", "string"), ("update_version", 0, "long"), ("backup_nodeid", -1, "int"))}
    new_inode = joined.select(*[value.get(c, F.col(c)).alias(c) for c in INODE_COLUMNS])
    dirs = moved.filter(F.col("_mode").bitwiseAND(F.lit(TYPE_MASK)) == DIR_TYPE)
    joined = directory.join(dirs, (directory["parent_id"] == dirs["_from"]) & (directory["name"] == dirs["_name"]), "left")
    new_directory = joined.select(F.coalesce("_to_parent", "parent_id").alias("parent_id"), F.coalesce("_to", "name").alias("name"), "inodeid")
    return both.select("req_id", "error_code"), new_directory, new_inode
