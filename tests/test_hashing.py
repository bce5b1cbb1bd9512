"""Hashes against plain Python."""

import random

from pyspark.sql import functions as F

from treelake.functions import formats, hashing, paths

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def signed(b: int) -> int:
    return b - 256 if b > 127 else b


def part_id(name: str) -> int:
    h = 0
    for b in name.encode()[:256]:
        h = (h * 31 + signed(b)) & 0xFFFF
    return h & 0x1FFF


def djb2(name: str) -> int:
    h = 5381
    for b in name.encode():
        h = (h * 33 + signed(b)) & M64
    return h


def hash32(k: int) -> int:
    rot = lambda x, n: ((x << n) | (x >> (32 - n))) & M32
    a = b = c = (0x9E3779B9 + 4 + 3923095) & M32
    a = (a + k) & M32
    c = ((c ^ b) - rot(b, 14)) & M32
    a = ((a ^ c) - rot(c, 11)) & M32
    b = ((b ^ a) - rot(a, 25)) & M32
    c = ((c ^ b) - rot(b, 16)) & M32
    a = ((a ^ c) - rot(c, 4)) & M32
    b = ((b ^ a) - rot(a, 14)) & M32
    return ((c ^ b) - rot(b, 24)) & M32 & 0x7FFFFFFF


def hash64(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def test_names(spark):
    random.seed(4)
    names = ["", "file_0", "order_123", "é", "日本", "x" * 300] + ["".join(random.choice("abcé日/ ") for _ in range(random.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for n, p, j in df.select("n", hashing.part_id(F.col("n")), hashing.djb2(F.col("n"))).collect():
        assert p == part_id(n)
        assert j & M64 == djb2(n)
    assert part_id("file_0") == 4653


def test_numbers(spark):
    random.seed(5)
    values = [0, 1, (1 << 62) + 7, -1, -(1 << 63)] + [random.getrandbits(64) - (1 << 63) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for v, h, m in df.select("v", hashing.hash64(F.col("v")), hashing.unsigned_mod(F.col("v"), 7)).collect():
        assert h & M64 == hash64(v & M64)
        assert m == (v & M64) % 7


def test_shard_hash(spark):
    got = {r[0]: r[1] for r in spark.range(8192).select("id", hashing.shard_hash(F.col("id") + (1 << 40))).collect()}
    assert got == {p: hash32(p) for p in range(8192)}
    assert got[0] == 1874772143 and got[4653] == 1334111701


def test_path_order(spark):
    names = ["/metadb/sibling", "/metadb/path-x", "/metadb/path/child", "/metadb/path", "/metadb"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").orderBy(paths.sort_key(F.col("p"))).collect()
    assert [r.p for r in rows] == ["/metadb", "/metadb/path", "/metadb/path/child", "/metadb/path-x", "/metadb/sibling"]


def test_formats(spark):
    df = spark.createDataFrame([(0,), (9999,), (10_000,), (10_240_000,), (1 << 40,)], "n long")
    assert [r[0] for r in df.select(formats.bytes_text(F.col("n"))).collect()] == ["0", "9999B", "9K", "9M", "1024G"]
    row = spark.range(1).select(formats.average_ms(F.lit(5), F.lit(0)), formats.average_ms(F.lit(12_345_678), F.lit(100)), formats.log_position(F.lit("A/10")), formats.error_of_message(F.lit("12345678Bx")), formats.error_of_message(F.lit(None).cast("string"))).first()
    assert tuple(row) == (5.0, 123.5, (10 << 32) + 16, 2, 17)


def test_amounts_beyond_64_bits(spark, tmp_path):
    from treelake.catalog import functions

    def shown(n: int, units: list[str]) -> str:
        k = next((k for k in range(len(units)) if n >> 10 * k < 10_000), len(units) - 1)
        return f"{n >> 10 * k}{units[k]}" if n else "0"

    orders = [(k, c) for k in (0, 1, 37, 149_999, 8_999_999, 53_999_999, 10**12) for c in (0, 1, 13, 14, 899_999)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    for query, units in ((functions.fn_fmt_bytes, list("BKMGTP")), (functions.fn_fmt_ops, ["", *"KMG"])):
        got = sorted((r.o_orderkey, r.shown) for r in query(spark, str(tmp_path)).collect())
        assert got == sorted((k, shown(k * k * (c % 5) * (1 + c % 3 * 100_000), units)) for k, c in orders)
