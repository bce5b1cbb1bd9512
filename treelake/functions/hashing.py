"""Hashes of names, paths and ids, as Column expressions over signed 64-bit values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW32 = 0xFFFFFFFF
PART_MASK = 0x1FFF


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW32))


def high32(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def fold_bytes(text: Column, first: Column, step, finish=None, most: int | None = None) -> Column:
    """step(value, byte) over the UTF-8 bytes of text, at most `most`, as signed numbers. Read as Latin-1, every byte is one
    character."""
    n = F.octet_length(text) if most is None else F.least(F.octet_length(text), F.lit(most))

    def over(latin: Column) -> Column:
        byte = lambda i: ((F.ascii(F.substring(latin, i, F.lit(1))) + 128).bitwiseAND(F.lit(255)) - 128).cast("long")
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, first, lambda value, i: step(value, byte(i)), finish)

    return let(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), over)


def part_id(name: Column) -> Column:
    """13-bit partition of a name: h * 31 + byte modulo 2 ** 16 over its first 256 bytes."""
    return fold_bytes(name, F.lit(0).cast("long"), lambda h, b: (h * 31 + b).bitwiseAND(F.lit(0xFFFF)), most=256).bitwiseAND(F.lit(PART_MASK))


def combine(parent: Column, part: Column) -> Column:
    return F.shiftleft(parent.cast("long"), 13).bitwiseOR(part.cast("long"))


def parent_of(combined: Column) -> Column:
    return F.shiftright(combined, 13)


def part_of(combined: Column) -> Column:
    return combined.bitwiseAND(F.lit(PART_MASK))


def rotate32(x: Column, n: int) -> Column:
    return low32(F.shiftleft(x, n)).bitwiseOR(F.shiftright(x, 32 - n))


#: Rotations of the final mix of the 32-bit hash, and its start.
ROTATIONS = (14, 11, 25, 16, 4, 14, 24)
START = 0x9E3779B9 + 4 + 3923095


def hash32(k: Column) -> Column:
    """31-bit hash of an unsigned 32-bit value: each step mixes one of three words with the one mixed before it."""
    start = F.lit(START & LOW32).cast("long")

    def step(s: Column, r: Column) -> Column:
        turned = low32(F.call_function("shiftleft", s["y"], r)).bitwiseOR(F.call_function("shiftright", s["y"], 32 - r))
        return F.struct(s["z"].alias("x"), low32(s["x"].bitwiseXOR(s["y"]) - turned).alias("y"), s["y"].alias("z"))

    first = F.struct(start.alias("x"), start.alias("y"), low32(start + k.cast("long")).alias("z"))
    return F.aggregate(F.array(*map(F.lit, ROTATIONS)), first, step, lambda s: s["y"].bitwiseAND(F.lit(0x7FFFFFFF)))


def shard_hash(combined: Column) -> Column:
    """Placement hash of (parent, part): of the part alone."""
    return hash32(part_of(combined))


def multiply64(x: Column, c: int) -> Column:
    """x * c modulo 2 ** 64, from products that stay under 2 ** 63."""
    cl, ch = c & LOW32, c >> 32

    def product32(a: Column, b: int) -> Column:
        return low32(a * F.lit(b & 0xFFFF) + F.shiftleft((a * F.lit(b >> 16)).bitwiseAND(F.lit(0xFFFF)), 16))

    def parts(v: Column) -> Column:
        a, h = low32(v), high32(v)
        p0, p1 = a * F.lit(cl & 0xFFFF), a * F.lit(cl >> 16)
        low = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
        carry = F.shiftright(low, 32) + F.shiftright(p1, 16)
        return F.shiftleft(low32(carry + product32(a, ch) + product32(h, cl)), 32).bitwiseOR(low32(low))

    return let(x, parts)


def hash64(x: Column) -> Column:
    """64-bit finalizer: shift-xor and multiply, twice, then shift-xor."""
    shifted = lambda v, n: let(v, lambda w: w.bitwiseXOR(F.shiftrightunsigned(w, n)))
    one = multiply64(shifted(x.cast("long"), 30), 0xBF58476D1CE4E5B9)
    two = multiply64(shifted(one, 27), 0x94D049BB133111EB)
    return shifted(two, 31)


def unsigned_mod(x: Column, n: Column | int) -> Column:
    """x as an unsigned 64-bit value modulo n (n under 2 ** 31)."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")
    return let(x, lambda v: ((high32(v) % n) * (F.lit(1 << 32) % n) + low32(v)) % n)


def djb2(text: Column) -> Column:
    """h * 33 + byte modulo 2 ** 64 from 5381, bytes signed."""
    zero = F.struct(F.lit(0).cast("long").alias("h"), F.lit(5381).cast("long").alias("l"))

    def step(s: Column, b: Column) -> Column:
        low = s["l"] * 33 + b
        return F.struct(low32(s["h"] * 33 + F.shiftright(low, 32)).alias("h"), low32(low).alias("l"))

    return fold_bytes(text, zero, step, lambda s: F.shiftleft(s["h"], 32).bitwiseOR(s["l"]))


def inode_id(seq: Column, node: Column) -> Column:
    return F.shiftleft(seq.cast("long"), 12).bitwiseOR(node.cast("long").bitwiseAND(F.lit(0xFFF)))


def sequence_block(nth: Column, step: int = 32) -> Column:
    """The nth number (from 0) of a sequence that is fetched in blocks."""
    n = nth.cast("long")
    return F.floor(n / step).cast("long") * step + 1 + n % step
