"""Formatting, codes, times and addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BATCHED, ERROR_CODES, OPCODES, TRANSPORT_OPCODES, code

PG_EPOCH = 946_684_800


def scaled(size: Column, units: list[str]) -> Column:
    """size (a whole number, of a decimal type where it may pass 64 bits) in the first unit in which it is under 10000 (each
    is 1024 of the one before); the last takes any."""
    whole = size.cast("decimal(38,0)")
    out = F.when(size == 0, F.lit("0"))
    for k, unit in enumerate(units):
        step = F.lit(1 << 10 * k)
        part = F.concat(((whole - whole % step) / step).cast("decimal(38,0)").cast("string"), F.lit(unit))
        if k == len(units) - 1:
            return out.otherwise(part)
        out = out.when(whole < F.lit(10_000 << 10 * k).cast("decimal(38,0)"), part)
    return out


def bytes_text(size: Column) -> Column:
    return scaled(size, ["B", "K", "M", "G", "T", "P"])


def count_text(n: Column) -> Column:
    return scaled(n, ["", "K", "M", "G"])


def average_ms(micros: Column, ops: Column) -> Column:
    """Milliseconds an operation, to 3 places under 10, 2 under 100, 1 under 1000, else none."""
    time = micros.cast("double") / F.nullif(ops * 1000, F.lit(0))
    to = lambda places: F.floor(time * 10**places + 0.5) / 10**places
    shown = F.when(time < 10, to(3)).when(time < 100, to(2)).when(time < 1000, to(1)).otherwise(to(0))
    return F.when(ops == 0, micros.cast("double")).otherwise(F.when(shown < 0.001, F.lit(0.0)).otherwise(shown))


def log_position(text: Column) -> Column:
    """'H/L' in hexadecimal digits as H * 2 ** 32 + L; null is 0."""
    part = lambda k: F.conv(F.split_part(text, F.lit("/"), F.lit(k)), 16, 10).cast("long")
    return F.coalesce(F.shiftleft(part(1), 32).bitwiseOR(part(2)), F.lit(0).cast("long"))


def host_of(endpoint: Column) -> Column:
    return F.split_part(endpoint, F.lit(":"), F.lit(1))


def pool_port(endpoint: Column) -> Column:
    """The pool's port: ten above the database's; null without a port."""
    return F.when(F.instr(endpoint, ":") > 0, F.split_part(endpoint, F.lit(":"), F.lit(2)).cast("int") + 10)


def range_list(text: Column) -> Column:
    """'1-3,5' as [1, 2, 3, 5]."""
    bounds = lambda p: F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))
    return F.flatten(F.transform(F.split(text, ","), bounds))


def error_of_message(message: Column) -> Column:
    """The code that a message's ninth character carries ('A' is 1); none is UNKNOWN, no message PROGRAM_ERROR."""
    mark = F.ascii(F.substring(message, 9, 1)) - 64
    return F.when(message.isNull(), F.lit(code("PROGRAM_ERROR"))).when((mark > 0) & (mark < len(ERROR_CODES)), mark).otherwise(F.lit(code("UNKNOWN")))


def batch_class(opcode: Column) -> Column:
    """Name of the batch class of an operation code, or NOT_SUPPORT."""
    return F.coalesce(F.get(F.array(*[F.lit(n if n in BATCHED else "NOT_SUPPORT") for n in OPCODES]), opcode), F.lit("NOT_SUPPORT"))


def transport_opcode(number: Column) -> Column:
    """Operation code of a number of the other transport (from 1); null beyond."""
    return F.get(F.array(*[F.lit(OPCODES.index(n)) for n in TRANSPORT_OPCODES]), number - 1)


def aligned(n: Column, to: int) -> Column:
    return F.floor((n + to - 1) / to).cast("long") * to


def to_pg_micros(unix_micros: Column) -> Column:
    return unix_micros - PG_EPOCH * 1_000_000


def from_pg_micros(pg_micros: Column) -> Column:
    return pg_micros + PG_EPOCH * 1_000_000


UTIME_NOW, UTIME_OMIT = (1 << 30) - 1, (1 << 30) - 2


def resolved_time(seconds: Column, nanos: Column, old: Column, now: Column) -> Column:
    """Nanoseconds to set: now, the old value, or what was given."""
    return F.when(nanos == UTIME_NOW, now).when(nanos == UTIME_OMIT, old).otherwise(seconds * 1_000_000_000 + nanos)


def permissions(old: Column, new: Column) -> Column:
    """New permission bits under the old type bits."""
    return old.bitwiseAND(F.lit(~0x1FF)).bitwiseOR(new.bitwiseAND(F.lit(0x1FF)))


def file_type(mode: Column) -> Column:
    kind = mode.bitwiseAND(F.lit(0o170000))
    return F.when(kind == 0o100000, F.lit("file")).when(kind == 0o040000, F.lit("dir")).otherwise(F.lit("other"))
