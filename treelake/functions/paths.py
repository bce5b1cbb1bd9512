"""Paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import lit_code


def components(path: Column) -> Column:
    """Non-empty parts of a path."""
    return F.filter(F.split(path, "/"), lambda p: p != "")


def base_name(path: Column) -> Column:
    """The last part; of the root '/'."""
    return F.coalesce(F.try_element_at(components(path), F.lit(-1)), F.lit("/"))


def directory_of(path: Column) -> Column:
    """The parts before the last, joined; '' directly under the root."""
    parts = components(path)
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def parent_path(path: Column, level: int = -1) -> Column:
    """level -1: what stands before the last '/' ('' directly under the root). level n: the first n - 1 parts between
    '/', or of a shorter path all parts but the last."""
    if level == -1:
        return F.regexp_replace(path, "/[^/]*$", "")
    parts = components(path)
    kept = F.slice(parts, 1, F.greatest(F.when(F.size(parts) >= level, F.lit(level - 1)).otherwise(F.size(parts) - 1), F.lit(0)))
    return F.concat(F.lit("/"), F.array_join(F.transform(kept, lambda p: F.concat(p, F.lit("/"))), ""))


def sort_key(path: Column) -> Column:
    """Bytes order with '/' before all else, so that parents come before children."""
    return F.translate(path, "/", "\x01")


def route_name(path: Column) -> Column:
    """The name that places a path: its last part without one trailing '/'; of the root '/'."""
    cut = F.when((F.length(path) > 1) & path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    return F.when(path == "/", F.lit("/")).otherwise(F.regexp_extract(cut, "([^/]*)$", 1))


def verify(path: Column, directory: bool | None = None) -> Column:
    """Error code of a path: it starts with '/', and a trailing '/' is for directories."""
    bad = (path == "") | ~path.startswith("/")
    trailing = (F.length(path) > 1) & path.endswith("/")
    out = F.when(path.isNull() | bad, lit_code("PATH_IS_INVALID"))
    if directory is False:
        out = out.when(trailing | (path == "/"), lit_code("PATH_VERIFY_FAILED"))
    return out.otherwise(lit_code("SUCCESS"))


def cache_file(root: str, inode: Column, directories: int) -> Column:
    return F.concat_ws("/", F.lit(root), (inode % directories).cast("string"), F.concat(inode.cast("string"), F.lit("-large")))


def within_limits(path: Column, most: int) -> Column:
    """Whether no part is longer than most bytes."""
    return F.forall(components(path), lambda p: F.octet_length(p) <= most)
