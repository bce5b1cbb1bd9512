"""Typed properties from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def properties(rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """id and a column a key of the object `main` in json; kinds are string, int, long, double, boolean and array (its
    elements joined by commas). A missing key or a value of another kind is null."""
    fields = ", ".join(f"`{k}`: {'array<string>' if t == 'array' else t}" for k, t in keys.items())
    parsed = rows.select("id", F.from_json("json", f"main struct<{fields}>").alias("j"))
    return parsed.select("id", *[F.array_join(F.col(f"j.main.{k}"), ",").alias(k) if t == "array" else F.col(f"j.main.{k}").alias(k) for k, t in keys.items()])
