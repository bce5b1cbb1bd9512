"""Rebalancing plans for shard maps."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.placement import rebalance


def rebalance_to(shard_map: DataFrame, targets: DataFrame) -> DataFrame:
    """Moves (range_point, from_server, to_server) that leave at most ceil(shards / targets) shards on each target."""
    return rebalance(shard_map, targets)
