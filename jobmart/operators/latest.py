"""Newest row or newest values per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """The whole first row of each key in the given order.

    Each task keeps one row per key before the shuffle (the plan shows a partial
    WindowGroupLimit), so a key that owns much of the input sends one row per task.
    ``newest_first`` must be a total order within a key.
    """
    window = Window.partitionBy(*keys).orderBy(*newest_first)
    return (
        df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")
    )


def latest_values(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """``values`` of the row with the greatest ``order`` per key, NULL values included."""
    newest = F.max_by(F.struct(*values), F.struct(*order)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "_newest.*")
