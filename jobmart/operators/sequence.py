"""Order-dependent selections, written as aggregates so that no group is held in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmart.operators.latest import latest_rows


def with_group(df: DataFrame, per_group: DataFrame, groups: Sequence[str], how: str) -> DataFrame:
    """``df`` with the columns of ``per_group``, one row per group; a NULL group is a group."""
    renamed = per_group.withColumnsRenamed({g: f"_group_{g}" for g in groups})
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_group_{g}"))
    return df.join(renamed, same, how).drop(*[f"_group_{g}" for g in groups])


def skip_head(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], n: int
) -> DataFrame:
    """Drop the first ``n`` rows of every group; ``order`` is total and ascending.

    Only the head rows pass a window (each task keeps at most ``n`` per group). Their last
    position is the cut-off that the remaining rows are compared with.
    """
    window = Window.partitionBy(*groups).orderBy(*order)
    heads = (
        df.select(*groups, *[c for c in order if c not in groups])
        .withColumn("_rank", F.row_number().over(window))
        .where(F.col("_rank") <= n)
    )
    cut = heads.groupBy(*groups).agg(F.max(F.struct(*order)).alias("_cut"))
    return with_group(df, cut, groups, "inner").where(F.struct(*order) > F.col("_cut")).drop("_cut")


def take_while(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], keep: Column
) -> DataFrame:
    """Rows of each group that come before its first row failing ``keep``."""
    stop = (
        df.where(~F.coalesce(keep, F.lit(False)))
        .groupBy(*groups)
        .agg(F.min(F.struct(*order)).alias("_stop"))
    )
    joined = with_group(df, stop, groups, "left")
    before = F.col("_stop").isNull() | (F.struct(*order) < F.col("_stop"))
    return joined.where(before).drop("_stop")


def first_occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row at which each key is seen first in scan order."""
    return latest_rows(df, keys, [F.col(c).asc() for c in order])
