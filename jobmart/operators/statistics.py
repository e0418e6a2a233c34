"""Exact order statistics of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmart.operators.sequence import with_group
from jobmart.shared import materialize


def exact_medians(
    df: DataFrame, groups: Sequence[str], value: str, name: str = "median"
) -> DataFrame:
    """The median of the non-NULL ``value`` of each group, the mean of the middle two for an
    even number; NULL for a group without values.

    Equal values become one row with their count before the first shuffle. The counts are then
    sorted over range partitions, where a group may span many, and running sums inside each
    partition with the sums of the partitions before it tell which value holds a middle place.
    No task ever holds a group.
    """
    counted = df.groupBy(*groups, F.col(value).alias("_value")).agg(F.count(value).alias("_n"))
    placed = materialize(
        counted.where("_value IS NOT NULL").orderBy(*groups, "_value")
        .withColumn("_place", F.monotonically_increasing_id()),
        "counted",
    )
    placed = placed.withColumn("_cut", F.shiftright("_place", 33))
    cuts = placed.groupBy(*groups, "_cut").agg(F.sum("_n").alias("_cut_n"))
    # a group has at most one row for each range partition here
    before = Window.partitionBy(*groups).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = cuts.select(
        *groups, "_cut", F.coalesce(F.sum("_cut_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_cut_n").over(whole).alias("_total"),
    )
    inside = Window.partitionBy("_cut", *groups).orderBy("_value")
    running = placed.withColumn("_until", F.sum("_n").over(inside))
    spots = with_group(running, offsets, [*groups, "_cut"], "inner")
    until = F.col("_offset") + F.col("_until")
    since = until - F.col("_n")
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    # at most two values of a group hold a middle place
    middle = spots.where((since < high) & (until >= low))
    picked = middle.groupBy(*groups).agg(
        F.min("_value").alias("_low"), F.max("_value").alias("_high")
    )
    medians = picked.select(*groups, ((F.col("_low") + F.col("_high")) / 2).alias(name))
    every = df.select(*groups).distinct()
    return with_group(every, medians, groups, "left")
