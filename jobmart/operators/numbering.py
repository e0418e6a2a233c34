"""Row numbers over a whole table or a group of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmart.operators.sequence import with_group
from jobmart.shared import materialize


def number_rows(
    df: DataFrame, order: Sequence[Column | str], name: str = "row_no", start: int = 1
) -> DataFrame:
    """Consecutive numbers in ``order``, which must be a total order.

    A window without partitions would pull the table into one task. Instead the rows are
    range-partitioned and sorted, every row gets its place inside its partition, and the
    partition sizes (one row per partition) give the offsets. The sorted rows are written
    once, since places and sizes must come from the same partitioning.
    """
    # monotonically_increasing_id is the partition number in the upper bits and the place
    # inside the partition in the lower 33.
    placed = materialize(
        df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered"
    )
    part = F.shiftright("_place", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    # One row per sort partition: bounded by spark.sql.shuffle.partitions.
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    place = F.col("_place") - F.shiftleft(F.col("_part"), 33)
    return joined.withColumn(name, F.col("_offset") + place + F.lit(start)).drop(
        "_part", "_place", "_offset"
    )


def number_within(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column | str],
    name: str = "row_no",
    start: int = 1,
) -> DataFrame:
    """Consecutive numbers within each group, for groups too large for one window task."""
    numbered = number_rows(df, [*groups, *order], "_pos")
    first = numbered.groupBy(*groups).agg(F.min("_pos").alias("_first"))
    joined = with_group(numbered, first, groups, "inner")
    return joined.withColumn(name, F.col("_pos") - F.col("_first") + F.lit(start)).drop(
        "_pos", "_first"
    )


def batches_of(df: DataFrame, order: Sequence[Column | str], size: int) -> DataFrame:
    """Tag rows with the number of their fixed-size batch, counted from 0."""
    numbered = number_rows(df, order, "_pos", start=0)
    return numbered.withColumn("batch_no", F.floor(F.col("_pos") / size)).drop("_pos")


def surrogate_key(df: DataFrame, unique_key: Sequence[str], name: str) -> DataFrame:
    numbered = number_rows(df, unique_key, name)
    return numbered.select(name, *df.columns)


def positional_join(
    left: DataFrame,
    right: DataFrame,
    left_order: Sequence[Column | str],
    right_order: Sequence[Column | str],
) -> DataFrame:
    """Pair the i-th row of one table with the i-th of the other, up to the shorter one."""
    return number_rows(left, left_order).join(number_rows(right, right_order), "row_no")


def allocate_ids(
    known: DataFrame, rows: DataFrame, keys: Sequence[str], name: str, start: int = 1
) -> DataFrame:
    """The keys of ``known`` and ``rows`` with lasting ids.

    ``known`` holds ``keys`` and the id ``name`` of earlier loads, which stay; keys that only
    ``rows`` has continue after the largest id, in key order, without gaps. Only the new keys
    are sorted, so a load costs by what is new. Keys compare null-safe, as in a grouping.
    """
    marked = known.select(*keys, name, F.lit(0).alias("_new")).unionByName(
        rows.select(*keys).distinct().withColumns(
            {name: F.lit(None).cast(known.schema[name].dataType), "_new": F.lit(1)}
        )
    )
    # one group per key keeps NULL keys together, which an anti join would not
    grouped = marked.groupBy(*keys).agg(F.max(name).alias(name), F.min("_new").alias("_new"))
    fresh = grouped.where("_new = 1").select(*keys)
    largest = known.agg(F.coalesce(F.max(name), F.lit(start - 1)).cast("long")).first()[0]
    numbered = number_rows(fresh, keys, "_no", start=1)
    new = numbered.select(
        *keys, (F.col("_no") + F.lit(largest)).cast(known.schema[name].dataType).alias(name)
    )
    return known.select(*keys, name).unionByName(new)
