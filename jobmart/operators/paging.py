"""Filters, limits and pages of the read side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmart.operators.numbering import number_rows

#: Rows of a stored block; a page reads the one or two blocks it lies in. Smaller blocks share a
#: folder of about as many rows.
BLOCK_ROWS = 100_000


def where_all(df: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """Apply the conditions that are set; with none set the table passes unchanged."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(and_, given)) if given else df


def equals_unless_all(column: str, value: str | None) -> Column | None:
    """Equality on a text or number column; ``None``, '' and ``ALL`` mean no filter."""
    if value is None or value == "" or str(value).upper() == "ALL":
        return None
    return F.col(column).cast("string") == F.lit(str(value))


def page_of(df: DataFrame, order: Sequence[Column], page: int, per_page: int) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def store_pages(
    df: DataFrame, order: Sequence[Column], path: str, block_rows: int = BLOCK_ROWS
) -> None:
    """Store ``df`` with ``row_no`` in ``order``, a total order, cut into blocks of
    ``block_rows`` consecutive rows.

    A folder holds whole blocks of at least ``BLOCK_ROWS`` rows together, sorted by ``row_no``,
    so small blocks do not make a folder each. Inside its file a block is a page of its own,
    which readers find by the index of ``row_no``.
    """
    folder_rows = block_rows * -(-BLOCK_ROWS // block_rows)
    numbered = number_rows(df, order, "row_no")
    block = F.floor((F.col("row_no") - 1) / folder_rows).cast("long")
    placed = numbered.withColumn("block", block).repartition("block")
    writer = placed.sortWithinPartitions("block", "row_no").write.partitionBy("block")
    writer.option("parquet.page.row.count.limit", block_rows).parquet(path)
    size = df.sparkSession.createDataFrame([(folder_rows,)], "block_rows long")
    size.write.parquet(f"{path}/_size")


def read_page(spark: SparkSession, path: str, page: int, per_page: int) -> DataFrame:
    """Page ``page`` of rows stored by :func:`store_pages`, in their order. Only the folders
    the page lies in are read, so every page costs the same."""
    block_rows = spark.read.parquet(f"{path}/_size").first()[0]
    low, high = (page - 1) * per_page + 1, page * per_page
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    here = F.col("block").between((low - 1) // block_rows, (high - 1) // block_rows)
    return rows.where(here & F.col("row_no").between(low, high)).orderBy("row_no").drop("block")


def page_total(df: DataFrame, key: str, per_page: int) -> DataFrame:
    """Exact number of distinct keys and of pages; an empty result still has one page."""
    total = df.agg(F.count_distinct(key).alias("total_count"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_count") / per_page)).cast("long")
    return total.withColumn("total_pages", pages)


def fallback_if_empty(filtered: DataFrame, everything: DataFrame) -> DataFrame:
    """``filtered``, or ``everything`` when the filter leaves no row."""
    return filtered.unionByName(everything.where(~filtered.exists()))
