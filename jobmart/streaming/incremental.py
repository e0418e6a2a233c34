"""Incremental newest-per-key load as a structured stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from jobmart.operators.latest import latest_rows


def start_upsert_latest(
    source: DataFrame,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    newest_first: Callable[[], Sequence[Column]],
):
    """Load all available input of a stream, keeping the newest row per key.

    Every micro-batch is reduced to its newest row per key and written to its own folder,
    named by the query's id and the batch number. The id belongs to the checkpoint: a replay
    after a failure overwrites the same folder, so each input row counts once, while a query
    with a new checkpoint, whose numbers start again, leaves the older loads alone. The cost of a batch grows with the batch, not with the table, and
    no state store is kept; late rows need no watermark because the read side compares
    times, not arrival.
    """

    def store(batch: DataFrame, batch_no: int) -> None:
        newest = latest_rows(batch, keys, newest_first())
        name = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        newest.write.mode("overwrite").parquet(f"{target}/load={name}-{batch_no}")

    return (
        source.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(
    spark: SparkSession,
    target: str,
    schema: T.StructType,
    keys: Sequence[str],
    newest_first: Sequence[Column],
) -> DataFrame:
    """The table the loads add up to: the newest row per key over all of them."""
    loads = spark.read.schema(schema).parquet(target)
    return latest_rows(loads.select(schema.names), keys, newest_first)


def compact(
    spark: SparkSession,
    target: str,
    new_target: str,
    schema: T.StructType,
    keys: Sequence[str],
    newest_first: Sequence[Column],
) -> None:
    """Fold all loads into one in a new folder, for readers to switch to."""
    folded = read_latest(spark, target, schema, keys, newest_first)
    folded.write.mode("overwrite").parquet(f"{new_target}/load=compacted")
