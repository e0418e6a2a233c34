"""Incremental newest-per-key load whose reads rank a bounded number of folders.

Every micro-batch is reduced to its newest row per key and becomes a load of level 0. As soon
as a level holds ``fanout`` loads, they are folded into one load of the next level, so that
after n batches a read ranks at most ``fanout - 1`` folders for each of log(n) levels, and every
row is rewritten once a level. A version file names the loads of each state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from jobmart.operators.latest import latest_rows
from jobmart.sources import versions

FANOUT = 4
Order = Callable[[], Sequence[Column]]


def store_batch(
    batch: DataFrame, target: str, name: str, number: int, keys: Sequence[str], newest: Order,
    fanout: int = FANOUT,
) -> bool:
    """Add micro-batch ``number`` of the query ``name``; False if it is there already.

    The batch's folder and its number enter the table with the same version. A replay after a
    crash before that writes the folder again, one after it does nothing.
    """
    spark = batch.sparkSession
    version, content = versions.newest(spark, target)
    content = content or {"loads": [], "done": {}}
    if content["done"].get(name, -1) >= number:
        return False
    folder = f"load={name}-{number}"
    latest_rows(batch, keys, newest()).write.mode("overwrite").parquet(f"{target}/{folder}")
    content["loads"].append({"folder": folder, "level": 0})
    content["done"][name] = number
    versions.commit(spark, target, version + 1, content)
    while fold_level(spark, target, batch.schema, keys, newest, fanout):
        pass
    return True


def fold_level(
    spark: SparkSession, target: str, schema: T.StructType, keys: Sequence[str], newest: Order,
    fanout: int = FANOUT,
) -> bool:
    """Fold the lowest full level into one load of the next; False if no level is full."""
    version, content = versions.newest(spark, target)
    loads = content["loads"]
    counts: dict[int, int] = {}
    for load in loads:
        counts[load["level"]] = counts.get(load["level"], 0) + 1
    full = [level for level, n in sorted(counts.items()) if n >= fanout]
    if not full:
        return False
    level = full[0]
    old = [x["folder"] for x in loads if x["level"] == level]
    folder = f"load={uuid.uuid4().hex}"
    rows = spark.read.schema(schema).parquet(*[f"{target}/{f}" for f in old])
    latest_rows(rows, keys, newest()).write.parquet(f"{target}/{folder}")
    kept = [x for x in loads if x["level"] != level]
    content["loads"] = [*kept, {"folder": folder, "level": level + 1}]
    versions.commit(spark, target, version + 1, content)
    return True


def start(
    source: DataFrame, target: str, checkpoint: str, keys: Sequence[str], newest: Order,
    fanout: int = FANOUT,
):
    """Load all available input of a stream; see the module's text."""

    def store(batch: DataFrame, number: int) -> None:
        name = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        store_batch(batch, target, name, number, keys, newest, fanout)

    return (
        source.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def loads_of(spark: SparkSession, target: str) -> list[dict]:
    _, content = versions.newest(spark, target)
    return content["loads"] if content else []


def read(
    spark: SparkSession, target: str, schema: T.StructType, keys: Sequence[str], newest: Order
) -> DataFrame:
    """The table the loads add up to."""
    folders = [f"{target}/{x['folder']}" for x in loads_of(spark, target)]
    if not folders:
        return spark.createDataFrame([], schema)
    return latest_rows(spark.read.schema(schema).parquet(*folders), keys, newest())
