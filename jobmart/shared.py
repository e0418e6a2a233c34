"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a stored table for each shuffle partition before adaptive execution coalesces, and
#: bytes of shuffled rows up to which it does. A task that holds such a partition in a few hash
#: tables at once takes some hundred megabytes.
PARTITION_BYTES = 8 << 20
COALESCED = "16m"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under the one named by ``spark.checkpoint.dir``, or by
    ``SparkContext.setCheckpointDir`` where the setting is absent.

    There is no other place: a machine-local folder would be lost with its executor. Tests, the
    bench and the driver contract set one of the two themselves.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{named.rstrip('/')}/jobmart-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and continue from the written table.

    Used where several later steps must see the very same rows, and to cut lineage: a lost
    executor then re-reads files instead of recomputing the plan.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def with_room(df: DataFrame) -> DataFrame:
    """``df``, a stored table, after the session got shuffle partitions enough for it.

    A fixed number of partitions gives every task more rows as tables grow. Here the number
    that adaptive execution starts from follows the largest table read so far; it coalesces
    small partitions and splits hot ones as before, and a larger number set by hand stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    now = int(conf.get(name, None) or conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-estimated_bytes(df) // PARTITION_BYTES)
    if wanted > now:
        conf.set(name, str(wanted))
        conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", COALESCED)
    return df


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it when its results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
