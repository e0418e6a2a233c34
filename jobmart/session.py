"""Session settings shared by the bench, the tests and the example jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "jobmart", master: str | None = None, **extra) -> SparkSession:
    """A session with the settings the plans rely on.

    Adaptive execution sizes the shuffle partitions from the data, splits hot partitions of
    a join, and turns a join into a broadcast only when the measured side fits under the
    threshold. On a cluster the same settings apply with a larger
    ``spark.sql.shuffle.partitions``; that value is only the upper bound that adaptive
    execution coalesces from.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
