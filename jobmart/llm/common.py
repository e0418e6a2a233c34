"""What the corpus operators share: steps written to the shared folder, bounded batches."""

from __future__ import annotations

import math
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmart.shared import estimated_bytes, materialize, new_path

__all__ = ["estimated_bytes", "folded", "materialize", "new_path", "part_count", "ready"]

BATCH_ROWS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ready(spark: SparkSession) -> None:
    """Make ``spark`` ready for Python tasks: Arrow batches of at most ``BATCH_ROWS`` rows (and
    of Spark's own bound in bytes), and this package on every worker's path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_jobmart_shipped", False):
        return
    package = Path(__file__).parent.parent
    into = Path(tempfile.mkdtemp(prefix="jobmart-code-"))
    shutil.copytree(
        package, into / "src" / package.name, ignore=shutil.ignore_patterns("__pycache__")
    )
    context.addPyFile(shutil.make_archive(str(into / package.name), "zip", into / "src"))
    context._jobmart_shipped = True


def part_count(df: DataFrame, target_mb: int = 64) -> int:
    """How many partitions of about ``target_mb`` the estimate asks for; the session's setting
    is the least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, math.ceil(estimated_bytes(df) / (target_mb << 20))))


def folded(text: Column) -> Column:
    """Only A-Z become lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)
