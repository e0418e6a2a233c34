"""Versions of a stored table: small JSON files that name the folders readers see.

A version is written aside and renamed into place, which fails if its number is taken. Readers
open the newest version, so they see all folders of a load or none, and a load that dies before
the rename leaves only folders nobody reads.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

_FOLDER = "_versions"


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return hadoop, hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())


def newest(spark: SparkSession, path: str) -> tuple[int, dict[str, Any] | None]:
    """Number and content of the newest version of the table at ``path``; 0 and None without
    one."""
    hadoop, files = _files(spark, path)
    folder = hadoop.Path(f"{path}/{_FOLDER}")
    if not files.util().exists(folder):
        return 0, None
    names = [status.getPath().getName() for status in files.util().listStatus(folder)]
    numbers = [int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit()]
    if not numbers:
        return 0, None
    number = max(numbers)
    lines = spark.read.text(f"{path}/{_FOLDER}/{number:08d}.json", wholetext=True)
    return number, json.loads(lines.first()[0])


def commit(spark: SparkSession, path: str, number: int, content: dict[str, Any]) -> None:
    """Make ``content`` version ``number``; fails if another load has committed that number."""
    hadoop, files = _files(spark, path)
    folder = hadoop.Path(f"{path}/{_FOLDER}")
    files.mkdir(folder, None, True)
    aside = hadoop.Path(folder, f".{uuid.uuid4().hex}")
    flag = spark._jvm.org.apache.hadoop.fs.CreateFlag.CREATE
    options = spark.sparkContext._gateway.new_array(
        spark._jvm.org.apache.hadoop.fs.Options.CreateOpts, 0
    )
    out = files.create(aside, spark._jvm.java.util.EnumSet.of(flag), options)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    files.rename(aside, hadoop.Path(folder, f"{number:08d}.json"), how)
