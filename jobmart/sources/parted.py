"""Stored tables cut into parts by a hash of their key, merged part by part.

A merge reads and rewrites only the parts that hold a key of the source, and a new version
points to the new folders of these and to the old folders of all others. With a part for about
a gigabyte, a daily load costs in proportion to the parts it touches, not to the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmart.operators import merge
from jobmart.operators.latest import latest_rows
from jobmart.shared import materialize
from jobmart.sources import versions

PART = "_part"


def _part(keys: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _store(rows: DataFrame, path: str, touched: Sequence[int]) -> dict[str, str]:
    """Write ``rows``, which carry their part, and name each touched part's new folder."""
    load = f"load={uuid.uuid4().hex}"
    rows.repartition(max(1, len(touched)), PART).write.partitionBy(PART).parquet(f"{path}/{load}")
    return {str(p): f"{load}/{PART}={p}" for p in touched}


def _written(spark: SparkSession, path: str, folders: Mapping[str, str]) -> dict[str, str]:
    """Only the folders that hold files: a part without rows has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    loads = {f.split("/")[0] for f in folders.values()}
    found = set()
    for load in loads:
        place = hadoop.Path(f"{path}/{load}")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        found |= {f"{load}/{s.getPath().getName()}" for s in files.listStatus(place)}
    return {p: f for p, f in folders.items() if f in found}


def _rows(spark: SparkSession, path: str, schema: T.StructType, folders: Sequence[str]):
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def create(rows: DataFrame, path: str, keys: Sequence[str], parts: int = 256) -> None:
    """Store ``rows``, unique by ``keys``, as the first version of a table of ``parts`` parts.
    Rows with a NULL in the key are left out, as a primary key has it."""
    spark = rows.sparkSession
    valid = rows.dropna(subset=list(keys)).withColumn(PART, _part(keys, parts))
    folders = _store(valid, path, range(parts))
    content = {
        "keys": list(keys), "parts": parts, "schema": rows.schema.json(),
        "folders": _written(spark, path, folders),
    }
    versions.commit(spark, path, 1, content)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the table; later merges do not change what this frame reads."""
    _, content = versions.newest(spark, path)
    if content is None:
        raise FileNotFoundError(f"no table at {path}")
    schema = T.StructType.fromJson(json.loads(content["schema"]))
    return _rows(spark, path, schema, sorted(content["folders"].values()))


def exists(spark: SparkSession, path: str) -> bool:
    return versions.newest(spark, path)[1] is not None


def upsert(
    path: str,
    source: DataFrame,
    update_cols: Sequence[str] | None = None,
    newest_first: Sequence[Column] | None = None,
    defaults: Mapping[str, Column] | None = None,
) -> list[int]:
    """Merge ``source`` into the table as :func:`jobmart.operators.merge.upsert` does, and give
    the parts it rewrote. Source rows with a NULL in the key are left out. Two merges at once:
    the later one to finish fails and changes nothing."""
    spark = source.sparkSession
    number, content = versions.newest(spark, path)
    if content is None:
        raise FileNotFoundError(f"no table at {path}")
    keys, parts = content["keys"], content["parts"]
    schema = T.StructType.fromJson(json.loads(content["schema"]))
    rows = source.dropna(subset=keys)
    if newest_first is not None:
        rows = latest_rows(rows, keys, newest_first)
    kinds = {k: schema[k].dataType for k in keys}
    rows = rows.withColumns({k: F.col(k).cast(kind) for k, kind in kinds.items()})
    # the source is read twice: once for its parts, once for the merge
    rows = materialize(rows.withColumn(PART, _part(keys, parts)), "merge-source")
    touched = sorted(r[0] for r in rows.select(PART).distinct().collect())
    if not touched:
        return []
    folders = content["folders"]
    old = _rows(spark, path, schema, [folders[str(p)] for p in touched if str(p) in folders])
    merged = merge.upsert(old, rows.drop(PART), keys, update_cols, defaults=defaults)
    new = _store(merged.withColumn(PART, _part(keys, parts)), path, touched)
    content["folders"] = folders | _written(spark, path, new)
    versions.commit(spark, path, number + 1, content)
    return touched


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the loads that the newest version does not point to; give how many. No reader of
    an older version and no merge may be running."""
    _, content = versions.newest(spark, path)
    used = {f.split("/")[0] for f in content["folders"].values()}
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    loads = [s.getPath() for s in files.listStatus(place)]
    old = [p for p in loads if p.getName().startswith("load=") and p.getName() not in used]
    for load in old:
        files.delete(load, True)
    return len(old)
