"""Where check queries and the SQL that must give the same rows are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmart.checks.sql_views import with_views
from jobmart.sources.adapters import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Types every engine prints alike: decimals as doubles, dates as text, times as
    microseconds, string arrays joined with ``|``."""

    def plain(item: T.StructField) -> Column:
        value = F.col(f"`{item.name}`")
        match item.dataType:
            case T.DecimalType():
                value = value.cast("double")
            case T.DateType():
                value = F.date_format(value, "yyyy-MM-dd")
            case T.TimestampType() | T.TimestampNTZType():
                value = F.unix_micros(value.cast("timestamp"))
            case T.ArrayType():
                value = F.array_join(value, "|")
        return value.alias(item.name)

    return df.select(*[plain(item) for item in df.schema])


def check(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(views)`` under ``name``; ``views`` lists the SQL views ``sql`` reads."""

    def register(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return portable(fn(Views(spark, folder)))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(views.split(), sql)
        return fn

    return register
