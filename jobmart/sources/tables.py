"""Readers and writers of the landed and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobmart.sources.schemas import BRONZE, JOB_IDS, TABLES, conform


def read_job_details(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed posting documents. The schema is declared, so no inference pass is made."""
    return spark.read.schema(BRONZE).format(fmt).load(path)


def read_job_ids(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(JOB_IDS).format(fmt).load(path)


def pending_jobs(job_ids: DataFrame) -> DataFrame:
    return job_ids.where("status = 'PENDING'")


def write_job_details(details: DataFrame, path: str) -> None:
    """Append documents, one folder per ingest day so that a time window reads few files.

    A task that writes several days sorts its documents by day first. They are whole postings,
    far larger than the rows they may come from, so they are dealt anew by their own size: a
    task then holds no more of them, however much one input split unfolds to.
    """
    by_day = details.selectExpr("*", "to_date(ingestion_timestamp) AS ingest_day")
    by_day = by_day.hint("rebalance", "ingest_day")
    by_day.write.mode("append").partitionBy("ingest_day").parquet(path)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table].schema).parquet(path)


def write_table(df: DataFrame, path: str, table: str) -> None:
    """Write a new version of a table; ``path`` must not be one that ``df`` reads."""
    conform(df, table).write.mode("overwrite").parquet(path)


def save_bucketed(
    df: DataFrame, name: str, path: str, key: str = "job_id", buckets: int = 512
) -> DataFrame:
    """Store a table hashed and sorted by ``key``.

    Tables stored with the same key and number of buckets join on the key without moving
    rows, which pays for the silver tables that every gold plan joins on the job.
    """
    writer = df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
    writer.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    split_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    splits: int = 16,
    **options: str,
) -> DataFrame:
    """A database table; with a numeric ``split_column`` it is read in parallel ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_column and bounds:
        reader = reader.options(
            partitionColumn=split_column,
            lowerBound=bounds[0],
            upperBound=bounds[1],
            numPartitions=splits,
        )
    return reader.load()


def write_jdbc_table(
    df: DataFrame, url: str, table: str, batch_rows: int = 200, **options: str
) -> None:
    writer = df.write.format("jdbc").mode("append")
    writer.options(url=url, dbtable=table, batchsize=batch_rows, **options).save()
