"""Check queries: discovery, landing, replies, liveness, the incremental stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobmart.checks.registry import check
from jobmart.functions.convert import instant
from jobmart.operators.nested import extract_records
from jobmart.plans import ingest
from jobmart.shared import new_path
from jobmart.streaming.incremental import read_latest, start_upsert_latest

NOW = dt.datetime(2024, 1, 31)

# Listing rows out of events: the type is the crawled category, a slice of the users is a
# page, and a row is of another day when k = 98.
_LISTING = """listing AS (SELECT event_type AS jobcat, user_id % 160 + 1 AS page, ts, event_id,
 k, concat('j', (k * 7 + user_id) % 500) AS job_id FROM ev)"""
_KNOWN = "SELECT concat('j', c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING'"


def listing_of(v):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = v.raw("events").withColumn("k", k)
    day = F.when(F.col("k") == 98, "20240109").when(F.col("k") == 50, "soon").otherwise("20240110")
    link = F.concat(
        F.lit("//jobs.example/job/j"), ((F.col("k") * 7 + F.col("user_id")) % 500).cast("string"),
        F.when(F.col("k") % 2 == 0, "?from=list").otherwise("/"),
    )
    return rows.select(
        F.col("event_type").alias("jobcat"),
        (F.col("user_id") % 160 + 1).alias("page"),
        F.struct("ts", "event_id").alias("pos"),
        day.alias("appearDate"),
        link.alias("link"),
    )


def known_of(v):
    customers = v.raw("customer").where("c_mktsegment = 'BUILDING'")
    return customers.selectExpr("concat('j', c_custkey) AS job_id")


@check(
    "discover_ids",
    f"""WITH {_LISTING}, body AS (SELECT * FROM listing QUALIFY row_number()
 OVER (PARTITION BY jobcat, page ORDER BY ts, event_id) > 2),
 today AS (SELECT * FROM body WHERE k <> 50 QUALIFY max(CASE WHEN k = 98 THEN 1 ELSE 0 END)
 OVER (PARTITION BY jobcat ORDER BY page, ts, event_id ROWS UNBOUNDED PRECEDING) = 0)
 SELECT DISTINCT job_id, 'PENDING' AS status, epoch_us(TIMESTAMP '2024-01-09 16:00:00')
 AS appeardate FROM today WHERE job_id NOT IN ({_KNOWN})""",
    "ev",
)
def discover_ids(v):
    return ingest.discover_ids(listing_of(v), known_of(v), day=dt.date(2024, 1, 10))


@check(
    "discover_ids_history",
    f"""WITH {_LISTING} SELECT job_id, 'PENDING' AS status, CASE WHEN k = 98 THEN
 epoch_us(TIMESTAMP '2024-01-09') ELSE epoch_us(TIMESTAMP '2024-01-10') END AS appeardate
 FROM listing WHERE k <> 50 AND job_id NOT IN ({_KNOWN}) QUALIFY row_number()
 OVER (PARTITION BY job_id ORDER BY jobcat, page, ts, event_id) = 1""",
    "ev",
)
def discover_ids_history(v):
    return ingest.discover_ids(listing_of(v), known_of(v), ads_per_page=0, zone="UTC")


@check(
    "land_details",
    """SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id)
 AS record_index_in_batch, '20240131_002' AS batch_id, epoch_us(TIMESTAMP '2024-01-31')
 AS ingestion_timestamp, CASE WHEN event_type = 'error' THEN epoch_us(TIMESTAMP '2024-01-31')
 ELSE CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000000 END
 AS source_response_timestamp FROM events""",
)
def land_details(v):
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    replies = v.raw("events").select(
        "event_id", "user_id", "ts",
        F.when(F.col("event_type") != "error", epoch).alias("now_epoch"),
    )
    landed = ingest.land_details(
        replies, ["ts", "event_id"], dt.date(2024, 1, 31), 2, instant(NOW)
    )
    return landed.drop("ts")


@check(
    "complete_ids",
    """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem
 WHERE l_quantity > 45) THEN 'COMPLETED' ELSE 'PENDING' END AS status FROM orders""",
)
def complete_ids(v):
    ids = v.raw("orders").selectExpr("o_orderkey AS job_id", "'PENDING' AS status")
    landed = v.raw("lineitem").where("l_quantity > 45").selectExpr("l_orderkey AS job_id")
    return ingest.complete_ids(ids, landed)


@check(
    "extract_records",
    """SELECT event_id, CASE WHEN event_type <> 'signup' THEN concat('raw ', k) END
 AS raw_skill_name, k FROM ev WHERE event_type NOT IN ('error', 'purchase') UNION ALL
 SELECT event_id, 'extra', 0 FROM ev WHERE event_type = 'view'""",
    "ev",
)
def extract(v):
    """Replies with prose, code fences, several records, broken JSON and no JSON."""
    k = F.get_json_object("props", "$.k")
    record = F.concat(F.lit('{"raw_skill_name": "raw '), k, F.lit('", "k": '), k, F.lit("}"))
    bare = F.concat(F.lit('{"k": '), k, F.lit("}"))
    kind = F.col("event_type")
    reply = (
        F.when(kind == "click", F.concat(F.lit("Here it is:\n```json\n[\n"), record, F.lit("\n]\n```\nDone.")))
        .when(kind == "view", F.concat(F.lit("["), record, F.lit(', {"raw_skill_name": "extra", "k": 0}]')))
        .when(kind == "signup", F.concat(F.lit("```json\n"), bare, F.lit("\n```")))
        .when(kind == "error", F.concat(F.lit("Sorry: ["), record, F.lit(", {]")))
        .otherwise(F.lit("nothing to report"))
    )
    replies = v.raw("events").select("event_id", reply.alias("reply"))
    return extract_records(
        replies, "reply", "struct<raw_skill_name:string,k:int>", keep=["event_id"]
    )


@check(
    "liveness_merge",
    """SELECT job_id, CASE WHEN flag IS NULL THEN url_status WHEN flag IN ('R', 'A') THEN 'off'
 ELSE 'on' END AS url_status, CASE WHEN flag IS NULL THEN epoch_us(updated_at) ELSE
 epoch_us(TIMESTAMP '2024-01-31') END AS updated_at FROM job LEFT JOIN (SELECT l_orderkey,
 max(l_returnflag) AS flag FROM lineitem WHERE l_quantity > 30 GROUP BY 1)
 ON job_id = l_orderkey""",
    "job",
)
def liveness_merge(v):
    flags = v.raw("lineitem").where("l_quantity > 30").groupBy(
        F.col("l_orderkey").alias("job_id")
    ).agg(F.max("l_returnflag").alias("flag"))
    results = flags.select(
        "job_id",
        F.when(F.col("flag") == "R", ingest.NOT_FOUND).otherwise(F.lit("ok")).alias("status"),
        F.when(F.col("flag") == "A", "off").when(F.col("flag") == "N", "on").alias("switch"),
    )
    job = v.job.select("job_id", "url_status", "updated_at")
    return ingest.apply_liveness(job, results, instant(NOW))


_EVENT_KEYS = ["user_id"]


def _newest_event():
    return [F.col("ts").desc(), F.col("event_id").desc()]


@check(
    "stream_upsert_latest",
    "SELECT user_id, event_id, event_type, value, props, epoch_us(ts) AS ts FROM events QUALIFY"
    " row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def stream_upsert_latest(v):
    """The whole event table landed in daily folders and streamed in several micro-batches."""
    events = v.raw("events")
    landed = new_path(v.spark, "landed")
    events.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(landed)
    stream = (
        v.spark.readStream.schema(events.schema)
        .option("maxFilesPerTrigger", 10).parquet(landed)
        .select(*events.columns)
    )
    target, progress = new_path(v.spark, "latest"), new_path(v.spark, "progress")
    query = start_upsert_latest(stream, target, progress, _EVENT_KEYS, _newest_event)
    query.awaitTermination()
    return read_latest(v.spark, target, events.schema, _EVENT_KEYS, _newest_event())
