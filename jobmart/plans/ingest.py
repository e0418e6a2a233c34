"""From landed listing pages and responses to ids, documents and status changes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmart.functions.convert import batch_id, compact_day, epoch_or, instant
from jobmart.functions.text import url_path_id
from jobmart.operators.latest import latest_rows
from jobmart.operators.merge import keyed_update
from jobmart.operators.numbering import number_rows
from jobmart.operators.sequence import first_occurrence, skip_head, take_while
from jobmart.shared import materialize

# --- Fixed values: limits, statuses and zone of the landing rules. ---
ADS_PER_PAGE = 2
PENDING, COMPLETED = "PENDING", "COMPLETED"
NOT_FOUND = "404_not_found"
LISTING_ZONE = "Asia/Taipei"
STALE_APPEARED_DAYS, STALE_CHECKED_DAYS = 7, 3
# --- End of fixed values. ---


def discover_ids(
    listing: DataFrame,
    known: DataFrame | None = None,
    day: dt.date | None = None,
    ads_per_page: int = ADS_PER_PAGE,
    zone: str = LISTING_ZONE,
) -> DataFrame:
    """New PENDING ids from landed listing rows (jobcat, page, pos, appearDate, link).

    With ``day`` the advertisement rows of each page are skipped and each category is read
    only up to its first row of another day; without it the whole listing counts (pass
    ``ads_per_page=0`` for the full-history form). Rows without a readable date are passed
    over. An id is reported once, where the scan (category, page, position) meets it first.
    """
    rows = listing
    if ads_per_page:
        rows = skip_head(rows, ["jobcat", "page"], ["pos"], ads_per_page)
    # Column names are case-insensitive: the parsed time takes the place of the text.
    rows = rows.withColumn("appeardate", compact_day(F.col("appearDate"), zone))
    rows = rows.where("appeardate IS NOT NULL")
    if day is not None:
        # read twice below: for the stopping points and for the rows before them
        rows = materialize(rows.select("jobcat", "page", "pos", "appeardate", "link"), "listing")
        local_day = F.to_date(F.from_utc_timestamp("appeardate", zone))
        rows = take_while(rows, ["jobcat"], ["page", "pos"], local_day == F.lit(day))
    ids = rows.withColumn("job_id", url_path_id(F.col("link"))).where("job_id IS NOT NULL")
    first = first_occurrence(ids, ["job_id"], ["jobcat", "page", "pos"])
    fresh = first.select("job_id", F.lit(PENDING).alias("status"), "appeardate")
    if known is not None:
        fresh = fresh.join(known.select("job_id"), "job_id", "left_anti")
    return fresh


def complete_ids(job_ids: DataFrame, landed: DataFrame, key: str = "job_id") -> DataFrame:
    """Mark every registered id that has a landed document as COMPLETED."""
    done = landed.select(key).distinct().withColumn("status", F.lit(COMPLETED))
    return keyed_update(job_ids, done, [key], ["status"])


def land_details(
    responses: DataFrame, order: Sequence[str], day: dt.date, counter: int, now: Column
) -> DataFrame:
    """Stamp the documents of one batch with their lineage fields, counted from 1.

    ``responses`` holds the document columns and ``now_epoch``, the time in the reply.
    """
    numbered = number_rows(responses, order, "record_index_in_batch", start=1)
    return numbered.withColumns(
        {
            "batch_id": batch_id(F.lit(day), F.lit(counter)),
            "ingestion_timestamp": now,
            "source_response_timestamp": epoch_or(F.col("now_epoch"), now),
        }
    ).drop("now_epoch")


def stale_rows(job: DataFrame, now: dt.datetime, check_appeared: bool = True) -> DataFrame:
    """Postings that are on, appeared long enough ago and were not updated lately."""
    at = instant(now)
    rows = job.where("url_status = 'on'").where(
        F.col("updated_at") <= at - F.expr(f"INTERVAL {STALE_CHECKED_DAYS} DAY")
    )
    if check_appeared:
        rows = rows.where(
            F.col("appear_date") <= at - F.expr(f"INTERVAL {STALE_APPEARED_DAYS} DAY")
        )
    return rows


def apply_liveness(
    job: DataFrame, results: DataFrame, now: Column, newest_first: Sequence[Column] | None = None
) -> DataFrame:
    """Set the status from check results (job_id, status, switch).

    A page that is gone or switched off turns the posting off, any other reply turns it on,
    and both count as an update. A NULL status and switch, or no row, means no reply. Of several
    replies for a posting the first by ``newest_first`` counts; without it there may be one.
    """
    replied = results.where("status IS NOT NULL OR switch IS NOT NULL")
    if newest_first is not None:
        replied = latest_rows(replied, ["job_id"], newest_first)
    gone = F.coalesce(F.col("status") == NOT_FOUND, F.lit(False))
    off = F.coalesce(F.col("switch") == "off", F.lit(False))
    verdict = replied.select(
        "job_id", F.when(gone | off, "off").otherwise("on").alias("url_status")
    )
    return keyed_update(job, verdict, ["job_id"], ["url_status"], touch={"updated_at": now})
