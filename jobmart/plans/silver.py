"""Silver tables out of the landed posting documents."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmart.functions.convert import instant, to_day, to_double, to_int
from jobmart.functions.text import first_int, last_segment
from jobmart.operators.latest import latest_rows, latest_values
from jobmart.operators.matching import match_terms, reference_list
from jobmart.operators.merge import upsert
from jobmart.operators.nested import as_array, first_index, unwind
from jobmart.sources import parted

# --- Fixed values: codes and tags carried into the silver tables. ---
NEGOTIABLE_SALARY_TYPE = 10
REMOTE_NOT_SPECIFIED = "NOT_SPECIFIED"
REMOTE_BY_TYPE = {1: "ON_SITE_TYPE1", 2: "HYBRID_TYPE2"}
REQUIREMENT_TYPES = ["MAJOR", "DRIVER_LICENSE", "ACCEPT_ROLE", "WORK_TYPE", "CERTIFICATE"]
# --- End of fixed values. ---

NEWEST = ["ingestion_timestamp", "batch_id", "record_index_in_batch"]
DOC_KEY = ["batch_id", "record_index_in_batch", "ingestion_timestamp"]


def load_window(as_of: dt.date) -> tuple[dt.datetime, dt.datetime]:
    """The half-open look-back of a daily load: yesterday 23:55 up to tomorrow 00:00."""
    day = dt.datetime.combine(as_of, dt.time.min)
    return day - dt.timedelta(minutes=5), day + dt.timedelta(days=1)


def in_window(df: DataFrame, column: str, as_of: dt.date | None) -> DataFrame:
    """Rows inside the look-back of ``as_of``; ``None`` means the full history.

    On a landed table the folder of the ingest day is tested too, so only two days are read.
    """
    if as_of is None:
        return df
    low, high = load_window(as_of)
    if "ingest_day" in df.columns:
        df = df.where(F.col("ingest_day").between(F.lit(low.date()), F.lit(as_of)))
    return df.where((F.col(column) >= instant(low)) & (F.col(column) < instant(high)))


def active_documents(bronze: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    return in_window(bronze.where("switch = 'on'"), "ingestion_timestamp", as_of)


def _job_id() -> Column:
    return last_segment(F.col("header.analysisUrl"))


def _newest_first(columns: Sequence[str] = NEWEST) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def silver_company(bronze: DataFrame, now: Column, as_of: dt.date | None = None) -> DataFrame:
    """One row per company with the values of its newest batch."""
    docs = active_documents(bronze, as_of).where("custNo IS NOT NULL").select(
        F.col("custNo").alias("cust_no"),
        F.col("header.custName").alias("cust_name"),
        F.col("header.custUrl").alias("cust_url"),
        F.col("industry").alias("industry_name"),
        F.col("industryNo").alias("industry_no"),
        F.col("employees").alias("employees_raw"),
        F.col("batch_id").alias("_source_batch_id"),
        "ingestion_timestamp",
        "record_index_in_batch",
    )
    values = ["cust_name", "cust_url", "industry_name", "industry_no", "employees_raw",
              "_source_batch_id"]
    order = ["_source_batch_id", "ingestion_timestamp", "record_index_in_batch"]
    newest = latest_values(docs, ["cust_no"], values, [F.col(c) for c in order])
    return newest.select(
        "cust_no",
        "cust_name",
        "cust_url",
        "industry_name",
        "industry_no",
        first_int(F.col("employees_raw")).alias("employees_count"),
        "employees_raw",
        now.alias("_silver_updated_at"),
        "_source_batch_id",
    )


def project_job(docs: DataFrame, now: Column) -> DataFrame:
    """The job columns of posting documents that carry ``job_id``."""
    detail = "jobDetail."
    negotiable = F.coalesce(
        F.col(detail + "salaryType") == NEGOTIABLE_SALARY_TYPE, F.lit(False)
    )
    remote_type = F.col(detail + "remoteWork.type")
    remote = F.lit(REMOTE_NOT_SPECIFIED)
    for code, label in REMOTE_BY_TYPE.items():
        remote = F.when(remote_type == code, label).otherwise(remote)

    def salary(name: str) -> Column:
        return F.when(negotiable, 0).otherwise(F.col(detail + name))

    return docs.select(
        "job_id",
        F.col("custNo").alias("cust_no"),
        F.col("header.jobName").alias("job_name"),
        to_day(F.col("header.appearDate")).alias("appear_date"),
        to_day(F.col("closeDate")).alias("close_date"),
        F.col(detail + "jobDescription").alias("job_description"),
        F.col(detail + "salary").alias("salary_raw_text"),
        salary("salaryMin").alias("salary_min"),
        salary("salaryMax").alias("salary_max"),
        F.col(detail + "salaryType").alias("salary_type_code"),
        negotiable.alias("is_salary_negotiable"),
        F.col(detail + "jobType").alias("job_type_code"),
        F.col("condition.workExp").alias("work_exp_requirement"),
        F.col("condition.edu").alias("edu_requirement"),
        to_int(F.col("postalCode")).cast("string").alias("postal_code"),
        F.col(detail + "addressRegion").alias("address_region"),
        F.col(detail + "addressArea").alias("address_area"),
        F.col(detail + "addressDetail").alias("address_detail"),
        F.col(detail + "landmark").alias("landmark"),
        to_double(F.col(detail + "longitude")).try_cast("decimal(10,6)").alias("longitude"),
        to_double(F.col(detail + "latitude")).try_cast("decimal(10,6)").alias("latitude"),
        remote.alias("remote_work_status"),
        F.nullif(F.col(detail + "remoteWork.description"), F.lit("")).alias(
            "remote_work_description"
        ),
        F.col(detail + "vacationPolicy").alias("vacation_policy_text"),
        F.col(detail + "businessTrip").alias("business_trip_text"),
        F.col(detail + "manageResp").alias("manage_resp_text"),
        F.col(detail + "startWorkingDay").alias("start_working_day_text"),
        F.col(detail + "needEmp").alias("need_emp_count_text"),
        to_double(F.col("header.hrBehaviorPR")).try_cast("decimal(5,4)").alias(
            "hr_behavior_pr"
        ),
        F.col("contact.email").alias("contact_email"),
        F.col("welfare.welfare").alias("welfare_description"),
        F.col("header.analysisUrl").alias("analysis_url"),
        now.alias("updated_at"),
        F.col("batch_id").alias("source_batch_id"),
        F.col("switch").alias("url_status"),
    )


# Columns the daily load never overwrites: the status belongs to the liveness check.
JOB_KEPT_ON_UPDATE = ["url_status"]


def silver_job(bronze: DataFrame, now: Column, as_of: dt.date | None = None) -> DataFrame:
    """One row per posting from its newest active document; postings without id are left out."""
    docs = active_documents(bronze, as_of).withColumn("job_id", _job_id())
    newest = latest_rows(docs.where("job_id IS NOT NULL"), ["job_id"], _newest_first())
    return project_job(newest, now)


def load_silver_job(
    path: str, bronze: DataFrame, now: Column, as_of: dt.date | None = None, parts: int = 256
) -> list[int]:
    """Load the postings into the stored table at ``path`` and give the parts it rewrote.

    A known posting takes the values of its newest document but keeps its status, which the
    liveness check may have changed since; a new posting takes its status from the document.
    The first load creates the table.
    """
    rows = silver_job(bronze, now, as_of)
    if not parted.exists(bronze.sparkSession, path):
        parted.create(rows, path, ["job_id"], parts)
        return list(range(parts))
    updated = [c for c in rows.columns if c not in ("job_id", *JOB_KEPT_ON_UPDATE)]
    return parted.upsert(path, rows, update_cols=updated)


def silver_job_category(bronze: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Categories over all snapshots; per key the newest snapshot gives text and position."""
    docs = active_documents(bronze, as_of).select(
        _job_id().alias("job_id"), F.col("jobDetail.jobCategory").alias("cats"), *NEWEST
    )
    rows = unwind(docs.where("job_id IS NOT NULL"), F.col("cats"), "cat").select(
        "job_id",
        F.col("cat.code").alias("category_code"),
        F.col("cat.description").alias("category_description"),
        first_index(F.col("cats"), F.col("cat")).alias("seq_no"),
        *NEWEST,
    )
    order = [*[F.col(c) for c in NEWEST], -F.col("seq_no")]
    return latest_values(
        rows.where("category_code IS NOT NULL"),
        ["job_id", "category_code"],
        ["category_description", "seq_no"],
        order,
    )


def _condition_array(bronze: DataFrame, field: str) -> Column:
    kind = bronze.schema["condition"].dataType[field].dataType
    return as_array(F.col(f"condition.{field}"), kind)


def condition_references(bronze: DataFrame, field: str) -> DataFrame:
    """Reference list of one structured field, over all documents of any status."""
    items = unwind(bronze, _condition_array(bronze, field), "item").select(
        F.col("item.code").alias("item_code"), F.col("item.description").alias("item_name"),
        *NEWEST,
    )
    return reference_list(items, "item_code", "item_name", [F.col(c) for c in NEWEST])


def merge_references(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored reference list with the entries of ``fresh`` replaced or added."""
    return upsert(stored, fresh, ["code"])


def match_condition(
    bronze: DataFrame, names: DataFrame, field: str, as_of: dt.date | None = None
) -> DataFrame:
    """Distinct (job_id, code, name) of reference names listed or mentioned in a posting.
    Documents without ``condition`` are left out, with their description."""
    listed = F.transform(_condition_array(bronze, field), lambda x: x["description"])
    columns = {"other": "condition.other", "description": "jobDetail.jobDescription"}
    docs = active_documents(bronze, as_of).where("condition IS NOT NULL").select(
        _job_id().alias("job_id"),
        listed.alias("listed"),
        *[F.coalesce(F.col(c), F.lit("")).alias(name) for name, c in columns.items()],
    ).where("job_id IS NOT NULL")
    # Snapshots and postings repeat their texts: each text is searched once, and what it holds
    # goes to the jobs that have it.
    text_key = F.concat(*[F.unhex(F.sha2(F.col(name), 256)) for name in columns]).alias("text_key")
    texts = docs.select(*columns).distinct().select(text_key, *columns)
    found = match_terms(texts, names, ["text_key"], list(columns))
    mentioned = docs.select("job_id", text_key).distinct().join(found, "text_key")
    rows = docs.select("job_id", F.explode("listed").alias("name")).distinct()
    by_name = rows.join(names.select("code", "name"), "name")
    key = ["job_id", "code", "name"]
    return mentioned.select(key).unionByName(by_name.select(key)).distinct()


def silver_job_skill(
    bronze: DataFrame, names: DataFrame, as_of: dt.date | None = None
) -> DataFrame:
    found = match_condition(bronze, names, "skill", as_of)
    return found.toDF("job_id", "skill_code", "skill_description")


def silver_job_specialty(
    bronze: DataFrame, names: DataFrame, as_of: dt.date | None = None
) -> DataFrame:
    found = match_condition(bronze, names, "specialty", as_of)
    return found.toDF("job_id", "specialty_code", "specialty_name")


def silver_language(bronze: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Newest levels per posting and language; within a document the first entry counts."""
    docs = active_documents(bronze, as_of).select(
        _job_id().alias("job_id"), *NEWEST, F.posexplode("condition.language").alias("pos", "l")
    )
    levels = ["listening", "speaking", "reading", "writing"]
    rows = docs.where("job_id IS NOT NULL AND l.code IS NOT NULL").select(
        "job_id",
        F.col("l.code").alias("language_code"),
        F.col("l.language").alias("language_name"),
        *[F.col(f"l.ability.{x}").alias(f"{x}_level") for x in levels],
        *NEWEST,
        "pos",
    )
    return latest_values(
        rows,
        ["job_id", "language_code"],
        ["language_name", *[f"{x}_level" for x in levels]],
        [*[F.col(c) for c in NEWEST], -F.col("pos")],
    )


def silver_requirement(
    bronze: DataFrame, as_of: dt.date | None = None, certificate_field: str = "description"
) -> DataFrame:
    """Five multi-valued conditions as (job_id, type, value) rows, read in one pass.

    Older documents carry the certificate under ``name``.
    """

    def described(field: str, part: str = "description") -> Column:
        return F.transform(F.col(field), lambda x: x[part])

    arrays = [
        F.col("condition.major"),
        F.col("condition.driverLicense"),
        described("condition.acceptRole.role"),
        F.col("jobDetail.workType"),
        described("condition.certificate", certificate_field),
    ]
    rows_type = "array<struct<requirement_type:string,requirement_value:string>>"

    def tagged(tag: str, values: Column) -> Column:
        pairs = F.transform(
            values,
            lambda v: F.struct(
                F.lit(tag).alias("requirement_type"), v.alias("requirement_value")
            ),
        )
        return F.coalesce(pairs.cast(rows_type), F.array().cast(rows_type))

    items = F.concat(*[tagged(t, a) for t, a in zip(REQUIREMENT_TYPES, arrays)])
    docs = active_documents(bronze, as_of).select(
        _job_id().alias("job_id"), items.alias("items")
    )
    rows = docs.where("job_id IS NOT NULL").select("job_id", F.inline("items"))
    return rows.where("requirement_value IS NOT NULL").distinct()
