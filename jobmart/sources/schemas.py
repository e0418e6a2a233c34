"""Declared tables: columns, types, keys, required columns, lengths and references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmart.operators.quality import constraint_report


@dataclass(frozen=True)
class Table:
    """A table declaration. ``refs`` maps a column to (parent table, parent column)."""

    ddl: str
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    lengths: dict[str, int] = field(default_factory=dict)
    refs: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


# --- Fixed values: column names, types, lengths and keys of the exchanged tables. ---

JOB_IDS = "job_id string, status string, appeardate timestamp"

BRONZE = """
switch string, batch_id string, ingestion_timestamp timestamp,
record_index_in_batch int, source_response_timestamp timestamp,
custNo string, industry string, industryNo string, employees string,
closeDate string, postalCode string,
header struct<analysisUrl: string, jobName: string, appearDate: string, custUrl: string,
  custName: string, hrBehaviorPR: string>,
contact struct<email: string>,
welfare struct<welfare: string>,
jobDetail struct<jobDescription: string, salary: string, salaryMin: int, salaryMax: int,
  salaryType: int, jobType: int, addressRegion: string, addressArea: string,
  addressDetail: string, landmark: string, longitude: string, latitude: string,
  remoteWork: struct<type: int, description: string>, vacationPolicy: string,
  businessTrip: string, manageResp: string, startWorkingDay: string, needEmp: string,
  workType: array<string>,
  jobCategory: array<struct<code: string, description: string>>>,
condition struct<workExp: string, edu: string, other: string,
  skill: array<struct<code: string, description: string>>,
  specialty: array<struct<code: string, description: string>>,
  language: array<struct<code: string, language: string,
    ability: struct<listening: string, speaking: string, reading: string, writing: string>>>,
  major: array<string>, driverLicense: array<string>,
  acceptRole: struct<role: array<struct<description: string>>>,
  certificate: array<struct<description: string>>>
"""

TABLES: dict[str, Table] = {
    "company": Table(
        """cust_no string, cust_name string, cust_url string, industry_name string,
        industry_no string, employees_count int, employees_raw string,
        _silver_updated_at timestamp, _source_batch_id string, url_status string""",
        key=("cust_no",),
        required=("cust_no",),
        lengths={"cust_no": 50, "cust_name": 200, "cust_url": 500, "industry_name": 200,
                 "industry_no": 50, "employees_raw": 50, "_source_batch_id": 50,
                 "url_status": 10},
    ),
    "job": Table(
        """job_id string, cust_no string, job_name string, appear_date date,
        close_date date, job_description string, salary_raw_text string, salary_min int,
        salary_max int, salary_type_code int, is_salary_negotiable boolean,
        job_type_code int, work_exp_requirement string, edu_requirement string,
        postal_code string, address_region string, address_area string,
        address_detail string, landmark string, longitude decimal(10,6),
        latitude decimal(10,6), remote_work_status string, remote_work_description string,
        vacation_policy_text string, business_trip_text string, manage_resp_text string,
        start_working_day_text string, need_emp_count_text string,
        hr_behavior_pr decimal(5,4), contact_email string, welfare_description string,
        analysis_url string, updated_at timestamp, source_batch_id string,
        url_status string""",
        key=("job_id",),
        required=("job_id", "cust_no"),
        lengths={"job_id": 50, "cust_no": 50, "job_name": 300, "salary_raw_text": 200,
                 "work_exp_requirement": 100, "edu_requirement": 100, "postal_code": 10,
                 "address_region": 100, "address_area": 100, "address_detail": 200,
                 "landmark": 200, "remote_work_status": 20, "remote_work_description": 500,
                 "vacation_policy_text": 200, "business_trip_text": 200,
                 "manage_resp_text": 200, "start_working_day_text": 100,
                 "need_emp_count_text": 50, "contact_email": 200, "analysis_url": 500,
                 "source_batch_id": 50, "url_status": 10},
        refs={"cust_no": ("company", "cust_no")},
    ),
    "job_category": Table(
        "job_id string, category_code string, category_description string, seq_no int",
        key=("job_id", "category_code"),
        required=("job_id", "category_code"),
        lengths={"job_id": 50, "category_code": 50, "category_description": 200},
        refs={"job_id": ("job", "job_id")},
    ),
    "job_skill": Table(
        "job_id string, skill_code string, skill_description string",
        key=("job_id", "skill_code"),
        required=("job_id", "skill_code"),
        lengths={"job_id": 50, "skill_code": 50, "skill_description": 200},
        refs={"job_id": ("job", "job_id")},
    ),
    "job_specialty": Table(
        "job_id string, specialty_code string, specialty_name string",
        key=("job_id", "specialty_code"),
        required=("job_id", "specialty_code"),
        lengths={"job_id": 50, "specialty_code": 50, "specialty_name": 200},
        refs={"job_id": ("job", "job_id")},
    ),
    "bridge_job_language": Table(
        """job_id string, language_code string, language_name string,
        listening_level string, speaking_level string, reading_level string,
        writing_level string""",
        key=("job_id", "language_code"),
        required=("job_id", "language_code"),
        lengths={"job_id": 50, "language_code": 50, "language_name": 50,
                 "listening_level": 20, "speaking_level": 20, "reading_level": 20,
                 "writing_level": 20},
        refs={"job_id": ("job", "job_id")},
    ),
    "job_requirement": Table(
        "job_id string, requirement_type string, requirement_value string",
        key=("job_id", "requirement_type", "requirement_value"),
        required=("job_id", "requirement_type", "requirement_value"),
        lengths={"job_id": 50, "requirement_type": 50, "requirement_value": 200},
        refs={"job_id": ("job", "job_id")},
    ),
    "dim_skill_option": Table(
        """skill_code string, std_skill_name string, raw_skill_name string,
        skill_category string, source_type string""",
        key=("skill_code",),
        required=("skill_code", "raw_skill_name", "source_type"),
        lengths={"skill_code": 50, "std_skill_name": 100, "raw_skill_name": 100,
                 "skill_category": 50, "source_type": 20},
    ),
    "ref_skill_synonym_map": Table(
        """raw_skill_name string, std_skill_name string, skill_category string,
        create_time timestamp, update_time timestamp""",
        key=("raw_skill_name",),
        required=("raw_skill_name", "create_time", "update_time"),
        lengths={"raw_skill_name": 100, "std_skill_name": 100, "skill_category": 50},
    ),
    "fact_category_skill_weight": Table(
        """category_code string, category_name string, std_skill_name string,
        weight decimal(7,4), is_core_skill boolean""",
        key=("category_code", "std_skill_name"),
        required=("category_code", "category_name", "std_skill_name", "weight",
                  "is_core_skill"),
        lengths={"category_code": 50, "category_name": 100, "std_skill_name": 100},
    ),
    "fact_job_ratio": Table(
        """category_code string, category_name string, job_count bigint,
        category_job_ratio decimal(7,4), category_desc string""",
        key=("category_code",),
        required=("category_code", "category_name", "job_count", "category_job_ratio"),
        lengths={"category_code": 50, "category_name": 100, "category_desc": 255},
    ),
    "fact_category_salary_stat": Table(
        """stat_id bigint, category_code string, category_name string,
        salary_type_code string, region_group string, exp_level string, job_count bigint,
        avg_salary_min decimal(10,2), avg_salary_max decimal(10,2),
        avg_salary_mid decimal(10,2), median_salary decimal(10,2)""",
        key=("category_code", "salary_type_code", "region_group", "exp_level"),
        required=("category_code", "salary_type_code", "region_group", "exp_level",
                  "job_count"),
        lengths={"category_code": 50, "category_name": 100, "salary_type_code": 20,
                 "region_group": 20, "exp_level": 50},
    ),
    "fact_job_cards": Table(
        """job_id string, region_group string, salary_type_code string, job_title string,
        company_name string, industry_name string, location_text string,
        salary_text string, exp_edu_text string, work_mode string, skills_json string,
        job_desc_short string, job_url string""",
        key=("job_id",),
        required=("job_id", "region_group", "salary_type_code", "job_title",
                  "company_name", "job_url"),
        lengths={"job_id": 50, "region_group": 20, "salary_type_code": 20,
                 "job_title": 150, "company_name": 150, "industry_name": 100,
                 "location_text": 100, "salary_text": 100, "exp_edu_text": 100,
                 "work_mode": 255, "job_desc_short": 255, "job_url": 500},
    ),
    "bridge_job_category": Table(
        "job_id string, category_code string, category_name string",
        key=("job_id", "category_code"),
        required=("job_id", "category_code", "category_name"),
        lengths={"job_id": 50, "category_code": 50, "category_name": 50},
    ),
}

# --- End of fixed values. ---


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the declared columns in order and type.

    A missing column is added as NULL, an extra one is dropped, a value that does not fit
    its type becomes NULL.
    """
    columns = []
    for item in TABLES[table].schema:
        if item.name in df.columns:
            columns.append(F.col(item.name).try_cast(item.dataType).alias(item.name))
        else:
            columns.append(F.lit(None).cast(item.dataType).alias(item.name))
    return df.select(*columns)


def declared_report(table: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of every constraint declared for ``table``; ``tables`` holds the parents."""
    spec = TABLES[table]
    return constraint_report(
        tables[table],
        key=spec.key,
        not_null=spec.required,
        max_length=spec.lengths,
        foreign={
            c: (tables[parent], parent_key)
            for c, (parent, parent_key) in spec.refs.items()
            if parent in tables
        },
    )


def judged(df: DataFrame, table: str) -> DataFrame:
    """``df`` as :func:`conform` has it, with ``reasons`` and ``raw``.

    ``reasons`` lists, in column order, ``type:c`` where a value does not fit the declared type,
    ``null:c`` where a required value is missing and ``length:c`` where a text is too long; it
    is empty for an acceptable row. ``raw`` is the incoming row as JSON if there is a reason.
    """
    spec = TABLES[table]
    columns, reasons = [], []
    for item in spec.schema:
        given = F.col(item.name) if item.name in df.columns else F.lit(None)
        value = given.try_cast(item.dataType)
        columns.append(value.alias(item.name))
        unfit = given.isNotNull() & value.isNull()
        found = F.when(unfit, F.lit(f"type:{item.name}"))
        if item.name in spec.required:
            found = found.when(given.isNull(), F.lit(f"null:{item.name}"))
        if item.name in spec.lengths:
            over = F.length(value) > spec.lengths[item.name]
            found = found.when(over, F.lit(f"length:{item.name}"))
        reasons.append(found)
    why = F.array_compact(F.array(*reasons))
    raw = F.when(F.size(why) > 0, F.to_json(F.struct(*df.columns)))
    return df.select(*columns, why.alias("reasons"), raw.alias("raw"))


def land(df: DataFrame, table: str, path: str) -> None:
    """Write ``df`` in one pass: acceptable rows under ``accepted=true``, the others with their
    reasons and raw text under ``accepted=false``. Nothing is lost or emptied silently."""
    marked = judged(df, table).withColumn("accepted", F.size("reasons") == 0)
    marked.write.partitionBy("accepted").parquet(path)


def landed(spark: SparkSession, table: str, path: str, accepted: bool = True) -> DataFrame:
    """The accepted rows of :func:`land` in their declared types, or the rejected ones with
    ``reasons`` and ``raw``."""
    columns = TABLES[table].schema
    schema = T.StructType(
        [
            *columns.fields,
            T.StructField("reasons", T.ArrayType(T.StringType())),
            T.StructField("raw", T.StringType()),
            T.StructField("accepted", T.BooleanType()),
        ]
    )
    rows = spark.read.schema(schema).parquet(path).where(F.col("accepted") == accepted)
    return rows.select(*columns.names) if accepted else rows.drop("accepted")
