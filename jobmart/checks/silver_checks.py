"""Check queries: filters, newest rows, silver tables, text matching."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobmart.checks.registry import check
from jobmart.functions.convert import (
    batch_id,
    compact_day,
    epoch_or,
    instant,
    to_day,
    to_double,
    to_int,
)
from jobmart.functions.text import first_int, last_segment, url_path_id
from jobmart.operators.latest import latest_rows, latest_values
from jobmart.operators.matching import match_terms, reference_list
from jobmart.plans import silver
from jobmart.plans.ingest import stale_rows
from jobmart.shared import materialize
from jobmart.sources.schemas import conform

NOW = dt.datetime(2024, 1, 31)
_DAY = dt.date(2024, 1, 15)


@check(
    "active_filter",
    "SELECT job_id, url_status, strftime(appear_date, '%Y-%m-%d') AS appear_date FROM job"
    " WHERE url_status = 'on'",
    "job",
)
def active_filter(v):
    return v.job.where("url_status = 'on'").select("job_id", "url_status", "appear_date")


@check(
    "pending_filter",
    "SELECT o_orderkey AS job_id, o_orderstatus AS status FROM orders"
    " WHERE o_orderstatus = 'P'",
)
def pending_filter(v):
    rows = v.raw("orders").where("o_orderstatus = 'P'")
    return rows.selectExpr("o_orderkey AS job_id", "o_orderstatus AS status")


@check(
    "ingest_window",
    "SELECT event_id, user_id, event_type FROM events WHERE"
    " ts >= TIMESTAMP '2024-01-14 23:55:00' AND ts < TIMESTAMP '2024-01-16 00:00:00'",
)
def ingest_window(v):
    rows = silver.in_window(v.raw("events"), "ts", _DAY)
    return rows.select("event_id", "user_id", "event_type")


@check(
    "stale_rows",
    "SELECT job_id, strftime(appear_date, '%Y-%m-%d') AS appear_date FROM job WHERE"
    " url_status = 'on' AND appear_date <= TIMESTAMP '1999-06-01' - INTERVAL 7 DAY"
    " AND updated_at <= TIMESTAMP '1999-06-01' - INTERVAL 3 DAY",
    "job",
)
def stale(v):
    return stale_rows(v.job, dt.datetime(1999, 6, 1)).select("job_id", "appear_date")


@check(
    "latest_snapshot",
    "SELECT user_id, event_id, event_type, value, epoch_us(ts) AS ts FROM events QUALIFY"
    " row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def latest_snapshot(v):
    rows = v.raw("events").select("user_id", "event_id", "event_type", "value", "ts")
    return latest_rows(rows, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])


@check(
    "latest_fields",
    "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value,"
    " arg_max(props, (ts, event_id)) AS props FROM events GROUP BY 1, 2",
)
def latest_fields(v):
    order = [F.col("ts"), F.col("event_id")]
    return latest_values(v.raw("events"), ["user_id", "event_type"], ["value", "props"], order)


@check(
    "silver_company",
    """SELECT cust_no, concat('Company ', substr(cust_no, 2), ' as of ', ymd) AS cust_name,
 concat('//jobs.example/company/c', substr(cust_no, 2)) AS cust_url, event_type AS
 industry_name, concat('I', k % 10) AS industry_no,
 TRY_CAST(nullif(regexp_extract(emp, '\\d+'), '') AS INTEGER) AS employees_count,
 emp AS employees_raw, epoch_us(TIMESTAMP '2024-01-31') AS _silver_updated_at,
 batch_id AS _source_batch_id
 FROM (SELECT *, concat('C', user_id % 40) AS cust_no, CASE k % 4 WHEN 0 THEN
 concat(k, '人') WHEN 1 THEN concat('1,', 200 + k, '人') WHEN 2 THEN '暫不提供' END AS emp
 FROM docs_on) QUALIFY row_number() OVER (PARTITION BY cust_no
 ORDER BY batch_id DESC, ts DESC, event_id DESC) = 1""",
    "docs_on",
)
def silver_company(v):
    return silver.silver_company(v.bronze, instant(NOW))


@check(
    "silver_job_project",
    """SELECT job_id, concat('C', user_id % 40) AS cust_no, concat('Posting ', k) AS job_name,
 CASE WHEN k % 3 < 2 THEN strftime(ts, '%Y-%m-%d') END AS appear_date,
 concat('We use Skill ', k % 30, ', c++ and 資料庫管理 every day; ', event_type)
 AS job_description, concat('月薪', 20000 + k * 100, '元') AS salary_raw_text,
 CASE WHEN k % 4 = 0 THEN 0 ELSE 20000 + k * 100 END AS salary_min,
 CASE WHEN k % 4 = 0 THEN 0 ELSE 30000 + k * 100 END AS salary_max,
 CASE k % 4 WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 50 ELSE 60 END AS salary_type_code,
 k % 4 = 0 AS is_salary_negotiable, k % 2 + 1 AS job_type_code,
 concat(k % 19, '年以上') AS work_exp_requirement, '大學' AS edu_requirement,
 CASE WHEN k % 3 = 0 THEN CAST(10000 + k AS VARCHAR) END AS postal_code,
 concat(k, '號') AS address_detail, CAST(concat('121.', 100 + k) AS DOUBLE) AS longitude,
 CASE WHEN k % 7 <> 0 THEN CAST(concat('25.', 100 + k) AS DOUBLE) END AS latitude,
 CASE WHEN k % 5 = 0 THEN 'NOT_SPECIFIED' WHEN k % 4 = 1 THEN 'ON_SITE_TYPE1'
 WHEN k % 4 = 2 THEN 'HYBRID_TYPE2' ELSE 'NOT_SPECIFIED' END AS remote_work_status,
 CASE WHEN k % 5 <> 0 AND k % 3 <> 0 THEN concat('remote ', k % 4) END
 AS remote_work_description, concat(k % 5 + 1, '人') AS need_emp_count_text,
 CASE WHEN k % 2 = 0 THEN CAST(concat('0.', 10 + k % 90) AS DOUBLE) END AS hr_behavior_pr,
 CASE WHEN k % 2 = 0 THEN concat('hr', k, '@jobs.example') END AS contact_email,
 concat('welfare ', k) AS welfare_description,
 CASE WHEN k % 5 = 0 THEN concat('https://jobs.example/job/u', user_id, '/')
 ELSE concat('https://jobs.example/job/u', user_id) END AS analysis_url,
 epoch_us(TIMESTAMP '2024-01-31') AS updated_at, batch_id AS source_batch_id,
 'on' AS url_status
 FROM docs_id QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, batch_id DESC,
 event_id DESC) = 1""",
    "docs_id",
)
def silver_job_project(v):
    constant = ["close_date", "address_region", "address_area", "landmark",
                "vacation_policy_text", "business_trip_text", "manage_resp_text",
                "start_working_day_text"]
    return silver.silver_job(v.bronze, instant(NOW)).drop(*constant)


@check(
    "silver_job_daily",
    """SELECT job_id, concat('Posting ', k) AS job_name, batch_id AS source_batch_id
 FROM docs_id WHERE ts >= TIMESTAMP '2024-01-14 23:55:00' AND ts < TIMESTAMP '2024-01-16'
 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, batch_id DESC,
 event_id DESC) = 1""",
    "docs_id",
)
def silver_job_daily(v):
    job = silver.silver_job(v.bronze, instant(NOW), as_of=_DAY)
    return job.select("job_id", "job_name", "source_batch_id")


@check(
    "category_explode",
    """SELECT job_id, category_code, arg_max(description, o) AS category_description,
 arg_max(pos - 1, o) AS seq_no
 FROM (SELECT job_id, concat('c', c) AS category_code, concat('Cat ', c) AS description,
  CAST(list_position([k % 7, k % 5, k % 7], c) AS INTEGER) AS pos,
  (ts, batch_id, event_id) AS o
  FROM (SELECT *, unnest([k % 7, k % 5, k % 7]) AS c FROM docs_id WHERE k % 11 <> 0))
 GROUP BY 1, 2""",
    "docs_id",
)
def category_explode(v):
    return silver.silver_job_category(v.bronze)


@check(
    "language_latest",
    """SELECT job_id, language_code, arg_max(n, o) AS language_name,
 arg_max(l, o) AS listening_level,
 CASE WHEN arg_max(has_s, o) THEN arg_max(coalesce(s, ''), o) END AS speaking_level,
 arg_max(r, o) AS reading_level, arg_max(w, o) AS writing_level
 FROM (SELECT job_id, concat('l', k % 3) AS language_code, concat('Lang ', k % 3) AS n,
  concat('L', k % 4) AS l, k % 2 = 0 AS has_s, concat('S', k % 4) AS s, 'R' AS r,
  event_type AS w, (ts, batch_id, event_id, 1) AS o FROM docs_id WHERE k % 4 <> 0
  UNION ALL SELECT job_id, 'l0', 'Lang 0', 'L9', true, 'S9', 'R9', 'W9',
  (ts, batch_id, event_id, 0) FROM docs_id WHERE k % 4 <> 0)
 GROUP BY 1, 2""",
    "docs_id",
)
def language_latest(v):
    return silver.silver_language(v.bronze)


@check(
    "requirement_union",
    """SELECT DISTINCT * FROM (
 SELECT job_id, 'MAJOR' AS requirement_type, concat('M', k % 6) AS requirement_value
  FROM docs_id WHERE k % 2 = 0
 UNION ALL SELECT job_id, 'DRIVER_LICENSE', unnest(['car', concat('D', k % 3)])
  FROM docs_id WHERE k % 5 = 0
 UNION ALL SELECT job_id, 'ACCEPT_ROLE', concat('role ', k % 3) FROM docs_id
 UNION ALL SELECT job_id, 'WORK_TYPE', unnest([concat('W', k % 3), concat('W', k % 2)])
  FROM docs_id
 UNION ALL SELECT job_id, 'CERTIFICATE', concat('cert ', k % 4) FROM docs_id
  WHERE k % 3 = 0)""",
    "docs_id",
)
def requirement_union(v):
    return silver.silver_requirement(v.bronze)


@check(
    "reference_list",
    """SELECT concat('p', k % 12) AS code, arg_max(event_type, (ts, batch_id, event_id))
 AS name, concat('(?iu)(?:^|[^a-zA-Z0-9])\\Q', arg_max(event_type, (ts, batch_id, event_id)),
 '\\E(?:$|[^a-zA-Z0-9])') AS pattern
 FROM (SELECT *, concat(ymd, '_', lpad(CAST(hour(ts) % 3 + 1 AS VARCHAR), 3, '0'))
 AS batch_id FROM ev) WHERE k % 6 <> 0 GROUP BY 1""",
    "ev",
)
def reference_names(v):
    return silver.condition_references(v.bronze, "specialty")


@check(
    "merge_references",
    """SELECT coalesce(n.code, o.code) AS code, coalesce(n.name, o.name) AS name FROM
 (SELECT concat('p', s_suppkey) AS code, s_name AS name FROM supplier) o FULL JOIN
 (SELECT concat('p', k % 12) AS code, arg_max(event_type, (ts, batch_id, event_id)) AS name
  FROM (SELECT *, concat(ymd, '_', lpad(CAST(hour(ts) % 3 + 1 AS VARCHAR), 3, '0'))
  AS batch_id FROM ev) WHERE k % 6 <> 0 GROUP BY 1) n ON o.code = n.code""",
    "ev",
)
def merge_references(v):
    stored = v.raw("supplier").selectExpr("concat('p', s_suppkey) AS code", "s_name AS name")
    return silver.merge_references(stored, silver.condition_references(v.bronze, "specialty"))


@check(
    "job_skill_match",
    """SELECT DISTINCT job_id, code AS skill_code, name AS skill_description
 FROM docs_id, (SELECT DISTINCT concat('s', k % 20) AS code, concat('Skill ', k % 20) AS name
  FROM ev UNION ALL SELECT 's90', 'C++' UNION ALL SELECT 's91', '資料庫') r
 WHERE name IN (concat('Skill ', k % 20), 'C++', '資料庫')
 OR (k % 3 = 0 AND regexp_matches(concat('knows SKILL ', k % 25, '; and more'),
  '(?:^|[^a-zA-Z0-9])' || regexp_escape(name) || '(?:$|[^a-zA-Z0-9])', 'i'))
 OR regexp_matches(concat('We use Skill ', k % 30, ', c++ and 資料庫管理 every day; ',
  event_type), '(?:^|[^a-zA-Z0-9])' || regexp_escape(name) || '(?:$|[^a-zA-Z0-9])', 'i')""",
    "docs_id",
)
def job_skill_match(v):
    names = materialize(silver.condition_references(v.bronze, "skill"), "skills")
    return silver.silver_job_skill(v.bronze, names)


@check(
    "job_specialty_match",
    """SELECT DISTINCT job_id, code AS specialty_code, name AS specialty_name
 FROM docs_id, (SELECT concat('p', k % 12) AS code, arg_max(event_type, (ts, batch_id,
  event_id)) AS name FROM (SELECT *, concat(ymd, '_', lpad(CAST(hour(ts) % 3 + 1 AS VARCHAR),
  3, '0')) AS batch_id FROM ev) WHERE k % 6 <> 0 GROUP BY 1) r
 WHERE event_type = name""",
    "docs_id",
)
def job_specialty_match(v):
    names = materialize(silver.condition_references(v.bronze, "specialty"), "specialties")
    return silver.silver_job_specialty(v.bronze, names)


_SENTENCES = """SELECT concat('b', item_id) AS code, trim(unnest(string_split(text, '. ')))
 AS name FROM benchmark"""


@check(
    "keyword_match",
    f"""WITH terms AS (SELECT min(code) AS code, name FROM ({_SENTENCES}
 UNION ALL SELECT concat('l-', lang), lang FROM documents
 UNION ALL SELECT concat('s-', source), source FROM documents) WHERE name <> ''
 GROUP BY name)
 SELECT DISTINCT doc_id, code, name FROM documents, terms
 WHERE name = lang OR name = source OR (contains(lower(text), lower(name)) AND
 regexp_matches(text, '(?:^|[^a-zA-Z0-9])' || regexp_escape(name) || '(?:$|[^a-zA-Z0-9])',
 'i'))""",
)
def keyword_match(v):
    """Languages, sources and benchmark sentences as names, searched in every document."""
    docs = v.raw("documents")
    sentences = v.raw("benchmark").select(
        F.concat(F.lit("b"), "item_id").alias("code"),
        F.explode(F.split("text", r"\. ")).alias("name"),
    )
    langs = docs.select(F.concat(F.lit("l-"), "lang").alias("code"), F.col("lang").alias("name"))
    sources = docs.select(
        F.concat(F.lit("s-"), "source").alias("code"), F.col("source").alias("name")
    )
    named = (
        sentences.unionByName(langs.distinct()).unionByName(sources.distinct())
        .select("code", F.trim("name").alias("name"))
        .where("name <> ''")
    )
    # several items share a sentence: one code per name, then the list keyed by name
    one_code = named.groupBy("name").agg(F.min("code").alias("code"))
    names = reference_list(
        one_code.withColumn("id", F.concat_ws("/", "code", "name")), "id", "name",
        [F.col("code")],
    ).withColumn("code", F.substring_index("code", "/", 1))
    names = materialize(names, "names")
    rows = docs.select("doc_id", "text", F.array("lang", "source").alias("listed"))
    return match_terms(rows, names, ["doc_id"], ["text"], listed="listed")


@check(
    "safe_convert",
    """SELECT event_id, TRY_CAST(props AS INTEGER) AS whole_text,
 TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
 TRY_CAST(CASE WHEN event_type = 'view' THEN 'n/a' ELSE concat('0.', user_id) END AS DOUBLE)
 AS share, CASE WHEN event_type NOT IN ('click', 'error') THEN strftime(ts, '%Y-%m-%d') END
 AS day FROM events""",
)
def safe_convert(v):
    return v.raw("events").select(
        "event_id",
        to_int(F.col("props")).alias("whole_text"),
        to_int(F.get_json_object("props", "$.k")).alias("k"),
        to_double(
            F.when(F.col("event_type") == "view", "n/a").otherwise(
                F.concat(F.lit("0."), "user_id")
            )
        ).alias("share"),
        to_day(
            F.when(F.col("event_type") == "click", "")
            .when(F.col("event_type") == "error", "no date")
            .when(F.col("event_type") == "view", F.date_format("ts", "yyyy/MM/dd"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd"))
        ).alias("day"),
    )


@check(
    "conform_schema",
    """SELECT CAST(job_id AS VARCHAR) AS job_id, CAST(cust_no AS VARCHAR) AS cust_no, job_name,
 strftime(appear_date, '%Y-%m-%d') AS appear_date, CAST(NULL AS INTEGER) AS salary_min,
 salary_type_code, CAST(NULL AS DOUBLE) AS longitude, epoch_us(updated_at) AS updated_at,
 url_status FROM job""",
    "job",
)
def conform_schema(v):
    return conform(v.job, "job").select(
        "job_id", "cust_no", "job_name", "appear_date", "salary_min", "salary_type_code",
        "longitude", "updated_at", "url_status",
    )


@check(
    "last_segment",
    """SELECT page_id, nullif(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '')
 AS segment, nullif(regexp_extract(url, '[^/]*$'), '') AS untrimmed FROM pages""",
)
def last_segments(v):
    return v.raw("pages").select(
        "page_id",
        last_segment(F.col("url")).alias("segment"),
        last_segment(F.col("url"), trim=False).alias("untrimmed"),
    )


@check(
    "url_path_id",
    """SELECT page_id, nullif(regexp_extract(regexp_replace(regexp_extract(url,
 '^[a-z]*:?//[^/?#]*([^?#]*)', 1), '/+$', ''), '[^/]*$'), '') AS path_id FROM pages""",
)
def url_path_ids(v):
    return v.raw("pages").select("page_id", url_path_id(F.col("url")).alias("path_id"))


@check(
    "first_int",
    """SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '\\d+'), '') AS INTEGER) AS n
 FROM pages""",
)
def first_ints(v):
    return v.raw("pages").select("page_id", first_int(F.col("url")).alias("n"))


@check(
    "parse_compact_date",
    """SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus <> 'P' THEN
 epoch_us(o_orderdate - INTERVAL 8 HOUR) END AS taipei, CASE WHEN o_orderstatus <> 'P' THEN
 epoch_us(o_orderdate) END AS utc, CASE WHEN o_custkey % 100 = 0 THEN
 epoch_us(TIMESTAMP '2024-01-31') ELSE (o_custkey % 100) * 86400 * 1000000 END AS replied,
 concat(strftime(o_orderdate, '%Y%m%d'), '_', lpad(CAST(o_custkey % 3 AS VARCHAR), 3, '0'))
 AS batch FROM orders""",
)
def parse_compact_date(v):
    day = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM"))
    text = day.otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return v.raw("orders").select(
        F.col("o_orderkey").alias("job_id"),
        compact_day(text, "Asia/Taipei").alias("taipei"),
        compact_day(text).alias("utc"),
        epoch_or((F.col("o_custkey") % 100) * 86400, instant(NOW)).alias("replied"),
        batch_id(F.col("o_orderdate"), F.col("o_custkey") % 3).alias("batch"),
    )
