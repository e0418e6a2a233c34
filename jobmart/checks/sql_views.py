"""The job-market views as SQL for the checking engine."""

from __future__ import annotations

from collections.abc import Sequence

from jobmart.sources.adapters import COMPANY, JOB, SKILL_OPTION

_WHOLE = "CAST(floor(o_totalprice) AS BIGINT)"
_JOB = [
    c.format(
        price="format('{:,}', " + _WHOLE + ")",
        price_high="format('{:,}', " + _WHOLE + " + 20000)",
    )
    for c in JOB
]

REGION_CASE = """CASE WHEN regexp_matches({0}, '台北|新北|桃園|基隆|新竹|宜蘭') THEN 'N'
 WHEN regexp_matches({0}, '台中|彰化|苗栗|南投|雲林') THEN 'E'
 WHEN regexp_matches({0}, '台南|高雄|屏東|嘉義') THEN 'S'
 WHEN regexp_matches({0}, '花蓮|台東') THEN 'W'
 WHEN regexp_matches({0}, '澎湖|金門|連江|馬祖') THEN 'OI' ELSE 'OS' END"""

EXP_CASE = """CASE WHEN regexp_matches({0}, '10年|11年|12年|13年|14年|15年|20年|10以上')
 THEN '10年以上' WHEN regexp_matches({0}, '7年|8年|9年|7~9|7-9') THEN '7~9年'
 WHEN regexp_matches({0}, '4年|5年|6年|4~6|4-6|5年以上') THEN '4~6年'
 WHEN regexp_matches({0}, '1年|2年|3年|1~3|1-3') THEN '1~3年' ELSE '不拘' END"""

_NTH = """CASE WHEN len(regexp_extract_all({0}, '[0-9,]+')) >= {1} THEN
 coalesce(TRY_CAST(replace(regexp_extract_all({0}, '[0-9,]+')[{1}], ',', '') AS BIGINT), 0)
 END"""
_SCALED = """CAST(regexp_extract(regexp_extract({0}, '[0-9]+(.[0-9]+)?'),
 '^[0-9]+([.][0-9]+)?') AS DOUBLE) * 10000"""


def salary_sql(text: str) -> tuple[str, str]:
    """Lower and upper bound expressions for a salary text column."""
    first, second = _NTH.format(text, 1), _NTH.format(text, 2)
    scaled = _SCALED.format(text)
    low = (
        f"CASE WHEN regexp_matches({text}, '[0-9]+萬') THEN {scaled} ELSE {first} END"
    )
    high = (
        f"CASE WHEN regexp_matches({text}, '~|-') AND regexp_matches({text}, '[0-9,]+')"
        f" THEN {second} WHEN regexp_matches({text}, '[0-9]+萬') THEN {scaled}"
        f" ELSE {first} END"
    )
    return low, high


_LOW, _HIGH = salary_sql("salary_text")

VIEWS: dict[str, tuple[Sequence[str], str]] = {
    "company": ((), f"SELECT {', '.join(COMPANY)} FROM customer"),
    "job": ((), f"SELECT {', '.join(_JOB)} FROM orders"),
    "skill_option": ((), f"SELECT {', '.join(SKILL_OPTION)} FROM part"),
    "job_category": (
        (),
        "SELECT DISTINCT l_orderkey AS job_id, l_partkey AS category_code,"
        " p_name AS category_description FROM lineitem JOIN part ON l_partkey = p_partkey",
    ),
    "job_skill": (
        (),
        "SELECT DISTINCT l_orderkey AS job_id, concat('P', l_partkey) AS skill_code,"
        " p_name AS skill_description FROM lineitem JOIN part ON l_partkey = p_partkey",
    ),
    "job_specialty": (
        (),
        "SELECT DISTINCT l_orderkey AS job_id, concat('S', l_suppkey) AS specialty_code,"
        " s_name AS specialty_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    ),
    "skill_rows": (
        ("job_skill", "job_specialty"),
        "SELECT skill_code, skill_description AS raw_skill_name, 'skill' AS source_type"
        " FROM job_skill GROUP BY ALL UNION ALL SELECT specialty_code, specialty_name,"
        " 'specialty' FROM job_specialty GROUP BY ALL",
    ),
    # posting documents: one row per event, with the number k every nested value derives from
    "ev": (
        (),
        "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,"
        " strftime(ts, '%Y%m%d') AS ymd FROM events",
    ),
    "docs_on": (
        ("ev",),
        "SELECT *, concat('u', user_id) AS job_id, concat(ymd, '_', lpad(CAST("
        "hour(ts) % 3 + 1 AS VARCHAR), 3, '0')) AS batch_id FROM ev"
        " WHERE event_type <> 'error'",
    ),
    "docs_id": (("docs_on",), "SELECT * FROM docs_on WHERE k <> 13"),
    "weights": (
        ("job_category", "job_skill", "job_specialty", "skill_option"),
        """SELECT s.category_code, s.category_name, s.std_skill_name,
 (s.cnt * 20000 + t.total) // (2 * t.total) AS w, t.total, s.cnt,
 s.cnt * 2 >= t.total AS is_core_skill
 FROM (SELECT jc.category_code, jc.category_description AS category_name,
  js.std_skill_name, count(DISTINCT js.job_id) AS cnt FROM job_category jc
  JOIN (SELECT job_id, std_skill_name FROM job_skill JOIN skill_option USING (skill_code)
   UNION ALL SELECT job_id, specialty_name FROM job_specialty) js ON jc.job_id = js.job_id
  GROUP BY 1, 2, 3) s
 JOIN (SELECT category_code, count(DISTINCT job_id) AS total FROM job_category
  GROUP BY category_code, category_description) t ON s.category_code = t.category_code""",
    ),
    "ratios": (
        ("job_category",),
        """SELECT category_code, category_description AS category_name,
 count(DISTINCT job_id) AS job_count,
 (count(DISTINCT job_id) * 20000 + t.total) // (2 * t.total) AS r
 FROM job_category, (SELECT count(DISTINCT job_id) AS total FROM job_category) t
 GROUP BY 1, 2, t.total""",
    ),
    "skill_lists": (
        ("job_skill", "job_specialty"),
        "SELECT job_id, list(n ORDER BY n) AS skills FROM (SELECT job_id,"
        " skill_description AS n FROM job_skill UNION ALL SELECT job_id, specialty_name"
        " FROM job_specialty) GROUP BY 1",
    ),
    "cards": (
        ("job", "company", "skill_lists"),
        f"""SELECT j.job_id, {REGION_CASE.format("coalesce(address_region, '')")}
 AS region_group, salary_type_code, job_name AS job_title, cust_name AS company_name,
 industry_name, address_region AS location_text, salary_raw_text AS salary_text,
 work_exp_requirement || ' | ' || edu_requirement AS exp_edu_text,
 coalesce(remote_work_description, '公司未提供此資訊') AS work_mode,
 CASE WHEN skills IS NULL THEN '[]' ELSE '["' || array_to_string(skills, '","') || '"]' END
 AS skills_json, left(job_description, 80) AS job_desc_short,
 concat('https://jobs.example/job/', j.job_id) AS job_url
 FROM job j JOIN company c ON j.cust_no = c.cust_no
 LEFT JOIN skill_lists s ON j.job_id = s.job_id WHERE url_status = 'on'""",
    ),
    "bridge": (
        ("job_category", "job"),
        "SELECT c.job_id, category_code, category_description AS category_name"
        " FROM job_category c JOIN job j ON c.job_id = j.job_id WHERE url_status = 'on'",
    ),
    "parsed": (
        ("cards", "bridge"),
        f"""SELECT c.job_id, category_code, salary_type_code, region_group,
 {EXP_CASE.format("exp_edu_text")} AS exp_level, CAST({_LOW} AS DOUBLE) AS lo,
 CAST({_HIGH} AS DOUBLE) AS hi FROM cards c JOIN bridge b ON c.job_id = b.job_id""",
    ),
    "stat": (
        ("cards", "bridge"),
        f"""SELECT category_code, max(category_name) AS category_name, salary_type_code,
 region_group, exp_level, count(DISTINCT job_id) AS job_count, min(lo) AS avg_salary_min,
 max(hi) AS avg_salary_max,
 floor((sum(CAST(lo + hi AS BIGINT)) * 200 + 2 * count(lo + hi)) // (4 * count(lo + hi)))
 / 100.0 AS mid
 FROM (SELECT c.job_id, category_code, category_name, salary_type_code, region_group,
  {EXP_CASE.format("exp_edu_text")} AS exp_level, CAST({_LOW} AS DOUBLE) AS lo,
  CAST({_HIGH} AS DOUBLE) AS hi FROM cards c JOIN bridge b ON c.job_id = b.job_id)
 GROUP BY category_code, salary_type_code, region_group, exp_level""",
    ),
}


def with_views(names: Sequence[str], body: str) -> str:
    """``body`` preceded by the views it reads and the views those read."""
    ordered: list[str] = []

    def add(name: str) -> None:
        needs, _ = VIEWS[name]
        for other in needs:
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    stripped = body.lstrip()
    if stripped.upper().startswith("WITH "):
        return f"WITH {ctes}, {stripped[5:]}"
    return f"WITH {ctes} {stripped}"
