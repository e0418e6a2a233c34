"""Check queries: the read side."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobmart.checks.gold_checks import bridge_of, cards_of, weights_of
from jobmart.checks.registry import check
from jobmart.operators.paging import fallback_if_empty
from jobmart.plans import gold, serve

SELECTED = [f"Brand#{n}" for n in range(1, 13)]
_IN = "(" + ", ".join(f"'{s}'" for s in SELECTED) + ")"
# The share of one category shrinks as the tables grow; these bounds spread larger tables
# over the tiers, where the standard ones would give one star throughout.
LOW_TIERS = [(1.5, 5), (1.0, 4), (0.75, 3), (0.5, 2)]

_SCORES = f"""scores AS (SELECT category_code, sum(w) AS tw,
 sum(CASE WHEN std_skill_name IN {_IN} THEN w ELSE 0 END) AS mw,
 list(std_skill_name ORDER BY std_skill_name) FILTER (std_skill_name IN {_IN}) AS have
 FROM weights GROUP BY 1),
 recs AS (SELECT s.category_code, r.category_name,
 CAST((mw * 20000 + tw) // (2 * tw) AS BIGINT) / 100.0 AS match_percent,
 CAST((mw * r * 200 + tw) // (2 * tw) AS BIGINT) / 100.0 AS score,
 array_to_string(have, '|') AS matched_skills,
 CAST(CASE WHEN mw * r >= 25 * tw THEN 5 WHEN mw * r >= 18 * tw THEN 4
 WHEN mw * r >= 10 * tw THEN 3 WHEN mw * r >= 4 * tw THEN 2 ELSE 1 END AS INTEGER)
 AS stars FROM scores s JOIN ratios r ON s.category_code = r.category_code
 WHERE tw > 0 AND mw > 0)"""


def recommended(v):
    return serve.recommend(weights_of(v), gold.category_ratio(v.job_category), SELECTED)


@check("recommend", f"WITH {_SCORES} SELECT * FROM recs", "weights ratios")
def recommend(v):
    return recommended(v)


@check(
    "recommend_low_tiers",
    f"""WITH {_SCORES} SELECT s.category_code, CAST(CASE WHEN mw * r * 2 >= 3 * tw THEN 5
 WHEN mw * r >= tw THEN 4 WHEN mw * r * 4 >= 3 * tw THEN 3 WHEN mw * r * 2 >= tw THEN 2
 ELSE 1 END AS INTEGER) AS stars FROM scores s JOIN ratios r
 ON s.category_code = r.category_code WHERE mw > 0""",
    "weights ratios",
)
def recommend_low_tiers(v):
    """The selection given as a table, and other star thresholds."""
    chosen = v.raw("part").where(F.col("p_brand").isin(SELECTED)).selectExpr(
        "p_brand AS std_skill_name"
    )
    found = serve.recommend(
        weights_of(v), gold.category_ratio(v.job_category), chosen, LOW_TIERS
    )
    return found.select("category_code", "stars")


@check(
    "recommend_tiers",
    f"""WITH {_SCORES} SELECT stars, count(*) AS categories, max(match_percent) AS best_match,
 min(match_percent) AS least_match FROM recs GROUP BY 1""",
    "weights ratios",
)
def recommend_tiers(v):
    return serve.recommend_tiers(recommended(v))


@check(
    "gap_skills",
    f"""SELECT category_code, std_skill_name, w / 10000.0 AS weight, is_core_skill
 FROM weights LEFT JOIN (SELECT category_code AS c, count(*) AS n FROM weights
  WHERE is_core_skill AND std_skill_name NOT IN {_IN} GROUP BY 1) ON c = category_code
 WHERE std_skill_name NOT IN {_IN} QUALIFY is_core_skill OR row_number() OVER
 (PARTITION BY category_code, is_core_skill ORDER BY w DESC, std_skill_name)
 <= greatest(0, 10 - coalesce(n, 0))""",
    "weights",
)
def gap_skills(v):
    return serve.gap_skills(weights_of(v), SELECTED)


@check(
    "set_overlap",
    f"""SELECT category_code, CAST((have * 100) // need AS INTEGER) AS match_score,
 matched_skills, missing_skills FROM (SELECT category_code, count(*) AS need,
 count(*) FILTER (std_skill_name IN {_IN}) AS have,
 coalesce(string_agg(std_skill_name, '|' ORDER BY std_skill_name)
  FILTER (std_skill_name IN {_IN}), '') AS matched_skills,
 coalesce(string_agg(std_skill_name, '|' ORDER BY std_skill_name)
  FILTER (std_skill_name NOT IN {_IN}), '') AS missing_skills FROM weights GROUP BY 1)""",
    "weights",
)
def set_overlap(v):
    needs = weights_of(v).groupBy("category_code").agg(
        F.collect_list("std_skill_name").alias("required_skills")
    )
    return serve.set_overlap(needs, SELECTED).drop("required_skills")


@check(
    "skill_menu",
    "SELECT DISTINCT coalesce(nullif(skill_category, 'PROMO'), '其他技能') AS skill_category,"
    " std_skill_name FROM skill_option",
    "skill_option",
)
def skill_menu(v):
    options = v.skill_option.withColumn(
        "skill_category", F.nullif("skill_category", F.lit("PROMO"))
    )
    return serve.skill_menu(options)


@check(
    "skill_menu_lists",
    """SELECT skill_category, string_agg(std_skill_name, '|' ORDER BY std_skill_name) AS skills
 FROM (SELECT DISTINCT skill_category, std_skill_name FROM skill_option) GROUP BY 1""",
    "skill_option",
)
def skill_menu_lists(v):
    return serve.skill_menu_lists(v.skill_option)


_CELL = """coalesce(string_agg(CASE WHEN exp = '{0}' THEN entry END, ' / '
 ORDER BY region_group, exp_level), '尚無資料') AS {0}"""
_CELLS = ", ".join(
    _CELL.format(c) for c in ["exp_any", "exp_1to3", "exp_4to6", "exp_7to9", "exp_10plus"]
)


@check(
    "salary_map",
    f"""WITH entries AS (SELECT category_code, region_group, exp_level, job_count,
 CASE exp_level WHEN '10年以上' THEN 'exp_10plus' WHEN '7~9年' THEN 'exp_7to9'
 WHEN '4~6年' THEN 'exp_4to6' WHEN '1~3年' THEN 'exp_1to3' ELSE 'exp_any' END AS exp,
 concat('共 ', job_count, ' 筆 ', CASE WHEN avg_salary_min > 0 AND avg_salary_max <> 0
 THEN concat('(', format('{{:,}}', CAST(floor(avg_salary_min) AS BIGINT)), ' ~ ',
 format('{{:,}}', CAST(floor(avg_salary_max) AS BIGINT)), ' 元)') WHEN mid > 0 THEN
 concat('(均價約 ', format('{{:,}}', CAST(floor(mid) AS BIGINT)), ' 元)')
 ELSE '(待遇面議)' END) AS entry FROM stat WHERE salary_type_code = 50)
 SELECT g.category_code, g.region, CAST(coalesce(sum(job_count), 0) AS BIGINT) AS job_count,
 '元/月' AS unit, {_CELLS}
 FROM (SELECT DISTINCT category_code, unnest(['N', 'E', 'S', 'W', 'OI', 'OS']) AS region
  FROM entries) g LEFT JOIN entries e ON g.category_code = e.category_code
 AND g.region = e.region_group GROUP BY 1, 2""",
    "stat",
)
def salary_map(v):
    return serve.salary_map(gold.salary_stat(cards_of(v), bridge_of(v)), "50")


@check(
    "modal_value",
    """SELECT o_custkey % 10 AS area, o_orderstatus AS level, sum(n) AS rows, min(o_orderpriority)
 FILTER (n = top) AS o_orderpriority FROM (SELECT o_custkey % 10 AS o_custkey, o_orderstatus,
 o_orderpriority, count(*) AS n, max(count(*)) OVER (PARTITION BY o_custkey % 10,
 o_orderstatus) AS top FROM orders GROUP BY 1, 2, 3) GROUP BY 1, 2""".replace(
        "sum(n) AS rows", "CAST(sum(n) AS BIGINT) AS rows"
    ),
)
def modal_value(v):
    rows = v.raw("orders").selectExpr(
        "o_custkey % 10 AS area", "o_orderstatus AS level", "o_orderpriority"
    )
    return serve.modal_value(rows, ["area", "level"], "o_orderpriority")


_MODE = """coalesce(max(CASE WHEN exp = '{0}' THEN concat('共 ', n, ' 筆（行情：', salary, '）')
 END), '尚無資料') AS {0}"""
_MODES = ", ".join(_MODE.format(c) for c in ["exp_any", "exp_1to5", "exp_6to10", "exp_11plus"])


@check(
    "modal_salary_map",
    f"""WITH counted AS (SELECT area, exp, salary, count(*) AS c FROM (SELECT
 CASE WHEN location_text = '金門縣' THEN '離島' WHEN contains(location_text, '北') THEN '北部'
 WHEN contains(location_text, '中') THEN '中部' WHEN contains(location_text, '南') THEN '南部'
 WHEN contains(location_text, '東') THEN '東部' WHEN location_text = '海外' THEN '海外' END
 AS area, CASE WHEN regexp_matches(exp_edu_text, '1年|2年|3年|4年|5年|1~5|1-5') THEN
 'exp_1to5' WHEN regexp_matches(exp_edu_text, '6年|7年|8年|9年|10年|6~10|6-10') THEN
 'exp_6to10' WHEN regexp_matches(exp_edu_text, '11年|12年|15年|10年以上') THEN 'exp_11plus'
 ELSE 'exp_any' END AS exp, salary_text AS salary FROM cards WHERE salary_type_code = 50)
 WHERE area IS NOT NULL GROUP BY 1, 2, 3),
 modes AS (SELECT area, exp, sum(c) AS n, arg_min(salary, (-c, salary)) AS salary
 FROM counted GROUP BY 1, 2)
 SELECT g.area, CAST(coalesce(sum(n), 0) AS BIGINT) AS job_count, {_MODES}
 FROM (SELECT unnest(['北部', '中部', '南部', '東部', '離島', '海外']) AS area) g
 LEFT JOIN modes m ON g.area = m.area GROUP BY 1""",
    "cards",
)
def modal_salary_map(v):
    cards = cards_of(v).withColumn("region_group", F.col("location_text"))
    return serve.modal_salary_map(cards, "50")


_VIEW = """job_id, region_group, salary_type_code, job_title, company_name, industry_name,
 coalesce(location_text, '未提供地點') AS location_text, salary_text, exp_edu_text, work_mode,
 job_desc_short, job_url, array_to_string(from_json(skills_json, '["VARCHAR"]'), '|')
 AS skills"""


@check(
    "job_search",
    f"""SELECT {_VIEW} FROM cards WHERE region_group = 'N' AND salary_type_code = 50
 AND job_id IN (SELECT job_id FROM bridge WHERE category_name LIKE 'red %')
 ORDER BY job_id DESC LIMIT 20 OFFSET 40""",
    "cards bridge",
)
def job_search(v):
    """Third page of a search in one region and salary type, over a group of categories."""
    found = serve.search(cards_of(v), bridge_of(v), region="N", salary_type="50")
    red = bridge_of(v).where("category_name LIKE 'red %'").select("job_id")
    return serve.job_search(found.join(red, "job_id", "left_semi"), page=3)


@check(
    "job_search_category",
    f"""SELECT {_VIEW} FROM cards WHERE job_id IN (SELECT job_id FROM bridge
 WHERE category_code = 7) ORDER BY job_id DESC LIMIT 20""",
    "cards bridge",
)
def job_search_category(v):
    found = serve.search(cards_of(v), bridge_of(v), category_code="7", region="ALL")
    return serve.job_search(found)


@check(
    "job_count",
    """SELECT count(DISTINCT job_id) AS total_count,
 CAST(greatest(1, ceil(count(DISTINCT job_id) / 20)) AS BIGINT) AS total_pages
 FROM cards WHERE region_group = 'S'""",
    "cards",
)
def job_count(v):
    return serve.job_count(serve.search(cards_of(v), bridge_of(v), region="S"))


@check(
    "topk_jobs",
    f"SELECT {_VIEW} FROM cards ORDER BY job_id DESC LIMIT 100",
    "cards",
)
def topk_jobs(v):
    return serve.topk_jobs(cards_of(v))


@check(
    "search_loose",
    f"""SELECT {_VIEW} FROM cards WHERE region_group = 'S' AND (salary_type_code = 50
 OR salary_text LIKE '%月%') ORDER BY job_id DESC LIMIT 100""",
    "cards",
)
def search_loose(v):
    found = serve.search_loose(cards_of(v), bridge_of(v), region="南部地區", salary_type="50")
    return serve.topk_jobs(found)


@check(
    "like_or_code",
    """SELECT job_id, salary_type_code, salary_text FROM cards WHERE salary_type_code = 50
 OR salary_text LIKE '%月%'""",
    "cards",
)
def like_or_code(v):
    found = serve.like_or_code(cards_of(v), "50")
    return found.select("job_id", "salary_type_code", "salary_text")


@check(
    "code_group_in",
    "SELECT job_id, salary_type_code FROM cards WHERE salary_type_code IN (50, 60)",
    "cards",
)
def code_group_in(v):
    groups = {"LONG": ["50", "60"], "SHORT": ["30", "40"]}
    found = serve.in_code_group(cards_of(v), "salary_type_code", "long", groups)
    return found.select("job_id", "salary_type_code")


@check(
    "fallback_if_empty",
    """SELECT job_id, 'none matched' AS step FROM cards UNION ALL SELECT job_id, 'some matched'
 FROM cards WHERE region_group = 'W'""",
    "cards",
)
def fallback(v):
    cards = cards_of(v).select("job_id", "region_group")
    none = fallback_if_empty(cards.where("region_group = 'nowhere'"), cards)
    some = fallback_if_empty(cards.where("region_group = 'W'"), cards)
    return none.select("job_id", F.lit("none matched").alias("step")).unionByName(
        some.select("job_id", F.lit("some matched").alias("step"))
    )


@check(
    "category_label",
    "SELECT category_code, min(category_name) AS category_name FROM bridge GROUP BY 1",
    "bridge",
)
def category_label(v):
    return serve.category_label(bridge_of(v))
