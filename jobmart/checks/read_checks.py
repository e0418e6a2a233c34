"""Check queries: recommendations with gaps, requested categories, deep pages, one name each."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobmart.checks.gold_checks import all_options, bridge_of, cards_of, weights_of
from jobmart.checks.registry import check
from jobmart.checks.serve_checks import _CELLS, _IN, _MODES, _SCORES, _VIEW, SELECTED
from jobmart.plans import gold, names, serve
from jobmart.shared import new_path


@check(
    "recommend_with_gaps",
    f"""WITH {_SCORES}, placed AS (SELECT category_code, std_skill_name, w, is_core_skill,
 row_number() OVER (PARTITION BY category_code ORDER BY is_core_skill DESC, w DESC,
 std_skill_name) AS place FROM weights WHERE std_skill_name NOT IN {_IN}),
 gaps AS (SELECT category_code, string_agg(std_skill_name, '|' ORDER BY place)
 FILTER (is_core_skill OR place <= 10) AS missing_skills FROM placed GROUP BY 1)
 SELECT r.*, coalesce(g.missing_skills, '') AS missing_skills
 FROM recs r LEFT JOIN gaps g ON g.category_code = r.category_code""",
    "weights ratios",
)
def recommend_with_gaps(v):
    return serve.recommend_with_gaps(weights_of(v), gold.category_ratio(v.job_category), SELECTED)


@check(
    "recommend_tier_lists",
    f"""WITH {_SCORES} SELECT stars, string_agg(category_code, '|' ORDER BY match_percent DESC,
 category_code) AS categories FROM recs GROUP BY 1""",
    "weights ratios",
)
def recommend_tier_lists(v):
    found = serve.recommend_with_gaps(weights_of(v), gold.category_ratio(v.job_category), SELECTED)
    tiers = serve.tier_lists(found)
    return tiers.withColumn("categories", F.col("categories").cast("array<string>"))


_MAP = """entries AS (SELECT category_code, region_group, exp_level, job_count,
 CASE exp_level WHEN '10年以上' THEN 'exp_10plus' WHEN '7~9年' THEN 'exp_7to9'
 WHEN '4~6年' THEN 'exp_4to6' WHEN '1~3年' THEN 'exp_1to3' ELSE 'exp_any' END AS exp,
 concat('共 ', job_count, ' 筆 ', CASE WHEN avg_salary_min > 0 AND avg_salary_max <> 0
 THEN concat('(', format('{:,}', CAST(floor(avg_salary_min) AS BIGINT)), ' ~ ',
 format('{:,}', CAST(floor(avg_salary_max) AS BIGINT)), ' 元)') WHEN mid > 0 THEN
 concat('(均價約 ', format('{:,}', CAST(floor(mid) AS BIGINT)), ' 元)')
 ELSE '(待遇面議)' END) AS entry FROM stat WHERE salary_type_code = 50)"""


@check(
    "salary_map_empty_category",
    f"""WITH {_MAP}, asked AS (SELECT unnest(['7', 'nowhere']) AS code),
 grid AS (SELECT code, unnest(['N', 'E', 'S', 'W', 'OI', 'OS']) AS region FROM asked)
 SELECT g.code AS category_code, coalesce((SELECT min(category_name) FROM ratios
 WHERE CAST(category_code AS VARCHAR) = g.code), g.code) AS category_name, g.region,
 CAST(coalesce(sum(job_count), 0) AS BIGINT) AS job_count, '元/月' AS unit, {_CELLS}
 FROM grid g LEFT JOIN entries e ON CAST(e.category_code AS VARCHAR) = g.code
 AND g.region = e.region_group GROUP BY g.code, g.region""",
    "stat ratios",
)
def salary_map_empty_category(v):
    """A category with figures and one without: six regions and a name each."""
    stat, ratios = gold.salary_stat(cards_of(v), bridge_of(v)), gold.category_ratio(v.job_category)
    some = serve.salary_map_of(stat, ratios, "50", "7")
    return some.unionByName(serve.salary_map_of(stat, ratios, "50", "nowhere"))


@check(
    "modal_salary_map_codes",
    f"""WITH counted AS (SELECT area, exp, salary, count(*) AS c FROM (SELECT
 CASE WHEN location_text = '金門縣' THEN '離島' WHEN contains(location_text, '北') THEN '北部'
 WHEN contains(location_text, '中') THEN '中部' WHEN contains(location_text, '南') THEN '南部'
 WHEN contains(location_text, '東') THEN '東部' WHEN location_text = '海外' THEN '海外' END
 AS area, CASE WHEN regexp_matches(exp_edu_text, '1年|2年|3年|4年|5年|1~5|1-5') THEN
 'exp_1to5' WHEN regexp_matches(exp_edu_text, '6年|7年|8年|9年|10年|6~10|6-10') THEN
 'exp_6to10' WHEN regexp_matches(exp_edu_text, '11年|12年|15年|10年以上') THEN 'exp_11plus'
 ELSE 'exp_any' END AS exp, salary_text AS salary FROM cards WHERE salary_type_code = 50
 AND job_id IN (SELECT job_id FROM bridge WHERE category_code IN (3, 5, 8, 13, 21)))
 WHERE area IS NOT NULL GROUP BY 1, 2, 3),
 modes AS (SELECT area, exp, sum(c) AS n, arg_min(salary, (-c, salary)) AS salary
 FROM counted GROUP BY 1, 2)
 SELECT g.area, CAST(coalesce(sum(n), 0) AS BIGINT) AS job_count, {_MODES}
 FROM (SELECT unnest(['北部', '中部', '南部', '東部', '離島', '海外']) AS area) g
 LEFT JOIN modes m ON g.area = m.area GROUP BY 1""",
    "cards bridge",
)
def modal_salary_map_codes(v):
    cards = cards_of(v).withColumn("region_group", F.col("location_text"))
    return serve.modal_salary_map(cards, "50", bridge_of(v), ["3", "5", "8", "13", "21"])


@check(
    "job_search_deep_page",
    f"SELECT {_VIEW} FROM cards WHERE salary_type_code = 50 ORDER BY job_id DESC"
    " LIMIT 20 OFFSET 180",
    "cards",
)
def job_search_deep_page(v):
    """The tenth page, from stored blocks of 64 rows: it lies in two of them."""
    path = new_path(v.spark, "search")
    found = serve.search(cards_of(v), bridge_of(v), salary_type="50")
    serve.store_search(found, path, block_rows=64)
    return serve.job_search_page(v.spark, path, page=10)


@check(
    "job_search_after",
    f"""SELECT {_VIEW} FROM cards WHERE region_group = 'N' AND job_id < (SELECT min(job_id) FROM
 (SELECT job_id FROM cards WHERE region_group = 'N' ORDER BY job_id DESC LIMIT 20))
 ORDER BY job_id DESC LIMIT 20""",
    "cards",
)
def job_search_after(v):
    found = serve.search(cards_of(v), bridge_of(v), region="N")
    first = serve.job_search_after(found)
    return serve.job_search_after(found, first.agg(F.min("job_id")).first()[0])


# every third option is written in capitals: the same names in two spellings
_MIXED = """mixed AS (SELECT skill_code, skill_category, CASE WHEN CAST(substr(skill_code, 2)
 AS BIGINT) % 3 = 0 THEN upper(std_skill_name) ELSE std_skill_name END AS std_skill_name
 FROM skill_option), spelled AS (SELECT lower(std_skill_name) AS k, std_skill_name AS name,
 count(*) AS n FROM mixed GROUP BY 1, 2),
 dim AS (SELECT k, arg_min(name, (-n, name)) AS name, count(*) AS spellings FROM spelled
 GROUP BY 1)"""


def _mixed(options):
    name = F.when(
        F.substring("skill_code", 2, 20).cast("long") % 3 == 0, F.upper("std_skill_name")
    ).otherwise(F.col("std_skill_name"))
    return options.withColumn("std_skill_name", name)


@check(
    "name_dimension",
    f"""WITH {_MIXED} SELECT row_number() OVER (ORDER BY name) AS name_id, name, spellings
 FROM dim""",
    "skill_option",
)
def name_dimension(v):
    return names.name_dimension([(_mixed(v.skill_option), "std_skill_name")])


@check(
    "skill_menu_case",
    f"""WITH {_MIXED} SELECT DISTINCT skill_category, name AS std_skill_name FROM mixed
 JOIN dim ON k = lower(std_skill_name)""",
    "skill_option",
)
def skill_menu_case(v):
    options = _mixed(v.skill_option)
    return names.skill_menu(options, names.name_dimension([(options, "std_skill_name")]))


@check(
    "synonym_catalog_case",
    f"""WITH {_MIXED}, counted AS (SELECT name AS std_skill_name, skill_category,
 count(*) AS entries FROM mixed JOIN dim ON k = lower(std_skill_name) GROUP BY 1, 2)
 SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY std_skill_name
 ORDER BY entries DESC, skill_category) = 1""",
    "skill_option",
)
def synonym_catalog_case(v):
    options = _mixed(v.skill_option)
    return names.synonym_catalog(options, names.name_dimension([(options, "std_skill_name")]))


@check(
    "weight_case",
    f"""WITH {_MIXED}, js AS (SELECT DISTINCT job_id, name FROM job_skill s JOIN mixed m
 ON m.skill_code = s.skill_code JOIN dim ON k = lower(m.std_skill_name)),
 jc AS (SELECT DISTINCT job_id, category_code FROM job_category),
 total AS (SELECT category_code, count(*) AS total, min(category_description) AS category_name
 FROM (SELECT DISTINCT job_id, category_code, category_description FROM job_category)
 GROUP BY 1),
 cnt AS (SELECT category_code, name, count(*) AS cnt FROM jc JOIN js ON js.job_id = jc.job_id
 GROUP BY 1, 2)
 SELECT c.category_code, category_name, name AS std_skill_name,
 ((cnt * 20000 + total) // (2 * total)) / 10000.0 AS weight,
 cnt * 2 >= total AS is_core_skill FROM cnt c JOIN total t ON t.category_code = c.category_code""",
    "skill_option job_skill job_category",
)
def weight_case(v):
    options = _mixed(v.skill_option).select("skill_code", "std_skill_name")
    dimension = names.name_dimension([(options, "std_skill_name")])
    none = v.job_specialty.where("false")
    return names.category_skill_weight(v.job_category, v.job_skill, none, options, dimension)


@check(
    "merge_descriptions_case",
    """SELECT p_partkey AS category_code, p_name AS category_name,
 CASE WHEN p_partkey % 4 = 0 THEN concat('about ', (SELECT max(q.p_partkey) FROM part q
 WHERE lower(q.p_name) = lower(part.p_name) AND q.p_partkey % 4 = 0))
 WHEN lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_partkey % 4 = 0)
 THEN concat('about ', (SELECT max(q.p_partkey) FROM part q
 WHERE lower(q.p_name) = lower(part.p_name) AND q.p_partkey % 4 = 0))
 ELSE 'old' END AS category_desc FROM part""",
)
def merge_descriptions_case(v):
    stored = v.raw("part").selectExpr(
        "p_partkey AS category_code", "p_name AS category_name", "'old' AS category_desc"
    )
    results = v.raw("part").where("p_partkey % 4 = 0").selectExpr(
        "upper(p_name) AS category_name", "concat('about ', p_partkey) AS category_desc",
        "p_partkey AS seq",
    )
    return names.merge_descriptions(stored, results, [F.desc("seq")])
