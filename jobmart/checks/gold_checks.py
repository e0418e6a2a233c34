"""Check queries: options, synonyms, weights, shares, cards, salary figures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobmart.checks.registry import check
from jobmart.checks.sql_views import EXP_CASE, REGION_CASE, salary_sql
from jobmart.functions import labels
from jobmart.functions.convert import instant
from jobmart.functions.salary import salary_max, salary_min
from jobmart.functions.text import same_name
from jobmart.operators.nested import parse_json_array
from jobmart.plans import gold
from jobmart.sources.adapters import JOB_URL

NOW = dt.datetime(2024, 1, 31)


def cards_of(v):
    return gold.job_cards(v.job, v.company, v.job_skill, v.job_specialty, JOB_URL)


def bridge_of(v):
    return gold.bridge_category(v.job_category, v.job)


def weights_of(v):
    return gold.category_skill_weight(
        v.job_category, v.job_skill, v.job_specialty, all_options(v)
    )


def all_options(v):
    """Options of skills and, under the suppliers' names, of specialties."""
    suppliers = v.raw("supplier").selectExpr(
        "concat('S', s_suppkey) AS skill_code", "s_name AS std_skill_name"
    )
    return v.skill_option.select("skill_code", "std_skill_name").unionByName(suppliers)


def synonyms_of(v):
    """A synonym map over the part names: the smallest brand and type per name, blank for
    names of two kinds."""
    names = v.raw("part").groupBy(F.col("p_name").alias("raw_skill_name")).agg(
        F.min("p_brand").alias("std_skill_name"), F.max("p_type").alias("skill_category")
    )
    blank = F.when(F.col("raw_skill_name").like("% bolt"), F.lit(None)).when(
        F.col("raw_skill_name").like("% gear"), F.lit("  ")
    )
    return names.withColumn(
        "std_skill_name",
        F.when(
            F.col("raw_skill_name").rlike(" bolt$| gear$"), blank
        ).otherwise(F.col("std_skill_name")),
    )


_SYNONYMS = """syn AS (SELECT p_name AS raw_skill_name, CASE WHEN p_name LIKE '% bolt' THEN NULL
 WHEN p_name LIKE '% gear' THEN '  ' ELSE min(p_brand) END AS std_skill_name,
 max(p_type) AS skill_category FROM part GROUP BY p_name)"""


@check("skill_union", "SELECT * FROM skill_rows", "skill_rows")
def skill_union(v):
    return gold.skill_union(v.job_skill, v.job_specialty)


@check(
    "name_union",
    "SELECT skill_description AS raw_skill_name FROM job_skill UNION SELECT specialty_name"
    " FROM job_specialty",
    "job_skill job_specialty",
)
def name_union(v):
    return gold.name_union(v.job_skill, v.job_specialty)


@check(
    "distinct_pairs",
    "SELECT DISTINCT l_orderkey AS job_id, l_suppkey AS category_code FROM lineitem",
)
def distinct_pairs(v):
    rows = v.raw("lineitem").selectExpr("l_orderkey AS job_id", "l_suppkey AS category_code")
    return rows.distinct()


@check(
    "skill_options",
    """SELECT coalesce(o.skill_code, n.skill_code) AS skill_code, o.std_skill_name,
 coalesce(n.raw_skill_name, o.raw_skill_name) AS raw_skill_name, o.skill_category,
 coalesce(n.source_type, o.source_type) AS source_type
 FROM skill_option o FULL JOIN skill_rows n ON o.skill_code = n.skill_code""",
    "skill_option skill_rows",
)
def skill_options(v):
    return gold.skill_options(v.job_skill, v.job_specialty, v.skill_option)


@check(
    "skill_options_clash",
    """SELECT coalesce(o.skill_code, n.skill_code) AS skill_code, o.std_skill_name,
 coalesce(n.name, o.raw_skill_name) AS raw_skill_name, o.skill_category,
 coalesce(n.source_type, o.source_type) AS source_type FROM skill_option o FULL JOIN
 (SELECT skill_code, max(raw_skill_name) AS name, source_type FROM (
  SELECT concat('P', l_suppkey) AS skill_code, s_name AS raw_skill_name,
  'specialty' AS source_type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  UNION SELECT skill_code, skill_description, 'skill' FROM job_skill WHERE skill_code
  NOT IN (SELECT concat('P', l_suppkey) FROM lineitem)) GROUP BY ALL) n
 ON o.skill_code = n.skill_code""",
    "skill_option job_skill",
)
def skill_options_clash(v):
    """Specialty codes that collide with skill codes: the specialty row wins."""
    clashing = v.job_specialty.withColumn(
        "specialty_code", F.concat(F.lit("P"), F.substring("specialty_code", 2, 20))
    )
    return gold.skill_options(v.job_skill, clashing, v.skill_option)


@check(
    "new_names",
    f"""WITH {_SYNONYMS} SELECT raw_skill_name, std_skill_name, skill_category FROM syn
 UNION ALL SELECT name, NULL, NULL FROM (SELECT upper(skill_description) AS name
 FROM job_skill UNION SELECT specialty_name FROM job_specialty)
 WHERE lower(name) NOT IN (SELECT lower(raw_skill_name) FROM syn)""",
    "job_skill job_specialty",
)
def new_names(v):
    """Skill names in other case are known names; supplier names are new."""
    shouted = v.job_skill.withColumn("skill_description", F.upper("skill_description"))
    known = synonyms_of(v).withColumns({"create_time": instant(NOW), "update_time": instant(NOW)})
    merged = gold.new_names(known, shouted, v.job_specialty, instant(NOW))
    return merged.drop("create_time", "update_time")


@check(
    "unmapped_names",
    f"""WITH {_SYNONYMS} SELECT raw_skill_name FROM syn WHERE std_skill_name IS NULL
 OR trim(std_skill_name) = ''""",
)
def unmapped_names(v):
    return gold.unmapped_names(synonyms_of(v))


@check(
    "synonym_catalog",
    f"""WITH {_SYNONYMS} SELECT DISTINCT std_skill_name, skill_category FROM syn
 WHERE std_skill_name <> '' AND skill_category <> ''""",
)
def synonym_catalog(v):
    return gold.synonym_catalog(synonyms_of(v))


_RESULTS = """results AS (SELECT p_name AS raw_skill_name, concat('std ', min(p_type))
 AS std_skill_name, max(p_brand) AS skill_category FROM part WHERE p_name LIKE '% bolt'
 OR p_name LIKE '% ring' GROUP BY 1 UNION ALL SELECT s_name, 'vendor', 'supply' FROM supplier)"""


def _results(v):
    parts = v.raw("part").where("p_name LIKE '% bolt' OR p_name LIKE '% ring'")
    mapped = parts.groupBy(F.col("p_name").alias("raw_skill_name")).agg(
        F.concat(F.lit("std "), F.min("p_type")).alias("std_skill_name"),
        F.max("p_brand").alias("skill_category"),
    )
    vendors = v.raw("supplier").selectExpr(
        "s_name AS raw_skill_name", "'vendor' AS std_skill_name", "'supply' AS skill_category"
    )
    return mapped.unionByName(vendors)


@check(
    "merge_mapping",
    f"""WITH {_SYNONYMS}, {_RESULTS} SELECT coalesce(s.raw_skill_name, r.raw_skill_name)
 AS raw_skill_name, CASE WHEN r.raw_skill_name IS NOT NULL THEN r.std_skill_name
 ELSE s.std_skill_name END AS std_skill_name, CASE WHEN r.raw_skill_name IS NOT NULL THEN
 r.skill_category ELSE s.skill_category END AS skill_category,
 CASE WHEN s.raw_skill_name IS NULL THEN epoch_us(TIMESTAMP '2024-01-31')
 ELSE epoch_us(TIMESTAMP '2023-01-01') END AS create_time,
 CASE WHEN r.raw_skill_name IS NOT NULL THEN epoch_us(TIMESTAMP '2024-01-31')
 ELSE epoch_us(TIMESTAMP '2023-01-01') END AS update_time
 FROM syn s FULL JOIN results r ON s.raw_skill_name = r.raw_skill_name""",
)
def merge_mapping(v):
    then = instant(dt.datetime(2023, 1, 1))
    stored = synonyms_of(v).withColumns({"create_time": then, "update_time": then})
    return gold.merge_mapping(stored, _results(v), instant(NOW))


@check(
    "map_options",
    f"""WITH {_RESULTS} SELECT skill_code, CASE WHEN r.raw_skill_name IS NOT NULL THEN
 r.std_skill_name ELSE o.std_skill_name END AS std_skill_name, o.raw_skill_name,
 CASE WHEN r.raw_skill_name IS NOT NULL THEN r.skill_category ELSE o.skill_category END
 AS skill_category, source_type FROM skill_option o LEFT JOIN results r
 ON o.raw_skill_name = r.raw_skill_name""",
    "skill_option",
)
def map_options(v):
    return gold.map_options(v.skill_option, _results(v))


@check(
    "apply_synonyms",
    f"""WITH {_RESULTS} SELECT skill_code, r.std_skill_name, o.raw_skill_name,
 r.skill_category, source_type FROM skill_option o LEFT JOIN results r
 ON lower(o.raw_skill_name) = lower(r.raw_skill_name)""",
    "skill_option",
)
def apply_synonyms(v):
    shouted = _results(v).withColumn("raw_skill_name", F.upper("raw_skill_name"))
    return gold.apply_synonyms(v.skill_option, shouted)


@check(
    "mapping_quality",
    f"""WITH {_SYNONYMS} SELECT count(*) AS entries,
 count(*) FILTER (std_skill_name IS NULL OR trim(std_skill_name) = '') AS blank_name,
 count(*) FILTER (skill_category NOT IN ('ECONOMY', 'STANDARD', 'PROMO'))
 AS unlisted_category, count(*) FILTER (std_skill_name = skill_category)
 AS name_is_category, count(*) FILTER (length(std_skill_name) > 7) AS name_too_long,
 (SELECT count(*) FROM (SELECT std_skill_name FROM syn WHERE std_skill_name IS NOT NULL AND
 skill_category IS NOT NULL GROUP BY 1 HAVING count(DISTINCT skill_category) > 1))
 AS names_with_two_categories FROM syn""",
)
def mapping_quality(v):
    return gold.mapping_quality(synonyms_of(v), ["ECONOMY", "STANDARD", "PROMO"], 7)


@check(
    "same_name_groups",
    """SELECT replace(lower(strip_accents(w)), 'ß', 'ss') AS word_key, count(*) AS spellings FROM
 (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents)
 GROUP BY 1""",
)
def same_name_groups(v):
    """Spellings of each word that count as the same name (case and accents ignored)."""
    words = v.raw("documents").select(
        F.explode(
            F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0)))
        ).alias("w")
    )
    groups = words.distinct().groupBy(same_name(F.col("w")).alias("key")).agg(
        F.count(F.lit(1)).alias("spellings"), F.min("w").alias("w")
    )
    # print the key the way the checking engine does: lower case, accents off, ss for ß
    lowered = F.replace(F.lower(F.collate("w", "UTF8_BINARY")), F.lit("ß"), F.lit("ss"))
    plain = F.translate(
        lowered, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    )
    return groups.select(plain.alias("word_key"), "spellings")


@check(
    "category_ratio",
    "SELECT category_code, category_name, job_count, r / 10000.0 AS category_job_ratio"
    " FROM ratios",
    "ratios",
)
def category_ratio(v):
    return gold.category_ratio(v.job_category)


@check(
    "category_ratio_active",
    """SELECT category_code, category_description AS category_name,
 count(DISTINCT c.job_id) AS job_count, ((count(DISTINCT c.job_id) * 20000 + t.total)
 // (2 * t.total)) / 10000.0 AS category_job_ratio FROM job_category c
 JOIN job j ON c.job_id = j.job_id AND url_status = 'on',
 (SELECT count(DISTINCT c.job_id) AS total FROM job_category c JOIN job j
  ON c.job_id = j.job_id WHERE url_status = 'on') t GROUP BY 1, 2, t.total""",
    "job_category job",
)
def category_ratio_active(v):
    return gold.category_ratio(v.job_category, v.job)


@check(
    "refresh_ratio",
    """SELECT p_partkey AS category_code, p_name AS category_name, coalesce(a.job_count, 0)
 AS job_count, coalesce(r / 10000.0, 0.0) AS category_job_ratio, concat('about ', p_type)
 AS category_desc FROM part LEFT JOIN ratios a ON p_partkey = category_code""",
    "ratios",
)
def refresh_ratio(v):
    stored = v.raw("part").selectExpr(
        "p_partkey AS category_code", "'old name' AS category_name",
        "CAST(p_size AS BIGINT) AS job_count",
        "CAST(0.5 AS DECIMAL(7,4)) AS category_job_ratio",
        "concat('about ', p_type) AS category_desc",
    )
    merged = gold.refresh_ratio(stored, gold.category_ratio(v.job_category))
    names = v.raw("part").selectExpr("p_partkey AS category_code", "p_name")
    # categories without jobs keep the stored name; show the part name for them
    shown = F.when(F.col("category_name") == "old name", F.col("p_name")).otherwise(
        F.col("category_name")
    )
    return merged.join(names, "category_code").withColumn("category_name", shown).drop("p_name")


@check(
    "missing_descriptions",
    "SELECT p_name AS category_name FROM part WHERE p_type IN ('PROMO', 'SMALL')",
)
def missing_descriptions(v):
    stored = v.raw("part").selectExpr(
        "p_name AS category_name",
        "CASE p_type WHEN 'PROMO' THEN NULL WHEN 'SMALL' THEN ' ' ELSE p_type END"
        " AS category_desc",
    )
    return gold.missing_descriptions(stored)


@check(
    "merge_descriptions",
    """SELECT p_partkey AS category_code, p_name AS category_name, coalesce(d, 'none')
 AS category_desc FROM part LEFT JOIN (SELECT p_name AS n, max(p_type) AS d FROM part
 WHERE p_size > 48 GROUP BY 1) ON p_name = n""",
)
def merge_descriptions(v):
    stored = v.raw("part").selectExpr(
        "p_partkey AS category_code", "p_name AS category_name", "'none' AS category_desc"
    )
    results = v.raw("part").where("p_size > 48").groupBy(F.col("p_name").alias("category_name"))
    return gold.merge_descriptions(stored, results.agg(F.max("p_type").alias("category_desc")))


@check(
    "category_skill_weight",
    "SELECT category_code, category_name, std_skill_name, w / 10000.0 AS weight, is_core_skill"
    " FROM weights",
    "weights",
)
def category_skill_weight(v):
    return weights_of(v)


@check(
    "category_skill_weight_types",
    """SELECT category_code, category_name, std_skill_name, ((cnt * 20000 + total)
 // (2 * total)) / 10000.0 AS weight, cnt * 2 >= total AS is_core_skill FROM
 (SELECT jc.category_code, category_name, std, count(DISTINCT jc.job_id) AS cnt,
  std AS std_skill_name FROM (SELECT DISTINCT l_orderkey AS job_id, p_type AS category_code,
   concat('all ', p_type) AS category_name FROM lineitem JOIN part ON l_partkey = p_partkey) jc
  JOIN (SELECT job_id, std_skill_name AS std FROM job_skill s JOIN skill_option o
   ON s.skill_code = o.skill_code UNION ALL SELECT job_id, specialty_name
   FROM job_specialty) js ON jc.job_id = js.job_id GROUP BY 1, 2, 3)
 JOIN (SELECT p_type AS t, count(DISTINCT l_orderkey) AS total FROM lineitem JOIN part
  ON l_partkey = p_partkey GROUP BY 1) ON t = category_code""",
    "job_skill job_specialty skill_option",
)
def category_skill_weight_types(v):
    """Six broad categories, with skills and specialties: every category is a hot key."""
    pairs = v.raw("lineitem").join(v.raw("part"), F.expr("l_partkey = p_partkey"))
    broad = pairs.selectExpr(
        "l_orderkey AS job_id", "p_type AS category_code",
        "concat('all ', p_type) AS category_description",
    )
    return gold.category_skill_weight(broad, v.job_skill, v.job_specialty, all_options(v))


@check(
    "skills_array",
    "SELECT job_id, array_to_string(skills, '|') AS skills FROM skill_lists",
    "skill_lists",
)
def skills_array(v):
    return gold.skills_array(v.job_skill, v.job_specialty)


@check(
    "parse_json_array",
    """SELECT job_id, CASE job_id % 4 WHEN 0 THEN '' WHEN 1 THEN ''
 ELSE array_to_string(skills, '|') END AS skills FROM skill_lists""",
    "skill_lists",
)
def parse_json(v):
    lists = gold.skills_array(v.job_skill, v.job_specialty)
    text = F.to_json("skills")
    broken = (
        F.when(F.col("job_id") % 4 == 0, F.concat(text, F.lit(",")))
        .when(F.col("job_id") % 4 == 1, F.lit(None))
        .otherwise(text)
    )
    return lists.select("job_id", parse_json_array(broken).alias("skills"))


@check(
    "job_cards",
    "SELECT * FROM cards",
    "cards",
)
def job_cards(v):
    return cards_of(v)


@check("bridge_category", "SELECT * FROM bridge", "bridge")
def bridge_category(v):
    return bridge_of(v)


@check(
    "uncategorised_cards",
    "SELECT job_id FROM cards WHERE job_id NOT IN (SELECT job_id FROM bridge)",
    "cards bridge",
)
def uncategorised_cards(v):
    return gold.uncategorised_cards(cards_of(v), bridge_of(v)).select("job_id")


@check(
    "region_bucket",
    f"""SELECT job_id, address_region, {REGION_CASE.format("coalesce(address_region, '')")}
 AS region_group FROM job""",
    "job",
)
def region_bucket(v):
    return v.job.select(
        "job_id", "address_region",
        labels.region_bucket(F.col("address_region")).alias("region_group"),
    )


@check(
    "region_normalize",
    """SELECT event_id, CASE k % 8 WHEN 0 THEN 'N' WHEN 1 THEN 'E' WHEN 2 THEN 'E' WHEN 3 THEN
 'OI' WHEN 4 THEN 'OS' WHEN 5 THEN 'W' WHEN 6 THEN 'N' ELSE 'N' END AS region FROM ev""",
    "ev",
)
def region_normalize(v):
    text = F.expr(
        "CASE k % 8 WHEN 0 THEN ' n' WHEN 1 THEN '中部' WHEN 2 THEN 'e ' WHEN 3 THEN '綠島'"
        " WHEN 4 THEN '國外' WHEN 5 THEN '東部地區' WHEN 6 THEN NULL ELSE '??' END"
    )
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    rows = v.raw("events").select("event_id", k).withColumn("text", text)
    return rows.select("event_id", labels.region_normalize(F.col("text")).alias("region"))


_YEARS = "concat(CAST(l_quantity AS INTEGER), '年以上 | 大學')"


@check(
    "exp_bucket",
    f"""SELECT l_orderkey, l_linenumber, l_quantity, {EXP_CASE.format(_YEARS)} AS level,
 CASE WHEN regexp_matches({_YEARS}, '1年|2年|3年|4年|5年|1~5|1-5') THEN 'exp_1to5'
 WHEN regexp_matches({_YEARS}, '6年|7年|8年|9年|10年|6~10|6-10') THEN 'exp_6to10'
 WHEN regexp_matches({_YEARS}, '11年|12年|15年|10年以上') THEN 'exp_11plus'
 ELSE 'exp_any' END AS coarse FROM lineitem""",
)
def exp_bucket(v):
    text = F.expr(_YEARS)
    return v.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        labels.exp_bucket(text).alias("level"), labels.coarse_exp_bucket(text).alias("coarse"),
    )


@check(
    "code_label",
    f"""SELECT job_id, CASE salary_type_code WHEN 10 THEN '待遇面議' WHEN 30 THEN '元/時'
 WHEN 50 THEN '元/月' WHEN 60 THEN '元/年' END AS unit, CASE {REGION_CASE.format(
     "coalesce(address_region, '')")} WHEN 'N' THEN '北部' WHEN 'E' THEN '中部' WHEN 'S' THEN
 '南部' WHEN 'W' THEN '東部' WHEN 'OI' THEN '離島/海外' ELSE '其他' END AS region_label
 FROM job""",
    "job",
)
def code_label(v):
    region = labels.region_bucket(F.col("address_region"))
    return v.job.select(
        "job_id",
        labels.label_of(
            F.col("salary_type_code").cast("string"), labels.SALARY_UNITS, F.lit("")
        ).alias("unit"),
        labels.label_of(region, labels.REGION_LABELS, F.lit("全部區域")).alias("region_label"),
    )


_LOW, _HIGH = salary_sql("salary_raw_text")


@check(
    "salary_parse",
    f"""SELECT job_id, salary_raw_text, CAST({_LOW} AS DOUBLE) AS sal_min,
 CAST({_HIGH} AS DOUBLE) AS sal_max FROM job""",
    "job",
)
def salary_parse(v):
    text = F.col("salary_raw_text")
    return v.job.select(
        "job_id", text, salary_min(text).alias("sal_min"), salary_max(text).alias("sal_max")
    )


@check(
    "salary_stat",
    """SELECT category_code, category_name, salary_type_code, region_group, exp_level,
 job_count, avg_salary_min, avg_salary_max, mid AS avg_salary_mid, mid AS median_salary
 FROM stat""",
    "stat",
)
def salary_stat(v):
    return gold.salary_stat(cards_of(v), bridge_of(v))
