"""Gold tables out of the silver ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmart.functions.convert import ratio
from jobmart.functions.labels import exp_bucket, region_bucket
from jobmart.functions.salary import MONEY, salary_max, salary_min
from jobmart.functions.text import is_blank, same_name
from jobmart.operators.latest import latest_rows
from jobmart.operators.merge import insert_ignore, keyed_update, upsert, zero_then_merge
from jobmart.operators.numbering import allocate_ids
from jobmart.operators.sequence import with_group
from jobmart.operators.statistics import exact_medians
from jobmart.shared import materialize

# --- Fixed values: thresholds, texts and category names of the gold tables. ---
CORE_SHARE = "0.5000"
BUSY_JOBS = 100_000
PAIRS_PER_TASK = 200_000
WORK_MODE_UNKNOWN = "公司未提供此資訊"
CARD_TEXT_LENGTH = 80
SKILL_NAME_LENGTH = 15
SKILL_CATEGORIES = [
    "行政與後勤支援",
    "專案與流程管理",
    "ESG與永續發展",
    "財務與會計審計",
    "行銷與品牌營運",
    "產品設計與營運",
    "數據分析與商業情報",
    "業務銷售與客戶服務",
    "軟體工程與系統開發",
    "程式語言與開發工具",
    "Web與前端開發技術",
    "人工智慧與前沿技術",
    "資料庫與數據工程",
    "雲端架構與DevOps",
    "系統與維運管理",
    "網路與資訊安全",
    "電子與硬體工程",
    "生產品管與自動化",
    "視覺設計與多媒體",
    "工業與建築設計",
    "企業管理軟體 (ERP/CRM)",
    "辦公室軟體與工具",
    "通訊與電信工程",
    "生化與醫療衛生",
]
# --- End of fixed values. ---


# Skill options and synonyms


def skill_union(job_skill: DataFrame, job_specialty: DataFrame) -> DataFrame:
    """Distinct skills and distinct specialties, tagged with where they come from."""
    skills = job_skill.select(
        "skill_code", F.col("skill_description").alias("raw_skill_name")
    ).distinct()
    specialties = job_specialty.select(
        F.col("specialty_code").alias("skill_code"),
        F.col("specialty_name").alias("raw_skill_name"),
    ).distinct()
    return skills.withColumn("source_type", F.lit("skill")).unionByName(
        specialties.withColumn("source_type", F.lit("specialty"))
    )


def skill_options(
    job_skill: DataFrame, job_specialty: DataFrame, existing: DataFrame
) -> DataFrame:
    """Refresh raw names; standard names and categories already mapped are kept.

    When a code occurs as a skill and as a specialty, the specialty wins.
    """
    # 'specialty' sorts after 'skill', so the descending order puts it first.
    newest = [F.col("source_type").desc(), F.col("raw_skill_name").desc()]
    return upsert(
        existing,
        skill_union(job_skill, job_specialty),
        ["skill_code"],
        update_cols=["raw_skill_name", "source_type"],
        newest_first=newest,
    )


def name_union(job_skill: DataFrame, job_specialty: DataFrame) -> DataFrame:
    names = job_skill.select(F.col("skill_description").alias("raw_skill_name"))
    others = job_specialty.select(F.col("specialty_name").alias("raw_skill_name"))
    return names.unionByName(others).distinct()


def new_names(
    synonyms: DataFrame, job_skill: DataFrame, job_specialty: DataFrame, now: Column
) -> DataFrame:
    """Add raw names the map does not hold yet, compared without case and accents."""
    names = name_union(job_skill, job_specialty).where("raw_skill_name IS NOT NULL")
    # One spelling per name, the smallest, so that the choice does not depend on row order.
    one_each = names.groupBy(same_name(F.col("raw_skill_name")).alias("_same")).agg(
        F.min("raw_skill_name").alias("raw_skill_name")
    )
    known = synonyms.withColumn("_same", same_name(F.col("raw_skill_name")))
    merged = insert_ignore(
        known, one_each.withColumns({"create_time": now, "update_time": now}), ["_same"]
    )
    return merged.drop("_same")


def unmapped_names(synonyms: DataFrame) -> DataFrame:
    return (
        synonyms.where(is_blank(F.col("std_skill_name")))
        .select("raw_skill_name")
        .distinct()
        .orderBy("raw_skill_name")
    )


def synonym_catalog(synonyms: DataFrame) -> DataFrame:
    """Distinct standard names with their category, blanks dropped."""
    pairs = synonyms.select("std_skill_name", "skill_category").distinct()
    return pairs.where(
        (F.col("std_skill_name") != "") & (F.col("skill_category") != "")
    )


def _result_order() -> list[Column]:
    """Which of several results or entries of one name comes first."""
    return [
        F.col(c).asc_nulls_last() for c in ("raw_skill_name", "std_skill_name", "skill_category")
    ]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_same", same_name(F.col("raw_skill_name")))


def merge_mapping(
    synonyms: DataFrame, results: DataFrame, now: Column
) -> DataFrame:
    """Store mapping results in the synonym map; names compare without case and accents.

    A stored name keeps its spelling. Of several results of one name the first counts, by
    spelling, then by standard name and category.
    """
    stamped = _keyed(results).withColumns({"create_time": now, "update_time": now})
    merged = upsert(
        _keyed(synonyms),
        stamped,
        ["_same"],
        update_cols=["std_skill_name", "skill_category", "update_time"],
        newest_first=_result_order(),
    )
    return merged.drop("_same")


def map_options(options: DataFrame, results: DataFrame) -> DataFrame:
    """Write mapping results onto every option with that raw name, compared as in
    ``merge_mapping`` and with the same choice among results."""
    changed = keyed_update(
        _keyed(options),
        _keyed(results),
        ["_same"],
        ["std_skill_name", "skill_category"],
        newest_first=_result_order(),
    )
    return changed.drop("_same")


def apply_synonyms(options: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Standard name and category of each option from the map; NULL when it has none.

    Of several entries of one name those with a standard name come first, then the order is
    that of ``merge_mapping``.
    """
    named = _keyed(synonyms).where("_same IS NOT NULL")
    order = [is_blank(F.col("std_skill_name")).asc(), *_result_order()]
    known = latest_rows(named, ["_same"], order).select(
        "_same", "std_skill_name", "skill_category"
    )
    bare = _keyed(options.drop("std_skill_name", "skill_category"))
    return bare.join(known, "_same", "left").select(options.columns)


def mapping_quality(
    synonyms: DataFrame,
    categories: Sequence[str] = SKILL_CATEGORIES,
    max_length: int = SKILL_NAME_LENGTH,
) -> DataFrame:
    """Number of map entries that break each naming rule, and the number of entries."""
    name, category = F.col("std_skill_name"), F.col("skill_category")
    rows = synonyms.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(is_blank(name)).alias("blank_name"),
        F.count_if(~category.isin(list(categories))).alias("unlisted_category"),
        F.count_if(name == category).alias("name_is_category"),
        F.count_if(F.length(name) > max_length).alias("name_too_long"),
    )
    mapped = synonyms.where("std_skill_name IS NOT NULL AND skill_category IS NOT NULL")
    per_name = (
        mapped.select("std_skill_name", "skill_category").distinct()
        .groupBy("std_skill_name").agg(F.count(F.lit(1)).alias("n"))
    )
    split = per_name.agg(F.count_if(F.col("n") > 1).alias("n"))
    return rows.withColumn("names_with_two_categories", split.scalar())


# Category weight and share


def _category_pairs(job_category: DataFrame) -> DataFrame:
    return job_category.select(
        "job_id",
        "category_code",
        F.col("category_description").alias("category_name"),
    ).distinct()


def category_skill_weight(
    job_category: DataFrame,
    job_skill: DataFrame,
    job_specialty: DataFrame,
    options: DataFrame,
    busy_jobs: int = BUSY_JOBS,
) -> DataFrame:
    """Share of the jobs of a category that ask for a standard skill.

    Both sides of the large join are distinct per job, so each (job, category, skill) comes once
    and a plain count gives the distinct jobs. The skills of a job travel to its categories as one
    array, and everything after that shuffle is partitioned by the category: counts, totals, and
    what callers group by it. Categories with more than ``busy_jobs`` jobs are counted before
    the shuffle, from which they send one row per skill and task instead of one per job. A
    category code with several names keeps one denominator per name.

    The distinct (job, category) pairs are stored in the shared folder when this is called. Their
    number sets the number of partitions, so that a task counts the skills of about
    ``PAIRS_PER_TASK`` of them, however large the tables are.
    """
    spark = job_category.sparkSession
    pairs = materialize(_category_pairs(job_category), "category-pairs")
    tasks = pairs.count() // PAIRS_PER_TASK
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    skills = job_skill.select("job_id", "skill_code").unionByName(
        job_specialty.select("job_id", F.col("specialty_code").alias("skill_code"))
    )
    named = options.where("std_skill_name IS NOT NULL").select("skill_code", "std_skill_name")
    job_std = (
        skills.join(named, "skill_code")
        .groupBy("job_id")
        .agg(F.collect_set("std_skill_name").alias("_skills"))
    )
    category = ["category_code", "category_name"]
    totals = pairs.groupBy(*category).agg(F.count(F.lit(1)).alias("total_jobs"))
    # at most one row per busy_jobs rows of pairs, so it can be sent to every task
    busy = F.broadcast(
        totals.groupBy("category_code").agg(F.sum("total_jobs").alias("_n"))
        .where(F.col("_n") > busy_jobs)
        .select("category_code")
    )

    def asked(some_pairs: DataFrame) -> DataFrame:
        return some_pairs.join(job_std, "job_id").select(*category, "_skills")

    calm = asked(pairs.join(busy, "category_code", "left_anti"))
    counted = (
        asked(pairs.join(busy, "category_code"))
        .select(*category, F.explode("_skills").alias("_skill"))
        .groupBy(*category, "_skill")
        .agg(F.count(F.lit(1)).alias("_jobs"))
    )
    per_skill = (
        calm.withColumn("_jobs", F.lit(1).cast("long"))
        .unionByName(counted.select(*category, F.array("_skill").alias("_skills"), "_jobs"))
        .repartition(*([tasks] if tasks > usual else []), "category_code")
        .select(*category, F.explode("_skills").alias("std_skill_name"), "_jobs")
        .groupBy(*category, "std_skill_name")
        .agg(F.sum("_jobs").alias("skill_jobs"))
    )
    joined = per_skill.join(totals.drop("category_name"), "category_code")
    share = F.col("skill_jobs").cast("decimal(18,0)") / F.col("total_jobs").cast("decimal(18,0)")
    return joined.select(
        "category_code",
        "category_name",
        "std_skill_name",
        ratio(F.col("skill_jobs"), F.col("total_jobs")).alias("weight"),
        (share >= F.lit(CORE_SHARE).cast("decimal(5,4)")).alias("is_core_skill"),
    )


def category_ratio(job_category: DataFrame, job: DataFrame | None = None) -> DataFrame:
    """Distinct jobs per category and their share of all jobs that have a category.

    With ``job`` only postings whose status is on are counted, above and below the line.
    """
    pairs = _category_pairs(job_category)
    if job is not None:
        active = job.where("url_status = 'on'").select("job_id")
        pairs = pairs.join(active, "job_id", "left_semi")
    total = pairs.agg(F.count_distinct("job_id"))
    counts = pairs.groupBy("category_code", "category_name").agg(
        F.count(F.lit(1)).alias("job_count")
    )
    return counts.select(
        "category_code",
        "category_name",
        "job_count",
        ratio(F.col("job_count"), total.scalar()).alias("category_job_ratio"),
    )


def refresh_ratio(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Zero the stored shares, merge the fresh ones, keep the descriptions."""
    return zero_then_merge(
        stored, fresh, ["category_code"], ["job_count", "category_job_ratio"]
    )


def missing_descriptions(stored: DataFrame) -> DataFrame:
    return stored.where(is_blank(F.col("category_desc"))).select("category_name")


def merge_descriptions(stored: DataFrame, results: DataFrame) -> DataFrame:
    return keyed_update(stored, results, ["category_name"], ["category_desc"])


# Job cards, category bridge, salary statistics


def job_skill_names(job_skill: DataFrame, job_specialty: DataFrame) -> DataFrame:
    return job_skill.select(
        "job_id", F.col("skill_description").alias("skill_name")
    ).unionByName(job_specialty.select("job_id", F.col("specialty_name").alias("skill_name")))


def skills_array(job_skill: DataFrame, job_specialty: DataFrame) -> DataFrame:
    """Sorted skill names per job, duplicates and NULL names included.

    The array of one job is bounded by the keys of the inputs: one entry per (job, code).
    """
    names = job_skill_names(job_skill, job_specialty)
    wrapped = F.sort_array(F.collect_list(F.struct("skill_name")))
    return names.groupBy("job_id").agg(wrapped["skill_name"].alias("skills"))


def job_cards(
    job: DataFrame,
    company: DataFrame,
    job_skill: DataFrame,
    job_specialty: DataFrame,
    url_prefix: str,
) -> DataFrame:
    """One denormalised card per posting that is on and whose company is known."""
    active = job.where("url_status = 'on'")
    skills = skills_array(job_skill, job_specialty)
    joined = active.join(company, "cust_no").join(skills, "job_id", "left")
    return joined.select(
        "job_id",
        region_bucket(F.col("address_region")).alias("region_group"),
        "salary_type_code",
        F.col("job_name").alias("job_title"),
        F.col("cust_name").alias("company_name"),
        "industry_name",
        F.col("address_region").alias("location_text"),
        F.col("salary_raw_text").alias("salary_text"),
        F.concat("work_exp_requirement", F.lit(" | "), "edu_requirement").alias("exp_edu_text"),
        F.coalesce("remote_work_description", F.lit(WORK_MODE_UNKNOWN)).alias("work_mode"),
        F.to_json(F.coalesce("skills", F.array().cast("array<string>"))).alias("skills_json"),
        F.left("job_description", F.lit(CARD_TEXT_LENGTH)).alias("job_desc_short"),
        F.concat(F.lit(url_prefix), "job_id").alias("job_url"),
    )


def bridge_category(job_category: DataFrame, job: DataFrame) -> DataFrame:
    active = job.where("url_status = 'on'").select("job_id")
    return job_category.join(active, "job_id", "left_semi").select(
        "job_id", "category_code", F.col("category_description").alias("category_name")
    )


def uncategorised_cards(cards: DataFrame, bridge: DataFrame) -> DataFrame:
    """Cards the salary statistics leave out because no category is known for them."""
    return cards.join(bridge.select("job_id"), "job_id", "left_anti")


def salary_stat(
    cards: DataFrame, bridge: DataFrame, unit_aware: bool = False, with_median: bool = False
) -> DataFrame:
    """Salary figures per category, salary type, region and experience level.

    ``avg_salary_min`` is the smallest lower bound, ``avg_salary_max`` the greatest upper
    bound and ``median_salary`` repeats the mean midpoint, as the stored table has it.
    ``with_median`` adds ``true_median`` of the midpoints. Both inputs are unique by their
    declared key.
    """
    parsed = cards.select(
        "job_id",
        "salary_type_code",
        "region_group",
        exp_bucket(F.col("exp_edu_text")).alias("exp_level"),
        salary_min(F.col("salary_text")).alias("sal_min"),
        salary_max(F.col("salary_text"), unit_aware).alias("sal_max"),
    )
    group = ["category_code", "salary_type_code", "region_group", "exp_level"]
    # Cards are keyed by job and the bridge by (job, category), so a joined row already is one
    # job of one category: nothing has to be grouped by job, and a job or category that owns
    # much of the rows meets only a splittable join and a partially aggregated count.
    per_job = parsed.join(bridge.select("job_id", "category_code", "category_name"), "job_id")
    both = F.col("sal_min") + F.col("sal_max")
    mid = (
        F.sum(both).cast("decimal(28,6)") / (F.count(both) * 2).cast("decimal(20,0)")
    )
    money = "decimal(18,2)"
    figures = [
        F.coalesce(F.max("category_name"), F.first("category_code").cast("string")).alias(
            "category_name"
        ),
        F.count(F.lit(1)).alias("job_count"),
        F.round(F.min("sal_min"), 2).cast(money).alias("avg_salary_min"),
        F.round(F.max("sal_max"), 2).cast(money).alias("avg_salary_max"),
        F.round(mid, 2).cast(money).alias("avg_salary_mid"),
        F.round(mid, 2).cast(money).alias("median_salary"),
    ]
    if with_median:
        figures.append(F.median(both / 2).alias("true_median"))
    return per_job.groupBy(*group).agg(*figures)


def salary_medians(cards: DataFrame, bridge: DataFrame, unit_aware: bool = False) -> DataFrame:
    """The exact median of the salary midpoints per group of :func:`salary_stat`, for groups of
    any size; NULL where no card of the group states both bounds."""
    parsed = cards.select(
        "job_id", "salary_type_code", "region_group",
        exp_bucket(F.col("exp_edu_text")).alias("exp_level"),
        ((salary_min(F.col("salary_text")) + salary_max(F.col("salary_text"), unit_aware)) / 2)
        .cast("double").alias("_mid"),
    )
    joined = parsed.join(bridge.select("job_id", "category_code"), "job_id")
    group = ["category_code", "salary_type_code", "region_group", "exp_level"]
    return exact_medians(joined, group, "_mid", "true_median")


def salary_stat_table(stat: DataFrame, stored: DataFrame) -> DataFrame:
    """New content of the stored salary table: the groups of ``stat`` with their lasting
    ``stat_id``. A group that is stored already keeps its id, a new one continues after the
    largest, and groups without postings leave the table, as a truncate and reload has it."""
    key = ["category_code", "salary_type_code", "region_group", "exp_level"]
    ids = allocate_ids(stored.select(*key, "stat_id"), stat, key, "stat_id")
    named = with_group(stat, ids, key, "inner")
    return named.select("stat_id", *stat.columns)
