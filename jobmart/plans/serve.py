"""Read queries over the gold tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmart.functions.labels import (
    AREA_NAMES,
    COARSE_EXPERIENCE_COLUMNS,
    EXPERIENCE_COLUMNS,
    REGION_CODES,
    REGION_FROM_LABEL,
    SALARY_KEYWORDS,
    SALARY_UNITS,
    STAR_THRESHOLDS,
    area_name,
    coarse_exp_bucket,
    exp_column,
    region_normalize,
    star_tier,
)
from jobmart.functions.text import or_default
from jobmart.operators.latest import latest_rows
from jobmart.operators.nested import parse_json_array
from jobmart.operators.paging import (
    BLOCK_ROWS,
    equals_unless_all,
    page_of,
    page_total,
    read_page,
    store_pages,
    where_all,
)

# --- Fixed values: texts and sizes of the read side. ---
OTHER_SKILLS = "其他技能"
NO_DATA = "尚無資料"
NEGOTIABLE = "(待遇面議)"
FREE_SALARY = "面議"
GAP_SKILLS = 10
PAGE_SIZE = 20
TOP_JOBS = 100
CARD_DEFAULTS = {
    "industry_name": "未提供產業",
    "location_text": "未提供地點",
    "salary_text": "面議",
    "exp_edu_text": "不限",
    "work_mode": "公司未提供此資訊",
    "job_desc_short": "無詳細說明",
}
# --- End of fixed values. ---


def skill_menu(options: DataFrame) -> DataFrame:
    """Distinct menu entries; options without category go under the default heading."""
    category = F.coalesce("skill_category", F.lit(OTHER_SKILLS)).alias("skill_category")
    return options.select(category, "std_skill_name").distinct().orderBy(
        "skill_category", "std_skill_name"
    )


def skill_menu_lists(options: DataFrame) -> DataFrame:
    """The menu with one sorted list per heading; a list holds each option name once."""
    return skill_menu(options).groupBy("skill_category").agg(
        F.sort_array(F.collect_list("std_skill_name")).alias("skills")
    )


def _is_selected(selected: Sequence[str] | DataFrame, weights: DataFrame) -> DataFrame:
    """Add ``hit``: whether the skill is among the selected ones."""
    if isinstance(selected, DataFrame):
        chosen = selected.select("std_skill_name").distinct().withColumn("_hit", F.lit(True))
        return weights.join(chosen, "std_skill_name", "left").withColumn(
            "hit", F.col("_hit").isNotNull()
        ).drop("_hit")
    return weights.withColumn("hit", F.col("std_skill_name").isin(list(selected)))


def recommend(
    weights: DataFrame,
    ratios: DataFrame,
    selected: Sequence[str] | DataFrame,
    thresholds: Sequence[tuple[float, int]] = STAR_THRESHOLDS,
) -> DataFrame:
    """Categories matching the selected skills, with match percent, score and stars.

    The match is the selected share of the category's total weight; categories without a
    match are left out. The score is match percent x category share x 100.
    """
    flagged = _is_selected(selected, weights)
    zero = F.lit(0).cast("decimal(7,4)")
    sums = flagged.groupBy("category_code").agg(
        F.sum("weight").cast("decimal(14,4)").alias("total"),
        F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(zero))
        .cast("decimal(14,4)")
        .alias("matched"),
        F.sort_array(F.collect_list(F.when(F.col("hit"), F.col("std_skill_name")))).alias(
            "matched_skills"
        ),
    )
    share = F.col("matched").cast("decimal(20,4)") / F.col("total")
    scored = sums.where("total > 0").select(
        "category_code", "matched_skills", (share * 100).alias("percent"), "total", "matched"
    )
    scored = scored.where(F.col("percent") > F.lit("0.0001").cast("decimal(5,4)"))
    info = ratios.select(
        "category_code",
        "category_name",
        "category_job_ratio",
        *[c for c in ["category_desc"] if c in ratios.columns],
    )
    joined = scored.join(info, "category_code", "left")
    weight_of_category = F.coalesce(F.col("category_job_ratio"), zero)
    # matched * ratio first, so that the division is the only rounding step
    score = (
        (F.col("matched") * weight_of_category * 10000).cast("decimal(24,8)") / F.col("total")
    )
    out = joined.select(
        "category_code",
        F.coalesce("category_name", F.col("category_code").cast("string")).alias(
            "category_name"
        ),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ["category_desc"] if c in ratios.columns],
        F.round("percent", 2).cast("decimal(7,2)").alias("match_percent"),
        F.round(score, 2).cast("decimal(12,2)").alias("score"),
        "matched_skills",
        star_tier(score, thresholds).alias("stars"),
    )
    return out


def ranked(recommended: DataFrame) -> DataFrame:
    return recommended.orderBy(F.col("match_percent").desc(), "category_code")


def recommend_tiers(recommended: DataFrame) -> DataFrame:
    """Number of categories and the match range of each star tier that occurs."""
    return recommended.groupBy("stars").agg(
        F.count(F.lit(1)).alias("categories"),
        F.max("match_percent").alias("best_match"),
        F.min("match_percent").alias("least_match"),
    )


def gap_skills(
    weights: DataFrame, selected: Sequence[str] | DataFrame, wanted: int = GAP_SKILLS
) -> DataFrame:
    """Skills to add per category: every missing core skill, then the heaviest others until
    there are ``wanted``.

    The ranking window passes at most ``wanted`` rows per category; core skills need no
    window.
    """
    missing = _is_selected(selected, weights).where(~F.col("hit")).drop("hit")
    core = missing.where("is_core_skill")
    cores = core.groupBy("category_code").agg(F.count(F.lit(1)).alias("_cores"))
    window = Window.partitionBy("category_code").orderBy(
        F.col("weight").desc(), "std_skill_name"
    )
    others = (
        missing.where(~F.col("is_core_skill"))
        .withColumn("_rank", F.row_number().over(window))
        .where(F.col("_rank") <= wanted)
    )
    room = F.greatest(F.lit(0), F.lit(wanted) - F.coalesce("_cores", F.lit(0)))
    fill = others.join(cores, "category_code", "left").where(F.col("_rank") <= room)
    columns = ["category_code", "std_skill_name", "weight", "is_core_skill"]
    return core.select(columns).unionByName(fill.select(columns))


def recommend_with_gaps(
    weights: DataFrame,
    ratios: DataFrame,
    selected: Sequence[str] | DataFrame,
    wanted: int = GAP_SKILLS,
    thresholds: Sequence[tuple[float, int]] = STAR_THRESHOLDS,
) -> DataFrame:
    """:func:`recommend` with ``missing_skills`` of each recommended category: all missing core
    skills, then the heaviest others until there are ``wanted``.

    The weights are read once and shuffled once by category: the rank among the others and the
    sums of a category come from the same partitioning. A category holds at most one row for
    each standard skill, and its lists no more than its core skills and ``wanted`` others. Of
    several names of a code in ``ratios`` the smallest counts.
    """
    flagged = _is_selected(selected, weights)
    # others first, so that their rank is their row number
    other = ~F.col("hit") & ~F.col("is_core_skill")
    order = Window.partitionBy("category_code").orderBy(
        other.desc(), F.col("weight").desc(), "std_skill_name"
    )
    placed = flagged.withColumn("_rank", F.when(other, F.row_number().over(order)))
    entry = F.struct(-F.col("weight"), "std_skill_name")
    zero = F.lit(0).cast("decimal(7,4)")
    gathered = placed.groupBy("category_code").agg(
        F.sum("weight").cast("decimal(14,4)").alias("total"),
        F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(zero))
        .cast("decimal(14,4)")
        .alias("matched"),
        F.collect_list(F.when(F.col("hit"), F.col("std_skill_name"))).alias("_have"),
        F.collect_list(F.when(~F.col("hit") & F.col("is_core_skill"), entry)).alias("_core"),
        F.collect_list(F.when(F.col("_rank") <= wanted, entry)).alias("_other"),
    )

    def names(entries: Column) -> Column:
        return F.transform(F.sort_array(entries), lambda e: e["std_skill_name"])

    room = F.greatest(F.lit(0), F.lit(wanted) - F.size("_core"))
    missing = F.concat(names(F.col("_core")), F.slice(names(F.col("_other")), F.lit(1), room))
    percent = F.col("matched").cast("decimal(20,4)") / F.col("total") * 100
    matching = gathered.where("total > 0").where(percent > F.lit("0.0001").cast("decimal(5,4)"))
    info = latest_rows(
        ratios.select("category_code", "category_name", "category_job_ratio"),
        ["category_code"],
        [F.asc_nulls_last("category_name"), F.desc_nulls_last("category_job_ratio")],
    )
    share = F.coalesce(F.col("category_job_ratio"), zero)
    score = (F.col("matched") * share * 10000).cast("decimal(24,8)") / F.col("total")
    return matching.join(info, "category_code", "left").select(
        "category_code",
        F.coalesce("category_name", F.col("category_code").cast("string")).alias("category_name"),
        F.round(percent, 2).cast("decimal(7,2)").alias("match_percent"),
        F.round(score, 2).cast("decimal(12,2)").alias("score"),
        F.sort_array("_have").alias("matched_skills"),
        missing.alias("missing_skills"),
        star_tier(score, thresholds).alias("stars"),
    )


def tier_lists(recommended: DataFrame) -> DataFrame:
    """The recommended categories of each star tier that occurs, best match first."""
    entry = F.struct(-F.col("match_percent"), "category_code")
    return recommended.groupBy("stars").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["category_code"]).alias(
            "categories"
        )
    )


def set_overlap(
    categories: DataFrame, selected: Sequence[str], required: str = "required_skills"
) -> DataFrame:
    """Unweighted match: whole percent of the required skills that are selected."""
    chosen = F.array(*[F.lit(s) for s in selected])
    have = F.array_intersect(F.col(required), chosen)
    need = F.size(F.array_distinct(required))
    percent = F.when(
        need > 0, F.least(F.floor(F.size(have) * 100 / need), F.lit(100))
    ).otherwise(0)
    return categories.withColumns(
        {
            "match_score": percent.cast("int"),
            "matched_skills": F.sort_array(have),
            "missing_skills": F.sort_array(F.array_except(required, chosen)),
        }
    )


def _money(value: Column) -> Column:
    return F.format_number(F.floor(value), 0)


def salary_map(
    stat: DataFrame, salary_type: str, category_code: str | None = None
) -> DataFrame:
    """Six regions per category with job count and one salary text per experience column.

    Each category of the salary type gets all regions; ``category_code`` limits it to one.
    """
    rows = where_all(
        stat,
        [
            F.col("salary_type_code").cast("string") == salary_type,
            None
            if category_code is None
            else F.col("category_code").cast("string") == category_code,
        ],
    )
    low, high = F.col("avg_salary_min"), F.col("avg_salary_max")
    mid = F.when(F.col("avg_salary_mid") != 0, F.col("avg_salary_mid")).otherwise(
        F.col("median_salary")
    )
    text = (
        F.when(
            (low > 0) & (high != 0),
            F.concat(F.lit("("), _money(low), F.lit(" ~ "), _money(high), F.lit(" 元)")),
        )
        .when(mid > 0, F.concat(F.lit("(均價約 "), _money(mid), F.lit(" 元)")))
        .otherwise(NEGOTIABLE)
    )
    entries = rows.select(
        "category_code",
        region_normalize(F.col("region_group")).alias("region"),
        exp_column(F.col("exp_level")).alias("exp"),
        F.col("job_count").alias("n"),
        F.struct(
            "region_group",
            "exp_level",
            F.concat(F.lit("共 "), F.col("job_count").cast("string"), F.lit(" 筆 "), text)
            .alias("text"),
        ).alias("entry"),
    )
    # A cell lists the levels of one category, region and column: a handful by table key.
    cells = {
        c: F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("exp") == c, F.col("entry")))),
                lambda e: e["text"],
            ),
            " / ",
        )
        for c in EXPERIENCE_COLUMNS
    }
    found = entries.groupBy("category_code", "region").agg(
        F.sum("n").alias("n"), *[v.alias(c) for c, v in cells.items()]
    )
    grid = rows.select("category_code").distinct().select(
        "category_code", F.explode(F.array(*[F.lit(r) for r in REGION_CODES])).alias("region")
    )
    return grid.join(found, ["category_code", "region"], "left").select(
        "category_code",
        "region",
        F.coalesce("n", F.lit(0)).cast("long").alias("job_count"),
        F.lit(SALARY_UNITS.get(salary_type, "")).alias("unit"),
        *[or_default(F.col(c), NO_DATA).alias(c) for c in EXPERIENCE_COLUMNS],
    )


def salary_map_of(
    stat: DataFrame,
    ratios: DataFrame,
    salary_type: str,
    category_code: str,
    requested_name: str | None = None,
) -> DataFrame:
    """The salary map of one category: always six regions, with the category's name.

    The name is the requested one unless that is blank or the code itself, then the stored one,
    then the code. Regions, or a whole category, without figures show zero postings.
    """
    spark = stat.sparkSession
    code = category_code.strip()
    regions = [(code, r) for r in REGION_CODES]
    grid = spark.createDataFrame(regions, "category_code string, region string")
    found = salary_map(stat, salary_type, code).withColumn(
        "category_code", F.col("category_code").cast("string")
    )
    stored = ratios.where(F.col("category_code").cast("string") == code).where("category_name != ''")
    name = stored.agg(F.min("category_name"))
    if requested_name and requested_name.strip() and requested_name.strip() != code:
        shown = F.lit(requested_name)
    else:
        shown = F.coalesce(name.scalar(), F.lit(code))
    return grid.join(found, ["category_code", "region"], "left").select(
        "category_code",
        shown.alias("category_name"),
        "region",
        F.coalesce("job_count", F.lit(0)).cast("long").alias("job_count"),
        F.lit(SALARY_UNITS.get(salary_type, "")).alias("unit"),
        *[or_default(F.col(c), NO_DATA).alias(c) for c in EXPERIENCE_COLUMNS],
    )


def modal_value(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Row count and most frequent value per group, the smallest one on a tie.

    Values are counted first, so no group is held as a list.
    """
    counted = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    most_first = F.struct(-F.col("_n"), F.col(value))
    return counted.groupBy(*groups).agg(
        F.sum("_n").alias("rows"), F.min_by(value, most_first).alias(value)
    )


def modal_salary_map(
    cards: DataFrame,
    salary_type: str,
    bridge: DataFrame | None = None,
    category_codes: Sequence[str] = (),
) -> DataFrame:
    """Earlier salary map: count and usual salary text per area and coarse experience, of all
    cards or, with ``category_codes``, of those that ``bridge`` puts into one of them."""
    if category_codes and bridge is not None:
        wanted = bridge.where(F.col("category_code").cast("string").isin(list(category_codes)))
        cards = cards.join(wanted.select("job_id"), "job_id", "left_semi")
    rows = cards.where(F.col("salary_type_code").cast("string") == salary_type).select(
        area_name(F.col("region_group")).alias("area"),
        coarse_exp_bucket(F.col("exp_edu_text")).alias("exp"),
        or_default(F.trim("salary_text"), FREE_SALARY).alias("salary"),
    )
    modes = modal_value(rows.where("area IS NOT NULL"), ["area", "exp"], "salary")
    cell = F.concat(
        F.lit("共 "), F.col("rows").cast("string"), F.lit(" 筆（行情："), "salary", F.lit("）")
    )
    pivoted = (
        modes.withColumn("cell", cell)
        .groupBy("area")
        .agg(
            F.sum("rows").alias("job_count"),
            *[
                F.coalesce(F.max(F.when(F.col("exp") == c, F.col("cell"))), F.lit(NO_DATA))
                .alias(c)
                for c in COARSE_EXPERIENCE_COLUMNS
            ],
        )
    )
    spark = cards.sparkSession
    grid = spark.createDataFrame([(a,) for a in AREA_NAMES], "area string")
    return grid.join(pivoted, "area", "left").select(
        "area",
        F.coalesce("job_count", F.lit(0)).cast("long").alias("job_count"),
        *[F.coalesce(c, F.lit(NO_DATA)).alias(c) for c in COARSE_EXPERIENCE_COLUMNS],
    )


def category_label(bridge: DataFrame) -> DataFrame:
    """One non-blank name per category code, the smallest for repeatability."""
    named = bridge.where(F.col("category_name") != "")
    return named.groupBy("category_code").agg(F.min("category_name").alias("category_name"))


def search(
    cards: DataFrame,
    bridge: DataFrame,
    category_code: str | None = None,
    region: str | None = "ALL",
    salary_type: str | None = None,
) -> DataFrame:
    """Cards passing the filters that are set.

    The category filter is a semi join: a card appears once however often it is bridged.
    """
    found = where_all(
        cards,
        [
            equals_unless_all("region_group", region),
            None
            if not salary_type
            else F.col("salary_type_code").cast("string") == str(salary_type),
        ],
    )
    if category_code:
        wanted = bridge.where(F.col("category_code").cast("string") == str(category_code))
        found = found.join(wanted.select("job_id"), "job_id", "left_semi")
    return found


def card_view(cards: DataFrame) -> DataFrame:
    """Cards as shown: default texts for blank fields, skills as an array."""
    shown = [
        or_default(F.col(c), CARD_DEFAULTS[c]).alias(c) if c in CARD_DEFAULTS else F.col(c)
        for c in cards.columns
        if c != "skills_json"
    ]
    return cards.select(*shown, parse_json_array(F.col("skills_json")).alias("skills"))


def job_search(found: DataFrame, page: int = 1, per_page: int = PAGE_SIZE) -> DataFrame:
    """One page of the found cards, newest id first."""
    return card_view(page_of(found, [F.col("job_id").desc()], page, per_page))


def job_search_after(
    found: DataFrame, last_id: object | None = None, per_page: int = PAGE_SIZE
) -> DataFrame:
    """The page after the card ``last_id``, newest id first; the first page without it. No
    earlier page is read or held, however deep the page is."""
    rest = found if last_id is None else found.where(F.col("job_id") < F.lit(last_id))
    return card_view(rest.orderBy(F.col("job_id").desc()).limit(per_page))


def store_search(found: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Store the found cards in their order, for pages of any depth."""
    store_pages(card_view(found), [F.col("job_id").desc()], path, block_rows)


def job_search_page(
    spark: SparkSession, path: str, page: int = 1, per_page: int = PAGE_SIZE
) -> DataFrame:
    """One page of a stored search."""
    return read_page(spark, path, page, per_page).drop("row_no")


def job_count(found: DataFrame, per_page: int = PAGE_SIZE) -> DataFrame:
    return page_total(found, "job_id", per_page)


def like_or_code(cards: DataFrame, salary_type: str) -> DataFrame:
    """Cards of a salary type by code, or by its keyword inside the salary text."""
    by_code = F.col("salary_type_code").cast("string") == salary_type
    word = SALARY_KEYWORDS.get(salary_type)
    return cards.where(by_code if word is None else by_code | F.col("salary_text").contains(word))


def topk_jobs(cards: DataFrame, n: int = TOP_JOBS) -> DataFrame:
    return card_view(cards.orderBy(F.col("job_id").desc()).limit(n))


def search_loose(
    cards: DataFrame,
    bridge: DataFrame,
    category_code: str | None = None,
    region: str | None = "ALL",
    salary_type: str | None = None,
) -> DataFrame:
    """Earlier search: the region may be given and stored as a label or as a code, and the
    salary type also matches by its keyword. Shown with :func:`topk_jobs`."""
    label = (region or "ALL").strip()
    code = REGION_FROM_LABEL.get(label, label.upper())
    found = search(cards, bridge, category_code)
    if code != "ALL":
        found = found.where(F.col("region_group").isin(code, label))
    if salary_type and salary_type.strip().upper() != "ALL":
        found = like_or_code(found, salary_type.strip())
    return found


def in_code_group(
    df: DataFrame, column: str, group: str, groups: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Rows whose code belongs to the named group; an unknown group is taken as a code."""
    return df.where(F.col(column).cast("string").isin(list(groups.get(group.upper(), [group]))))
