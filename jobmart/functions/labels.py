"""Code and label rules: regions, experience levels, salary units, star tiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: results must carry exactly these codes, labels and patterns. ---

# Address text to region code, first match wins, anything else is OS.
REGION_PATTERNS = [
    ("台北|新北|桃園|基隆|新竹|宜蘭", "N"),
    ("台中|彰化|苗栗|南投|雲林", "E"),
    ("台南|高雄|屏東|嘉義", "S"),
    ("花蓮|台東", "W"),
    ("澎湖|金門|連江|馬祖", "OI"),
]
REGION_CODES = ["N", "E", "S", "W", "OI", "OS"]

# Free region text to region code, tested in this order, anything else is N.
REGION_KEYWORDS = [
    (["離島", "澎湖", "金門", "馬祖", "連江", "綠島"], "OI"),
    (["北"], "N"),
    (["中"], "E"),
    (["南"], "S"),
    (["東"], "W"),
    (["海外", "國外"], "OS"),
]

# Area names of the earlier map, same keyword order, no match is NULL.
AREA_KEYWORDS = [
    (["離島", "澎湖", "金門", "馬祖", "連江"], "離島"),
    (["北"], "北部"),
    (["中"], "中部"),
    (["南"], "南部"),
    (["東"], "東部"),
    (["海外", "國外"], "海外"),
]
AREA_NAMES = ["北部", "中部", "南部", "東部", "離島", "海外"]

REGION_LABELS = {
    "ALL": "全部區域",
    "N": "北部",
    "E": "中部",
    "S": "南部",
    "W": "東部",
    "OI": "離島/海外",
    "OS": "其他",
}
REGION_FROM_LABEL = {
    "北部": "N",
    "北部地區": "N",
    "中部": "E",
    "中部地區": "E",
    "南部": "S",
    "南部地區": "S",
    "東部": "W",
    "東部地區": "W",
    "離島": "OI",
    "離島地區": "OI",
    "海外": "OS",
    "海外地區": "OS",
}

# Experience text to level, first match wins, anything else is 不拘.
EXPERIENCE_PATTERNS = [
    ("10年|11年|12年|13年|14年|15年|20年|10以上", "10年以上"),
    ("7年|8年|9年|7~9|7-9", "7~9年"),
    ("4年|5年|6年|4~6|4-6|5年以上", "4~6年"),
    ("1年|2年|3年|1~3|1-3", "1~3年"),
]
EXPERIENCE_ANY = "不拘"

# Experience text to the coarse level of the earlier map, first match wins.
COARSE_EXPERIENCE_PATTERNS = [
    ("1年|2年|3年|4年|5年|1~5|1-5", "exp_1to5"),
    ("6年|7年|8年|9年|10年|6~10|6-10", "exp_6to10"),
    ("11年|12年|15年|10年以上", "exp_11plus"),
]
COARSE_EXPERIENCE_COLUMNS = ["exp_any", "exp_1to5", "exp_6to10", "exp_11plus"]

# Experience level to its column in the salary map.
EXPERIENCE_COLUMN_PATTERNS = [
    ("10年", "exp_10plus"),
    ("7~9|7-9", "exp_7to9"),
    ("4~6|4-6", "exp_4to6"),
    ("1~3|1-3", "exp_1to3"),
]
EXPERIENCE_COLUMNS = ["exp_any", "exp_1to3", "exp_4to6", "exp_7to9", "exp_10plus"]

SALARY_UNITS = {
    "ALL": "",
    "10": "待遇面議",
    "20": "元/件",
    "30": "元/時",
    "40": "元/日",
    "50": "元/月",
    "60": "元/年",
    "70": "元/週",
}
SALARY_KEYWORDS = {
    "60": "年",
    "50": "月",
    "30": "時",
    "40": "日",
    "70": "週",
    "10": "面議",
    "20": "件",
}

STAR_THRESHOLDS = [(25.0, 5), (18.0, 4), (10.0, 3), (4.0, 2)]

# --- End of fixed values. ---


def first_pattern(text: Column, rules: Sequence[tuple[str, str]], default: str | None) -> Column:
    """Label of the first rule whose pattern occurs in ``text``."""
    out = None
    for pattern, label in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default))


def keyword_label(
    text: Column, rules: Sequence[tuple[Sequence[str], str]], default: str | None
) -> Column:
    """Label of the first rule with one of its keywords inside ``text``."""
    out = None
    for words, label in rules:
        hit = text.rlike("|".join(words))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default))


def region_bucket(address: Column) -> Column:
    """Region code of an address; NULL and unlisted spellings become OS."""
    return first_pattern(address, REGION_PATTERNS, "OS")


def region_normalize(text: Column) -> Column:
    """Region code of a free region text; codes pass through, NULL and unknown become N."""
    clean = F.upper(F.trim(text))
    return F.when(clean.isin(REGION_CODES), clean).otherwise(
        keyword_label(clean, REGION_KEYWORDS, "N")
    )


def area_name(text: Column) -> Column:
    return keyword_label(text, AREA_KEYWORDS, None)


def region_code(label: Column) -> Column:
    """Region code for a label or a code, in the form used by the card search."""
    clean = F.trim(label)
    return F.coalesce(label_of(clean, REGION_FROM_LABEL), F.upper(clean), F.lit("ALL"))


def exp_bucket(text: Column) -> Column:
    return first_pattern(text, EXPERIENCE_PATTERNS, EXPERIENCE_ANY)


def coarse_exp_bucket(text: Column) -> Column:
    return first_pattern(text, COARSE_EXPERIENCE_PATTERNS, "exp_any")


def exp_column(level: Column) -> Column:
    return first_pattern(level, EXPERIENCE_COLUMN_PATTERNS, "exp_any")


def label_of(code: Column, labels: Mapping[str, str], default: Column | None = None) -> Column:
    """Look ``code`` up in a fixed table; a miss gives ``default`` (NULL if not set)."""
    out = None
    for key, label in labels.items():
        hit = code == F.lit(key)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out if default is None else out.otherwise(default)


def star_tier(score: Column, thresholds: Sequence[tuple[float, int]] = STAR_THRESHOLDS) -> Column:
    """Stars for a score: the tier of the highest threshold reached, else one star."""
    out = None
    for bound, tier in thresholds:
        hit = score >= F.lit(bound).cast("decimal(10,4)")
        out = F.when(hit, tier) if out is None else out.when(hit, tier)
    return out.otherwise(1)
