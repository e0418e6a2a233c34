"""Expressions against small inline rows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from jobmart.functions import convert, labels, salary, text


def values(spark, inputs, *columns, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    out = rows.select("i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("i")
    got = [tuple(r)[1:] for r in out.collect()]
    return [g[0] if len(columns) == 1 else g for g in got]


X = lambda: F.col("x")


@pytest.mark.parametrize(
    "raw, low, high",
    [
        ("月薪50,000~70,000元", 50000, 70000),
        ("年薪1,000,000元以上", 1000000, 1000000),
        ("待遇面議(經常性薪資達4萬元或以上)", 40000, 40000),
        ("4萬~6萬", 40000, 6),
        ("待遇面議", None, None),
        ("面議, 再談~", 0, None),
        ("3萬5千", 30000, 30000),
        ("4.5萬", 45000, 45000),
        ("月薪30,000-", 30000, None),
        (None, None, None),
    ],
)
def test_salary_bounds(spark, raw, low, high):
    got = values(spark, [raw], salary.salary_min(X()), salary.salary_max(X()))[0]
    assert got == (
        None if low is None else Decimal(low),
        None if high is None else Decimal(high),
    )


def test_salary_unit_aware(spark):
    assert values(spark, ["4萬~6萬"], salary.salary_max(X(), unit_aware=True)) == [Decimal(60000)]


def test_experience(spark):
    got = values(spark, ["3年以上 | 大學", "16年", "12年", "不拘", None], labels.exp_bucket(X()))
    assert got == ["1~3年", "4~6年", "10年以上", "不拘", "不拘"]
    coarse = values(spark, ["11年", "12年以上", "不拘", "9年"], labels.coarse_exp_bucket(X()))
    # '11年' holds '1年', so the first rule already takes it
    assert coarse == ["exp_1to5", "exp_1to5", "exp_any", "exp_6to10"]


def test_regions(spark):
    places = ["新北市", "台中市", "高雄市", "花蓮縣", "金門縣", "臺北市", None]
    assert values(spark, places, labels.region_bucket(X())) == ["N", "E", "S", "W", "OI", "OS", "OS"]
    free = ["n", " oi ", "中部", "綠島", "國外", None, "??"]
    assert values(spark, free, labels.region_normalize(X())) == ["N", "OI", "E", "OI", "OS", "N", "N"]
    named = ["北部地區", "oi", None, "all"]
    assert values(spark, named, labels.region_code(X())) == ["N", "OI", "ALL", "ALL"]
    assert values(spark, ["離島", "東區", "x", None], labels.area_name(X())) == ["離島", "東部", None, None]


def test_stars(spark):
    got = values(spark, ["25", "18", "10", "4", "3.99"], labels.star_tier(X().cast("decimal(8,4)")))
    assert got == [5, 4, 3, 2, 1]


def test_segments(spark):
    links = ["https://h/job/92dx8", "https://h/job/92dx8/", "", None]
    assert values(spark, links, text.last_segment(X())) == ["92dx8", "92dx8", None, None]
    assert values(spark, links, text.last_segment(X(), trim=False)) == ["92dx8", None, None, None]
    urls = ["//h/job/92dx8?from=list", "https://h/job/a1/#top", "https://h", "not a url"]
    assert values(spark, urls, text.url_path_id(X()))[:3] == ["92dx8", "a1", None]


def test_first_int(spark):
    got = values(spark, ["250人", "1,200人", "暫不提供", None, "99999999999"], text.first_int(X()))
    assert got == [250, 1, None, None, None]


def test_conversions(spark):
    assert values(spark, ["12", " 7 ", "x", "", None], convert.to_int(X())) == [12, 7, None, None, None]
    assert values(spark, ["1.5", "x", ""], convert.to_double(X())) == [1.5, None, None]
    days = ["2024-02-29", "2024/1/5", "2024-02-30", "", None, "2024-01-05 10:00", "20240105"]
    want = [dt.date(2024, 2, 29), dt.date(2024, 1, 5), None, None, None, None, None]
    assert values(spark, days, convert.to_day(X())) == want
    compact = ["20260902", "20261345", "2026-09", None]
    micros = values(spark, compact, F.unix_seconds(convert.compact_day(X(), "Asia/Taipei")))
    assert micros == [1788278400, None, None, None]


def test_blank_rules(spark):
    assert values(spark, ["", None, " ", "a"], text.is_blank(X())) == [True, True, True, False]
    assert values(spark, ["", None, " ", "a"], text.or_default(X(), "d")) == ["d", "d", " ", "a"]


def test_same_name_ignores_case_and_accents(spark):
    rows = spark.createDataFrame([("Python",), ("python",), ("Pythön",), ("Java",)], "x string")
    assert rows.groupBy(text.same_name(X())).count().count() == 2


def test_ratio_rounds_half_up(spark):
    rows = spark.createDataFrame([(1, 20000), (1, 3), (2, 3)], "a long, b long")
    got = [r[0] for r in rows.select(convert.ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [Decimal("0.0001"), Decimal("0.3333"), Decimal("0.6667")]


def test_fold_agrees_with_case_insensitive_regex(spark):
    import re

    # two letters are newer than the Unicode tables of the JVM's regex engine
    newer = "\u1c89\u2c2f"
    letters = [c for c in map(chr, range(0x80, 0x3000)) if not re.match(r"\s", c) and c not in newer]
    rows = spark.createDataFrame([(c,) for c in letters], "x string")
    # every letter must be found in its folded form by the regex engine
    pattern = F.concat(F.lit("(?iu)^\\Q"), X(), F.lit("\\E$"))
    bad = rows.where(~F.rlike(text.fold(X()), pattern)).collect()
    assert bad == []
