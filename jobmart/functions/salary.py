"""Salary bounds out of posting text such as ``月薪50,000~70,000元`` or ``4萬以上``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: the parse depends on exactly these patterns. ---
TEN_THOUSANDS = "[0-9]+萬"
DIGIT_GROUP = "[0-9,]+"
RANGE_MARK = "~|-"
# The separator inside the number may be any character; only the leading number counts.
LOOSE_NUMBER = "[0-9]+(.[0-9]+)?"
LEADING_NUMBER = "^[0-9]+([.][0-9]+)?"
# --- End of fixed values. ---

MONEY = "decimal(18,2)"


def _nth_number(text: Column, n: int) -> Column:
    """The n-th digit group; a group of commas alone counts as 0."""
    token = F.get(F.regexp_extract_all(text, F.lit(DIGIT_GROUP), F.lit(0)), F.lit(n - 1))
    digits = F.replace(token, F.lit(","), F.lit(""))
    return F.when(token.isNotNull(), F.coalesce(digits.try_cast(MONEY), F.lit(0).cast(MONEY)))


def _scaled(text: Column) -> Column:
    loose = F.regexp_substr(text, F.lit(LOOSE_NUMBER))
    number = F.regexp_extract(loose, LEADING_NUMBER, 0)
    return (number.try_cast("decimal(10,2)") * F.lit(10000)).cast(MONEY)


def salary_min(text: Column) -> Column:
    return F.when(text.rlike(TEN_THOUSANDS), _scaled(text)).otherwise(_nth_number(text, 1))


def salary_max(text: Column, unit_aware: bool = False) -> Column:
    """Upper bound of the text.

    A range is read before the 萬 unit, so ``4萬~6萬`` gives 6, and a range mark with a
    single number gives NULL. ``unit_aware`` scales the second number of a 萬 range.
    """
    second = _nth_number(text, 2)
    if unit_aware:
        second = F.when(text.rlike(TEN_THOUSANDS), second * 10000).otherwise(second).cast(MONEY)
    is_range = text.rlike(RANGE_MARK) & text.rlike(DIGIT_GROUP)
    return (
        F.when(is_range, second)
        .when(text.rlike(TEN_THOUSANDS), _scaled(text))
        .otherwise(_nth_number(text, 1))
    )
