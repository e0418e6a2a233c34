"""Arrays, nested records and JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_array(value: Column, kind: T.DataType) -> Column:
    """A field that holds one object or an array of them, as an array."""
    return value if isinstance(kind, T.ArrayType) else F.when(value.isNotNull(), F.array(value))


def unwind(df: DataFrame, array: Column, name: str) -> DataFrame:
    """One row per element; rows with a NULL or empty array go away."""
    return df.withColumn(name, F.explode(array))


def first_index(array: Column, element: Column) -> Column:
    """0-based index of the first equal element."""
    return (F.array_position(array, element) - 1).cast("int")


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value.

    The parsers stop after the first value, so trailing text goes unseen. Inside an array and
    inside an object it does not: each wrapping catches what the other would let pass.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    boxed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce(alone & boxed.isNotNull(), F.lit(False))


def parse_json_array(text: Column) -> Column:
    """Strings of a JSON array; NULL or broken text gives an empty array."""
    parsed = F.from_json(text, "array<string>")
    valid = is_json(text) & text.rlike(r"^\s*\[")
    return F.coalesce(F.when(valid, parsed), F.array().cast("array<string>"))


def json_payload(text: Column) -> Column:
    """The outermost ``[...]`` of a reply, else the reply without its code fences."""
    bracketed = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    unfenced = F.trim(F.regexp_replace(text, r"(?m)^```json|^```|```$", ""))
    return F.when(bracketed != "", bracketed).otherwise(unfenced)


def extract_records(
    df: DataFrame, text: str, record: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Rows of the JSON records inside a free-text reply; a broken reply gives no rows.

    ``record`` is the DDL of one record, for example ``struct<name:string,desc:string>``.
    """
    payload = json_payload(F.col(text))
    records = F.when(is_json(payload), F.from_json(payload, f"array<{record}>"))
    return df.select(*keep, F.inline(records))
