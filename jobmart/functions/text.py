"""Text expressions: folding, path segments, first numbers, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: letters that equal another letter when case is ignored, although
# lower-casing keeps them apart (Unicode simple case mappings). ---
_FOLD_FROM = "µıſͅςϐϑϕϖϰϱϵᲀᲁᲂᲃᲄᲅᲆᲇᲈẛ\u1fbe"
_FOLD_TO = "μisισβθφπκρεвдосттъѣꙋṡι"
# --- End of fixed values. ---
# All of them, and the letters that lower-casing treats by context, lie in here.
_FOLD_RANGE = "[µ\u0130-\u1fff]"


def fold(text: Column) -> Column:
    """Case-folded text, letter by letter: equal exactly when case-insensitive regex
    matching takes the letters as equal."""
    special = text.rlike(_FOLD_RANGE)
    careful = F.translate(
        F.lower(F.replace(text, F.lit("İ"), F.lit("i"))), _FOLD_FROM, _FOLD_TO
    )
    return F.when(special, careful).otherwise(F.lower(text))


def same_name(name: Column) -> Column:
    """Key under which names compare equal regardless of case and accents."""
    return F.collate(name, "UNICODE_CI_AI")


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def or_default(text: Column, default: str) -> Column:
    """``default`` where the text is NULL or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def trim_slashes(url: Column) -> Column:
    return F.regexp_replace(url, "^/+|/+$", "")


def last_segment(url: Column, trim: bool = True) -> Column:
    """Last ``/`` part of a link; with ``trim`` trailing slashes do not hide it.

    NULL for NULL or blank links, so no row is keyed by an empty id.
    """
    clean = trim_slashes(url) if trim else url
    return F.nullif(F.element_at(F.split(clean, "/"), -1), F.lit(""))


def url_path_id(url: Column) -> Column:
    """Last segment of the path of a link, ignoring host, query and fragment."""
    path = F.regexp_replace(F.trim(F.try_parse_url(url, F.lit("PATH"))), "/+$", "")
    return F.nullif(F.element_at(F.split(path, "/"), -1), F.lit(""))


def first_int(text: Column) -> Column:
    """First run of digits as an int, NULL when there is none or it does not fit."""
    return F.regexp_substr(text, F.lit(r"\d+")).try_cast("int")


def contains_word_pattern(name: Column) -> Column:
    """Regex that finds ``name`` literally, ignoring case, not inside a longer ASCII word."""
    literal = F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(
        F.lit("(?iu)(?:^|[^a-zA-Z0-9])\\Q"), literal, F.lit("\\E(?:$|[^a-zA-Z0-9])")
    )
