"""Reference names found in free text.

A name counts as found when it occurs in a text, ignoring case, with no ASCII letter or digit
directly before or after it, or when it is listed among the structured names of the row.

Trying every name on every text would cost texts x names. Instead each name is filed under
one anchor: of its runs of ASCII letters and digits the one that the fewest texts hold. By the
boundary rule such a run can only occur in a text as a whole word, so an equi join of the
distinct words of a text with the anchors yields every candidate, and a word that many names
share is joined only for names that have no rarer one. Names that are a single word need no
further check; the others are verified with the exact pattern. Names without any letter or
digit are filed under their first two characters instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmart.functions.text import contains_word_pattern, fold
from jobmart.shared import materialize

_WORD = "[a-z0-9]+"
_SYMBOL_PAIR = "(?s)(?=([^a-z0-9]{2}))"
_SYMBOL = "(?s)[^a-z0-9]"


def reference_list(items: DataFrame, code: str, name: str, newest: Sequence[Column]) -> DataFrame:
    """One name per code (the newest given one) with the pattern that finds it in text."""
    chosen = (
        items.where(F.col(code).isNotNull() & (F.col(code) != ""))
        .groupBy(F.col(code).alias("code"))
        .agg(F.max_by(F.col(name), F.struct(*newest, F.col(name))).alias("name"))
        .where(F.col("name").isNotNull() & (F.col("name") != ""))
    )
    return chosen.withColumn("pattern", contains_word_pattern(F.col("name")))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def _choices(names: DataFrame) -> DataFrame:
    """The names with all words that may be their anchor, and whether they need a check."""
    folded = fold(F.col("name"))
    words = F.array_distinct(_words(folded))
    first = F.array(F.substring(folded, 1, 2))
    return names.select(
        "code",
        "name",
        F.explode(F.when(F.size(words) > 0, words).otherwise(first)).alias("anchor"),
        (~folded.rlike(f"^{_WORD}$")).alias("verify"),
    )


def rarest_anchors(choices: DataFrame, held: DataFrame) -> DataFrame:
    """One row per name of ``choices``: of its anchors the one with the fewest rows in ``held``,
    then the longest, then the first by text order."""
    counted = held.groupBy("anchor").agg(F.count("*").alias("df"))
    rank = F.struct(F.coalesce("df", F.lit(0)), -F.length("anchor"), "anchor")
    return (
        choices.join(counted, "anchor", "left")
        .groupBy("code", "name", "verify")
        .agg(F.min(rank).alias("_rarest"))
        .select("code", "name", F.col("_rarest.anchor").alias("anchor"), "verify")
    )


def _anchors_of(text: Column, symbol_names: bool) -> Column:
    found = _words(text)
    if symbol_names:
        pairs = F.regexp_extract_all(text, F.lit(_SYMBOL_PAIR), F.lit(1))
        singles = F.regexp_extract_all(text, F.lit(_SYMBOL), F.lit(0))
        found = F.concat(found, F.array_distinct(pairs), F.array_distinct(singles))
    return F.array_distinct(found)


def match_terms(
    docs: DataFrame,
    names: DataFrame,
    doc_key: Sequence[str],
    text_cols: Sequence[str],
    listed: str | None = None,
) -> DataFrame:
    """Distinct ``(doc_key, code, name)`` of all names found in the rows of ``docs``.

    ``names`` comes from :func:`reference_list`. ``listed`` names an array column with the
    structured names of a row. A NULL text holds no name; a NULL in the key is kept as it is. The
    words of the texts that names have are stored in the shared folder when this is called.
    Texts are searched for symbols only if some name has no letter or digit, which ``names`` is
    asked first: no caller has to promise it.
    """
    columns = [F.col(c) for c in text_cols]
    texts = columns[0] if len(columns) == 1 else F.concat_ws("\n", *columns)
    choices = _choices(names)
    symbol_names = not choices.where(~F.col("anchor").rlike(f"^{_WORD}$")).isEmpty()
    # Texts are cut into words here only. Of their words those that names have are stored; both
    # the counts and the candidates come from this table.
    held = docs.select(
        *doc_key, F.explode(_anchors_of(fold(texts), symbol_names)).alias("anchor")
    ).join(choices.select("anchor").distinct(), "anchor", "left_semi")
    held = materialize(held, "words-of-names")
    filed = rarest_anchors(choices, held)
    # Candidates are gathered per row (at most one per name), and both uses below read the same
    # shuffle, so a text is folded once more for the check, however many names it holds.
    candidate = F.struct("code", "name", "verify")
    hits = (
        held.join(filed, "anchor")
        .groupBy(*doc_key)
        .agg(F.collect_list(candidate).alias("_names"))
    )
    sure = hits.select(
        *doc_key, F.explode(F.filter("_names", lambda n: ~n["verify"])).alias("_name")
    )
    other_key = [f"_{c}" for c in doc_key]
    unsure = hits.select(
        *[F.col(c).alias(o) for c, o in zip(doc_key, other_key, strict=True)],
        F.filter("_names", lambda n: n["verify"]).alias("_names"),
    )
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(doc_key, other_key, strict=True)]
    folded = docs.select(*doc_key, *text_cols, fold(texts).alias("_folded"))
    tried = folded.join(unsure.where(F.size("_names") > 0), same).select(
        *doc_key, *text_cols, "_folded", F.explode("_names").alias("_name")
    )
    # a plain substring test goes before the exact pattern
    name = F.col("_name.name")
    found = F.lit(False)
    for column in columns:
        hit = F.rlike(column, contains_word_pattern(name))
        found = found | F.coalesce(hit, F.lit(False))
    verified = tried.where(F.contains(F.col("_folded"), fold(name)) & found)
    kept = [*doc_key, "_name.code", "_name.name"]
    out = sure.select(kept).unionByName(verified.select(kept))
    if listed is not None:
        rows = docs.select(*doc_key, F.explode(F.array_distinct(F.col(listed))).alias("name"))
        by_name = rows.join(names.select("code", "name"), "name")
        out = out.unionByName(by_name.select(*doc_key, "code", "name"))
    return out.distinct()
