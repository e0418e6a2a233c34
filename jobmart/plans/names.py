"""One table of names, which decides for every plan what the same name is.

Names compare without case and accents. Each has one spelling that is shown and a number that
lasts over loads; plans join it once and group by the number or the shown spelling, so that two
spellings of a name never become two menu entries, weights or catalogue rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmart.functions.text import is_blank, same_name
from jobmart.operators.latest import latest_rows
from jobmart.operators.numbering import number_rows
from jobmart.plans import gold, serve


def name_dimension(
    columns: Sequence[tuple[DataFrame, str]], stored: DataFrame | None = None
) -> DataFrame:
    """``(name_id, name, spellings)`` of all non-blank names in the given columns.

    ``name`` is the spelling used most, the smallest of equals. Names of ``stored``, an earlier
    dimension, keep their id and spelling; new ones continue after the largest id in the order
    of their spelling. Occurrences are counted before anything is sorted.
    """
    rows = [df.select(F.col(c).alias("spelling")) for df, c in columns]
    given = reduce(DataFrame.unionByName, rows).where(~is_blank(F.col("spelling")))
    counted = given.groupBy("spelling").agg(F.count(F.lit(1)).alias("n"))
    names = counted.groupBy(same_name(F.col("spelling")).alias("_key")).agg(
        F.min_by("spelling", F.struct(-F.col("n"), F.col("spelling"))).alias("name"),
        F.count(F.lit(1)).alias("spellings"),
    )
    if stored is None:
        return number_rows(names.select("name", "spellings"), ["name"], "name_id").select(
            "name_id", "name", "spellings"
        )
    old = stored.select("name_id", F.col("name").alias("_old"), same_name(F.col("name")).alias("_key"))
    joined = names.join(old, "_key", "full_outer").select(
        "name_id", F.coalesce("_old", "name").alias("name"),
        F.coalesce("spellings", F.lit(0)).cast("long").alias("spellings"),
    )
    last = stored.agg(F.coalesce(F.max("name_id"), F.lit(0))).first()[0]
    fresh = joined.where("name_id IS NULL").select("name", "spellings")
    numbered = number_rows(fresh, ["name"], "name_id", start=last + 1)
    kept = joined.where("name_id IS NOT NULL")
    return kept.unionByName(numbered.select("name_id", "name", "spellings"))


def shown(df: DataFrame, column: str, dimension: DataFrame) -> DataFrame:
    """``df`` with the shown spelling in ``column`` and ``name_id``; a name the dimension does
    not hold, or a blank one, stays as it is with a NULL id."""
    names = dimension.select(
        F.col("name").alias("_name"), "name_id", same_name(F.col("name")).alias("_key")
    )
    joined = df.withColumn("_key", same_name(F.col(column))).join(names, "_key", "left")
    return joined.withColumn(column, F.coalesce("_name", column)).drop("_key", "_name")


def skill_menu(options: DataFrame, dimension: DataFrame) -> DataFrame:
    """The skill menu with each name once under its heading."""
    return serve.skill_menu(shown(options, "std_skill_name", dimension))


def synonym_catalog(synonyms: DataFrame, dimension: DataFrame) -> DataFrame:
    """One row per standard name: the category given most often, the smallest of equals."""
    named = shown(synonyms, "std_skill_name", dimension).where(
        "std_skill_name != '' AND skill_category != ''"
    )
    counted = named.groupBy("std_skill_name", "skill_category").agg(
        F.count(F.lit(1)).alias("entries")
    )
    order = [F.desc("entries"), F.asc("skill_category")]
    return latest_rows(counted, ["std_skill_name"], order).select(
        "std_skill_name", "skill_category", "entries"
    )


def category_skill_weight(
    job_category: DataFrame,
    job_skill: DataFrame,
    job_specialty: DataFrame,
    options: DataFrame,
    dimension: DataFrame,
) -> DataFrame:
    """Weights with one row per (category code, standard name): names by the dimension, and for
    a code with several descriptions the smallest."""
    labels = job_category.groupBy("category_code").agg(
        F.min("category_description").alias("category_description")
    )
    one_each = job_category.select("job_id", "category_code").join(labels, "category_code")
    named = shown(options, "std_skill_name", dimension)
    return gold.category_skill_weight(one_each, job_skill, job_specialty, named)


def merge_descriptions(
    stored: DataFrame, results: DataFrame, newest_first: Sequence[Column]
) -> DataFrame:
    """Set descriptions by category name, compared without case and accents; of several results
    of a name the first by ``newest_first`` counts. NULL names and descriptions change nothing."""
    usable = results.where("category_name IS NOT NULL AND category_desc IS NOT NULL").withColumn(
        "_key", same_name(F.col("category_name"))
    )
    first = latest_rows(usable, ["_key"], newest_first)
    new = first.select("_key", F.col("category_desc").alias("_new"))
    joined = stored.withColumn("_key", same_name(F.col("category_name"))).join(new, "_key", "left")
    changed = joined.withColumn("category_desc", F.coalesce("_new", "category_desc"))
    return changed.select(*stored.columns)
