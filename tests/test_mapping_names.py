"""Mapping results meet stored names and options regardless of case and accents."""

import datetime as dt

from pyspark.sql import functions as F

from jobmart.plans import gold

NAMES = "raw_skill_name string, std_skill_name string, skill_category string"
OPTIONS = "skill_code string, " + NAMES


def test_names_in_other_case_are_the_same_name(spark):
    then, now = (F.lit(dt.datetime(2023 + i, 1, 1)) for i in range(2))
    base = spark.createDataFrame([("PYTHON", None, None), ("Café", "Old", "Old")], NAMES)
    stored = base.withColumns({"create_time": then, "update_time": then})
    results = spark.createDataFrame(
        [("python", "B", "b"), ("Python", "A", "a"), ("cafe", "Coffee", "c"), ("new", "N", "n")],
        NAMES,
    )
    merged = gold.merge_mapping(stored, results, now)
    assert merged.columns == stored.columns
    assert sorted(tuple(r)[:3] for r in merged.collect()) == sorted(
        [("PYTHON", "A", "a"), ("Café", "Coffee", "c"), ("new", "N", "n")]
    )
    options = spark.createDataFrame(
        [("1", "pyTHON", None, None), ("2", "CAFÉ", None, None), ("3", None, "x", "y")], OPTIONS
    )
    mapped = {r["skill_code"]: r["std_skill_name"] for r in gold.map_options(options, results).collect()}
    assert mapped == {"1": "A", "2": "Coffee", "3": "x"}
    # entries that a map already holds twice do not double an option
    twice = base.unionByName(results)
    applied = gold.apply_synonyms(options, twice).collect()
    assert sorted(r["skill_code"] for r in applied) == ["1", "2", "3"]
    assert all(r["std_skill_name"] for r in applied if r["skill_code"] == "1")
