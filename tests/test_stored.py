"""Stored tables, levelled loads, lasting ids, landing, cascades and order statistics."""

import datetime as dt
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from jobmart.operators import merge, numbering
from jobmart.operators.quality import cascade_delete
from jobmart.operators.statistics import exact_medians
from jobmart.plans import ingest
from jobmart.shared import new_path
from jobmart.sources import parted, schemas, versions
from jobmart.streaming import levels


def files_of(path):
    return {
        os.path.join(folder, name): os.path.getmtime(os.path.join(folder, name))
        for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")
    }


@pytest.fixture
def stored(spark):
    path = new_path(spark, "parted")
    rows = spark.createDataFrame([(i, f"n{i}", "on") for i in range(200)], "k int, name string, s string")
    parted.create(rows, path, ["k"], parts=16)
    return path


def test_untouched_parts_keep_their_files(spark, stored):
    before, folders = files_of(stored), versions.newest(spark, stored)[1]["folders"]
    change = spark.createDataFrame([(7, "seven"), (1000, "new"), (None, "no key")], "k int, name string")
    touched = parted.upsert(stored, change, update_cols=["name"])
    assert 1 <= len(touched) <= 2
    now = versions.newest(spark, stored)[1]["folders"]
    assert {p for p in folders if folders[p] != now[p]} <= {str(p) for p in touched}
    assert before.items() <= files_of(stored).items()
    got = {r["k"]: (r["name"], r["s"]) for r in parted.read(spark, stored).collect()}
    assert len(got) == 201 and got[7] == ("seven", "on") and got[1000] == ("new", None)
    assert None not in got


def test_readers_keep_their_version_and_vacuum(spark, stored):
    old = parted.read(spark, stored)
    parted.upsert(stored, spark.createDataFrame([(3, "three")], "k int, name string"))
    assert {r["name"] for r in old.where("k = 3").collect()} == {"n3"}
    everything = spark.createDataFrame([(i, "x") for i in range(200)], "k int, name string")
    parted.upsert(stored, everything)
    assert parted.vacuum(spark, stored) == 2
    assert parted.read(spark, stored).where("name = 'x'").count() == 200


def test_merge_equals_plain_merge(spark, stored):
    rng = random.Random(1)
    plain = parted.read(spark, stored)
    for _ in range(3):
        some = [(rng.randrange(300), f"v{rng.random()}", None, rng.random()) for _ in range(40)]
        source = spark.createDataFrame(some, "k int, name string, s string, at double")
        newest = [F.desc("at")]
        plain = merge.upsert(plain, source, ["k"], ["name"], newest)
        parted.upsert(stored, source, ["name"], newest)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(
        map(tuple, parted.read(spark, stored).collect()), key=repr
    )


def test_second_commit_of_a_number_fails(spark, stored):
    _, content = versions.newest(spark, stored)
    with pytest.raises(Exception, match="exist"):
        versions.commit(spark, stored, 1, content)
    assert versions.newest(spark, stored)[0] == 1


def test_merge_into_nothing(spark, stored):
    none = spark.createDataFrame([], "k int, name string")
    assert parted.upsert(stored, none) == [] and versions.newest(spark, stored)[0] == 1
    with pytest.raises(FileNotFoundError):
        parted.read(spark, new_path(spark, "missing"))


def newest():
    return [F.desc("at"), F.desc("value")]


def batch(spark, number):
    rng = random.Random(number)
    rows = [(rng.randrange(30), rng.randrange(1000), f"{number}-{i}") for i in range(20)]
    return spark.createDataFrame(rows, "k int, at int, value string")


def test_levels_bound_the_folders_of_a_read(spark):
    target, rows = new_path(spark, "levels"), None
    for number in range(13):
        some = batch(spark, number)
        rows = some if rows is None else rows.unionByName(some)
        assert levels.store_batch(some, target, "q", number, ["k"], newest, fanout=3)
        loads = levels.loads_of(spark, target)
        per_level = {x["level"]: 0 for x in loads}
        for x in loads:
            per_level[x["level"]] += 1
        assert max(per_level.values()) <= 2 and len(per_level) <= 3
    assert max(x["level"] for x in loads) == 2
    got = levels.read(spark, target, rows.schema, ["k"], newest).collect()
    want = levels.latest_rows(rows, ["k"], newest()).collect()
    assert sorted(got) == sorted(want)


def test_replay_and_crash_between_write_and_switch(spark):
    target = new_path(spark, "levels")
    first = batch(spark, 1)
    # a crash after the folder is written and before the version names it
    first.where("k < 5").write.parquet(f"{target}/load=q-0")
    assert levels.read(spark, target, first.schema, ["k"], newest).count() == 0
    assert levels.store_batch(first, target, "q", 0, ["k"], newest)
    assert not levels.store_batch(first, target, "q", 0, ["k"], newest)
    assert len(levels.loads_of(spark, target)) == 1
    # a query with a new checkpoint starts at batch 0 again
    assert levels.store_batch(batch(spark, 2), target, "other", 0, ["k"], newest)
    both = first.unionByName(batch(spark, 2))
    got = levels.read(spark, target, first.schema, ["k"], newest).collect()
    assert sorted(got) == sorted(levels.latest_rows(both, ["k"], newest()).collect())


def test_ids_last_over_loads(spark):
    kind = "a string, b int"
    none = spark.createDataFrame([], kind + ", id bigint")
    first = numbering.allocate_ids(
        none, spark.createDataFrame([("y", 1), ("x", 2), ("x", 2), (None, 1)], kind), ["a", "b"], "id"
    )
    one = {tuple(r)[:2]: r["id"] for r in first.collect()}
    assert sorted(one.values()) == [1, 2, 3]
    again = spark.createDataFrame([("a", 0), ("x", 2), (None, 1), ("z", None)], kind)
    two = {tuple(r)[:2]: r["id"] for r in numbering.allocate_ids(first, again, ["a", "b"], "id").collect()}
    assert one.items() <= two.items() and len(two) == 5
    assert sorted(two.values()) == [1, 2, 3, 4, 5] and two[("a", 0)] < two[("z", None)]


def test_landing_keeps_every_row(spark):
    rows = spark.createDataFrame(
        [("1", "a", "5", "0.5", "x"), (None, "b" * 101, "five", "0.5", "y"), ("2", "c", None, "z", None)],
        "category_code string, category_name string, job_count string,"
        " category_job_ratio string, note string",
    )
    path = new_path(spark, "landing")
    schemas.land(rows, "fact_job_ratio", path)
    good = schemas.landed(spark, "fact_job_ratio", path)
    assert [r["job_count"] for r in good.collect()] == [5]
    bad = schemas.landed(spark, "fact_job_ratio", path, accepted=False).orderBy("category_name").collect()
    assert [list(r["reasons"]) for r in bad] == [
        ["null:category_code", "length:category_name", "type:job_count"],
        ["null:job_count", "type:category_job_ratio"],
    ]
    assert '"note":"y"' in bad[0]["raw"] and '"job_count":"five"' in bad[0]["raw"]


def test_cascade_over_loops_and_null_references(spark):
    people = spark.createDataFrame(
        [(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 99)], "id int, boss int"
    )
    notes = spark.createDataFrame([(1, 4), (2, 5), (3, None)], "note int, owner int")
    left = cascade_delete(
        {"people": people, "notes": notes},
        {"people": {"boss": ("people", "id")}, "notes": {"owner": ("people", "id")}},
        {"people": spark.createDataFrame([(2,)], "id int")},
    )
    assert {r["id"] for r in left["people"].collect()} == {1, 5, 6}
    assert {r["note"] for r in left["notes"].collect()} == {2, 3}


def test_medians_of_a_group_over_many_partitions(spark):
    rng = random.Random(3)
    values = {"hot": [rng.randrange(500) for _ in range(4001)], "even": [4, 1, 3, 3], None: [7]}
    rows = [(g, v) for g, some in values.items() for v in some] + [("none", None), ("hot", None)]
    got = {
        r["g"]: r["median"]
        for r in exact_medians(spark.createDataFrame(rows, "g string, v int"), ["g"], "v").collect()
    }
    assert got == {g: statistics.median(some) for g, some in values.items()} | {"none": None}


def test_newest_reply_decides(spark):
    job = spark.createDataFrame([("a", "on", None)], "job_id string, url_status string, updated_at timestamp")
    replies = spark.createDataFrame(
        [("a", None, "on", 1), ("a", "404_not_found", None, 2)],
        "job_id string, status string, switch string, seq int",
    )
    now = F.lit(dt.datetime(2024, 1, 1))
    got = ingest.apply_liveness(job, replies, now, newest_first=[F.desc("seq")]).first()
    assert got["url_status"] == "off"
    got = ingest.apply_liveness(job, replies, now, newest_first=[F.asc("seq")]).first()
    assert got["url_status"] == "on"


def test_null_keys_are_never_merged_in(spark):
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    source = spark.createDataFrame([(None, 2), ("b", 3)], "k string, v int")
    once = merge.upsert(target, source, ["k"])
    twice = merge.upsert(once, source, ["k"])
    assert sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 3)]
