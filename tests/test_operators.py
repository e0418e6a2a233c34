"""Operators against brute force and small inline rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from jobmart.operators import latest, matching, merge, nested, numbering, paging, quality, sequence


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    """Events in which one key owns a third of the rows."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = 0 if i % 3 == 0 else rng.randrange(1, 60)
        rows.append((key, rng.randrange(200), i, rng.choice("abc") if i % 5 else None))
    return rows, spark.createDataFrame(rows, "k int, t int, id int, v string").repartition(6)


def test_latest_rows_and_values(skewed):
    rows, df = skewed
    best = {}
    for r in rows:
        if r[0] not in best or (r[1], r[2]) > (best[r[0]][1], best[r[0]][2]):
            best[r[0]] = r
    got = latest.latest_rows(df, ["k"], [F.col("t").desc(), F.col("id").desc()])
    assert rows_of(got) == sorted(best.values(), key=repr)
    vals = latest.latest_values(df, ["k"], ["v"], [F.col("t"), F.col("id")])
    # a NULL newest value is kept as NULL
    assert rows_of(vals) == sorted(((k, r[3]) for k, r in best.items()), key=repr)
    assert any(r[3] is None for r in best.values())


def test_number_rows_is_one_window_without_one_task(skewed):
    rows, df = skewed
    got = numbering.number_rows(df, ["t", "id"], "n")
    want = {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    assert {r["id"]: r["n"] for r in got.collect()} == want


def test_number_within_hot_group(skewed):
    rows, df = skewed
    got = numbering.number_within(df, ["k"], ["t", "id"], "n")
    want, seen = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen[r[0]] = seen.get(r[0], 0) + 1
        want[r[2]] = seen[r[0]]
    assert {r["id"]: r["n"] for r in got.collect()} == want


def test_batches_and_surrogate_keys(spark):
    df = spark.range(25).withColumnRenamed("id", "x")
    got = numbering.batches_of(df, ["x"], 10)
    assert {r["x"]: r["batch_no"] for r in got.collect()} == {i: i // 10 for i in range(25)}
    keyed = numbering.surrogate_key(df, ["x"], "stat_id")
    assert keyed.columns == ["stat_id", "x"]
    assert rows_of(keyed) == sorted(((i + 1, i) for i in range(25)), key=repr)


def test_positional_join_stops_at_the_shorter_side(spark):
    left = spark.createDataFrame([("b",), ("a",), ("c",)], "l string")
    right = spark.createDataFrame([(2,), (1,)], "r int")
    got = numbering.positional_join(left, right, ["l"], ["r"])
    assert rows_of(got.select("l", "r")) == [("a", 1), ("b", 2)]


def test_skip_head_and_take_while(skewed):
    rows, df = skewed
    want_skip, want_take, seen, stopped = set(), set(), {}, set()
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen[r[0]] = seen.get(r[0], 0) + 1
        if seen[r[0]] > 2:
            want_skip.add(r[2])
        if r[3] == "c" or r[3] is None:
            stopped.add(r[0])
        if r[0] not in stopped:
            want_take.add(r[2])
    got = sequence.skip_head(df, ["k"], ["t", "id"], 2)
    assert {r["id"] for r in got.collect()} == want_skip
    took = sequence.take_while(df, ["k"], ["t", "id"], F.col("v") != "c")
    assert {r["id"] for r in took.collect()} == want_take


def test_upsert_is_idempotent_and_keeps_other_columns(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, u string, w string")
    source = spark.createDataFrame([(2, "B"), (3, None)], "k int, u string")
    once = merge.upsert(target, source, ["k"])
    assert rows_of(once) == [(1, "a", "x"), (2, "B", "y"), (3, None, None)]
    assert rows_of(merge.upsert(once, source, ["k"])) == rows_of(once)
    # an update to NULL overwrites
    blank = spark.createDataFrame([(1, None)], "k int, u string")
    assert rows_of(merge.upsert(target, blank, ["k"]))[0] == (1, None, "x")


def test_upsert_chosen_columns_and_defaults(spark):
    target = spark.createDataFrame([(1, "on", 5)], "k int, url_status string, n int")
    source = spark.createDataFrame([(1, "off", 6), (2, "off", 7)], "k int, url_status string, n int")
    kept = merge.upsert(target, source, ["k"], update_cols=["n"])
    assert rows_of(kept) == [(1, "on", 6), (2, "off", 7)]
    with_default = merge.upsert(
        target, source.drop("url_status"), ["k"], defaults={"url_status": F.lit("on")}
    )
    assert rows_of(with_default) == [(1, "on", 6), (2, "on", 7)]


def test_upsert_newest_source_row_wins(spark):
    target = spark.createDataFrame([(1, "a")], "k int, u string")
    source = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, u string, t int")
    got = merge.upsert(target, source, ["k"], newest_first=[F.col("t").desc()])
    assert rows_of(got) == [(1, "new")]


def test_insert_ignore(spark):
    target = spark.createDataFrame([(1, "a")], "k int, u string")
    source = spark.createDataFrame([(1, "z"), (2, "b"), (2, "b"), (None, "n")], "k int, u string")
    assert rows_of(merge.insert_ignore(target, source, ["k"])) == [(1, "a"), (2, "b")]


def test_keyed_update(spark):
    target = spark.createDataFrame(
        [(1, "x", "p", 0), (2, "x", "p", 0), (3, "y", "p", 0)], "id int, k string, s string, at int"
    )
    change = spark.createDataFrame([("x", "done")], "k string, s string")
    every = merge.keyed_update(target, change, ["k"], ["s"], touch={"at": F.lit(9)})
    assert rows_of(every) == [(1, "x", "done", 9), (2, "x", "done", 9), (3, "y", "p", 0)]
    first = merge.keyed_update(target, change, ["k"], ["s"], first_only_by=["id"])
    assert rows_of(first) == [(1, "x", "done", 0), (2, "x", "p", 0), (3, "y", "p", 0)]


def test_zero_then_merge(spark):
    stored = spark.createDataFrame([("a", 5, "text"), ("b", 6, "more")], "k string, n int, d string")
    fresh = spark.createDataFrame([("b", 9), ("c", 1)], "k string, n int")
    got = merge.zero_then_merge(stored, fresh, ["k"], ["n"])
    assert rows_of(got) == [("a", 0, "text"), ("b", 9, "more"), ("c", 1, None)]


def test_replace_table_reads_back(spark):
    df = spark.range(5)
    assert merge.replace_table(df, "t").count() == 5


def test_json_arrays(spark):
    texts = ['["a","b"]', "oops", None, "", '["a"],', '["a"]],[["b"]', '{"a":1}', "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", nested.parse_json_array(F.col("t"))).orderBy("i").collect()
    assert [list(r[1]) for r in got] == [["a", "b"], [], [], [], [], [], [], []]


def test_extract_records(spark):
    replies = [
        (1, 'Sure!\n```json\n[{"n": "a", "c": 1}, {"n": "b"}]\n```'),
        (2, "[{broken"),
        (3, 'prose [{"n": "c"}, ] prose'),
        (4, '```json\n{"n": "d", "c": 2}\n```'),
        (5, None),
    ]
    df = spark.createDataFrame(replies, "i int, t string")
    got = nested.extract_records(df, "t", "struct<n:string,c:int>", keep=["i"])
    assert rows_of(got) == [(1, "a", 1), (1, "b", None), (4, "d", 2)]


def test_first_index(spark):
    df = spark.createDataFrame([(["a", "b", "a"],)], "x array<string>")
    got = nested.unwind(df, F.col("x"), "e").select(
        "e", nested.first_index(F.col("x"), F.col("e")).alias("i")
    )
    assert rows_of(got.distinct()) == [("a", 0), ("b", 1)]


def test_paging(spark):
    df = spark.range(45).withColumnRenamed("id", "job_id")
    page = paging.page_of(df, [F.col("job_id").desc()], 3, 20)
    assert sorted(r[0] for r in page.collect()) == [0, 1, 2, 3, 4]
    assert rows_of(paging.page_total(df, "job_id", 20)) == [(45, 3)]
    assert rows_of(paging.page_total(df.where("false"), "job_id", 20)) == [(0, 1)]
    none = paging.fallback_if_empty(df.where("job_id < 0"), df)
    assert none.count() == 45
    assert paging.fallback_if_empty(df.where("job_id < 3"), df).count() == 3
    assert paging.where_all(df, [None, paging.equals_unless_all("job_id", "ALL")]).count() == 45


def test_constraint_report_and_cascade(spark):
    df = spark.createDataFrame([(1, "aa", 1), (1, None, 2), (2, "b", 9)], "k int, s string, p int")
    parent = spark.createDataFrame([(1,), (2,)], "pk int")
    report = quality.constraint_report(
        df, key=["k"], not_null=["s"], max_length={"s": 1}, foreign={"p": (parent, "pk")}
    )
    assert dict(tuple(r) for r in report.collect()) == {
        "unique:k": 1, "not_null:s": 1, "length:s": 1, "foreign:p": 1,
    }
    kept = quality.cascade_children(df, parent.withColumnRenamed("pk", "p"), "p")
    assert sorted(r["p"] for r in kept.collect()) == [1, 2]


NAMES = [
    ("1", "A+"), ("2", "C++"), ("3", "資料庫"), ("4", "Skill"), ("5", "Google Analytics"),
    ("6", ".NET"), ("7", "a"), ("8", "庫"), ("9", "Café"), ("10", "++"), ("11", "x\\Ey"),
    ("12", "K8s"), ("13", "資料 庫"), ("14", "naïve Bayes"),
]
TEXTS = [
    "team a plan", "Use c++ daily", "資料庫系統管理", "upskilled people", "google  analytics",
    "GOOGLE ANALYTICS!", "asp.net", "we like .net", "CAFÉ", "cafe", "c++", "i++ and ++i",
    "x\\Ey marks", "k8s K8s", "大資料 庫", "a", "", None, "NAÏVE bayes\nA+",
    "SKILL", "sſkill", "ſkill",
]


def brute_force(texts, names):
    found = set()
    for i, t in enumerate(texts):
        for code, name in names:
            pattern = f"(?:^|[^a-zA-Z0-9]){re.escape(name)}(?:$|[^a-zA-Z0-9])"
            if re.search(pattern, t or "", re.IGNORECASE):
                found.add((i, code, name))
    return found


def test_match_terms_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    items = spark.createDataFrame([(c, n) for c, n in NAMES], "code_in string, name_in string")
    names = matching.reference_list(items, "code_in", "name_in", [F.col("code_in")])
    got = matching.match_terms(docs, names, ["i"], ["t"])
    assert {tuple(r) for r in got.collect()} == brute_force(TEXTS, NAMES)


def test_match_terms_random_texts_two_columns(spark):
    rng = random.Random(3)
    alphabet = ["a", "B", "1", "+", " ", "庫", "é", "k", ".", "\n"]
    names = [(str(i), "".join(rng.choices(alphabet[:8], k=rng.randint(1, 4)))) for i in range(40)]
    names = list({n: (c, n) for c, n in names if n.strip()}.values())
    docs = [
        (i, "".join(rng.choices(alphabet, k=12)), "".join(rng.choices(alphabet, k=6)))
        for i in range(300)
    ]
    df = spark.createDataFrame(docs, "i int, a string, b string")
    items = spark.createDataFrame(names, "code_in string, name_in string")
    refs = matching.reference_list(items, "code_in", "name_in", [F.col("code_in")])
    got = matching.match_terms(df, refs, ["i"], ["a", "b"])
    want = brute_force([d[1] for d in docs], names) | brute_force([d[2] for d in docs], names)
    assert {tuple(r) for r in got.collect()} == want


def test_names_that_share_a_word_are_filed_under_their_rare_words(spark):
    docs = spark.createDataFrame(
        [(i, f"our expertise {i % 50} is wide") for i in range(200)] + [(None, "expertise 7, yes")],
        "i int, t string",
    )
    items = spark.createDataFrame(
        [(f"c{i}", f"Expertise {i}") for i in range(60)] + [("e", "Expertise"), ("s", "++")],
        "code_in string, name_in string",
    )
    names = matching.reference_list(items, "code_in", "name_in", [F.col("code_in")])
    held = docs.select(F.explode(F.split(F.lower("t"), "[^a-z0-9]+")).alias("anchor"))
    anchors = matching.rarest_anchors(matching._choices(names), held).collect()
    filed = {r["name"]: r["anchor"] for r in anchors}
    assert filed == {"Expertise": "expertise", "++": "++"} | {
        f"Expertise {i}": str(i) for i in range(60)
    }
    got = {tuple(r) for r in matching.match_terms(docs, names, ["i"], ["t"]).collect()}
    want = {(i, f"c{i % 50}", f"Expertise {i % 50}") for i in range(200)}
    want |= {(None, "c7", "Expertise 7"), (None, "e", "Expertise")}
    assert got == want | {(i, "e", "Expertise") for i in range(200)}


def test_match_terms_listed_names_are_exact(spark):
    docs = spark.createDataFrame([(1, "", ["Go", "rust"])], "i int, t string, l array<string>")
    items = spark.createDataFrame([("g", "Go"), ("r", "Rust")], "c string, n string")
    names = matching.reference_list(items, "c", "n", [F.col("c")])
    got = matching.match_terms(docs, names, ["i"], ["t"], listed="l")
    assert rows_of(got) == [(1, "g", "Go")]


def test_null_group_is_a_group(spark):
    from jobmart.operators import numbering, sequence

    rows = [(None, 1, True), (None, 2, False), (None, 3, True), ("a", 1, True), ("a", 2, True)]
    df = spark.createDataFrame(rows, "g string, n int, ok boolean")
    kept = sequence.take_while(df, ["g"], ["n"], F.col("ok")).select("g", "n").collect()
    assert {tuple(r) for r in kept} == {(None, 1), ("a", 1), ("a", 2)}
    rest = sequence.skip_head(df, ["g"], ["n"], 1).select("g", "n").collect()
    assert {tuple(r) for r in rest} == {(None, 2), (None, 3), ("a", 2)}
    numbered = numbering.number_within(df, ["g"], ["n"]).select("g", "n", "row_no").collect()
    assert {tuple(r) for r in numbered} == {
        (None, 1, 1), (None, 2, 2), (None, 3, 3), ("a", 1, 1), ("a", 2, 2)}


def test_repeated_changes_do_not_multiply_rows(spark):
    target = spark.createDataFrame([(1, "x", 0), (2, "y", 0)], "k int, name string, n int")
    changes = spark.createDataFrame([(1, "b", 5), (1, "c", 4)], "k int, name string, n int")
    got = merge.keyed_update(target, changes, ["k"], ["name"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, "c", 0), (2, "y", 0)]
    got = merge.zero_then_merge(target, changes, ["k"], ["n"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, "b", 5), (2, "y", 0)]
    got = merge.insert_ignore(target.where("k = 2"), changes, ["k"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, "b", 5), (2, "y", 0)]
