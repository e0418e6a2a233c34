"""Rows that odd names and larger tables showed to be lost, and plans that must stay bounded."""

import re

from pyspark.sql import functions as F

from jobmart import shared
from jobmart.checks import all_queries
from jobmart.operators import matching, paging
from jobmart.plans import gold, silver
from jobmart.sources import tables


def test_keyword_match_finds_names_without_ascii_letters(spark, tmp_path):
    texts = [(1, "sentence ends in Ñ. Next", "en", "s"), (2, "no such letter", "en", "s")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(7, "Plain. Ñ.")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = all_queries()["keyword_match"](spark, str(tmp_path)).where(F.col("name") == "Ñ.")
    assert [tuple(r) for r in rows.collect()] == [(1, "b7", "Ñ.")]


def _weight_tables(spark):
    rows = [(j, j % 7 % 3, f"cat {j % 2}") for j in range(60)] + [(j, 9, None) for j in range(40)]
    cats = spark.createDataFrame(
        rows + rows[:20] + [(1, None, "no code")],
        "job_id int, category_code int, category_description string",
    )
    asks = [(j, f"P{j % k}") for j in range(60) for k in (2, 3, 5, 7)]
    skills = spark.createDataFrame(asks, "job_id int, skill_code string")
    special = spark.createDataFrame([(j, "S1") for j in range(30)], "job_id int, specialty_code string")
    names = [(f"P{n}", f"skill {n % 4}") for n in range(7)] + [("S1", "skill 0"), ("P6", None)]
    return cats, skills, special, spark.createDataFrame(names, "skill_code string, std_skill_name string")


def test_weights_of_busy_categories_are_those_of_calm_ones(spark):
    tables = _weight_tables(spark)
    calm = gold.category_skill_weight(*tables)
    cats, skills, special, options = (t.collect() for t in tables)
    name = {}
    for code, std in options:
        name.setdefault(code, set()).update({std} - {None})
    asked = {(j, s) for j, c in [*skills, *special] for s in name[c]}
    pairs = {tuple(r) for r in cats if r[1] is not None}
    want = []
    for code, label in {(c, d) for _, c, d in pairs}:
        jobs = {j for j, c, d in pairs if (c, d) == (code, label)}
        for total in [len({j for j, c, d in pairs if (c, d) == (code, o)})
                      for o in {d for _, c, d in pairs if c == code}]:
            for std in {s for j, s in asked if j in jobs}:
                n = len({j for j, s in asked if s == std and j in jobs})
                want.append((code, label, std, round(n / total + 1e-9, 4)))
    for weights in [calm, gold.category_skill_weight(*tables, busy_jobs=15)]:
        got = [(r[0], r[1], r[2], float(r[3])) for r in weights.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_weights_are_shuffled_once_by_category(spark):
    """What callers group by the category reads the weights without another shuffle."""
    weights = gold.category_skill_weight(*_weight_tables(spark))
    grouped = weights.groupBy("category_code").agg(F.sum("weight"))

    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffles(grouped) == shuffles(weights)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_landing_deals_documents_by_their_own_size(spark, tmp_path):
    """Few rows unfold to large documents; before, each input task wrote and sorted every day."""
    rows = spark.range(400).selectExpr(
        "id", "TIMESTAMP '2024-01-01' + make_dt_interval(CAST(id % 3 AS INT)) AS ingestion_timestamp"
    )
    tables.write_job_details(rows.repartition(4), f"{tmp_path}/landed")
    landed = spark.read.parquet(f"{tmp_path}/landed")
    assert sorted(r[0] for r in landed.select("id").collect()) == list(range(400))
    assert landed.select("ingest_day").distinct().count() == 3
    assert len(list((tmp_path / "landed").glob("*/*.parquet"))) == 3


def test_shuffle_partitions_follow_the_tables(spark, data, monkeypatch):
    """Before, every task took an eighth of the table, however large it was."""
    monkeypatch.setattr(shared, "PARTITION_BYTES", 1024)
    keys = ["coalescePartitions.initialPartitionNum", "advisoryPartitionSizeInBytes"]
    try:
        for name in ["category_ratio", "category_ratio_active", "refresh_ratio", "new_names"]:
            plan = all_queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
            parts = [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan)]
            assert parts and min(parts) > 8
    finally:
        for key in keys:
            spark.conf.unset(f"spark.sql.adaptive.{key}")


def test_a_repeated_text_is_searched_once(spark, monkeypatch):
    """Before, the texts of every snapshot were searched; what each posting holds stays."""
    seen = []

    def spied(docs, *args, **kwargs):
        seen.append(docs.count())
        return matching.match_terms(docs, *args, **kwargs)

    monkeypatch.setattr(silver, "match_terms", spied)
    rows = [(f"u{i % 5}", i, [None, "knows c++"][i % 2], "uses SQL daily", i % 3) for i in range(30)]
    raw = spark.createDataFrame(rows, "job string, i int, other string, text string, k int")
    docs = raw.selectExpr(
        "'on' AS switch", "TIMESTAMP '2024-01-01' AS ingestion_timestamp",
        "named_struct('analysisUrl', concat('x/', job)) AS header",
        "named_struct('jobDescription', text) AS jobDetail",
        "named_struct('other', other, 'skill', array(named_struct('code', 'c', 'description',"
        " IF(k = 0, 'Go', CAST(NULL AS STRING))))) AS condition",
    )
    names = [("1", "C++"), ("2", "SQL"), ("3", "Go"), ("4", "Rust")]
    refs = spark.createDataFrame(names, "code string, name string")
    got = {tuple(r) for r in silver.match_condition(docs, refs, "skill").collect()}
    assert seen == [2]
    assert got == {(f"u{j}", c, n) for j in range(5) for c, n in names[:3]}


def test_small_blocks_share_a_folder(spark, tmp_path, monkeypatch):
    """Before, 64 rows made a folder; now a folder has as many blocks as fit, and every page is
    whole wherever it lies."""
    monkeypatch.setattr(paging, "BLOCK_ROWS", 1000)
    rows = spark.range(2500).selectExpr("id", "repeat('x', CAST(id % 9 AS INT)) AS text")
    paging.store_pages(rows, [F.col("id").desc()], f"{tmp_path}/pages", block_rows=64)
    assert len(list((tmp_path / "pages").glob("block=*"))) == 3
    for page in (1, 2, 52, 53, 125, 126):
        got = [r["id"] for r in paging.read_page(spark, f"{tmp_path}/pages", page, 20).collect()]
        assert got == list(range(2500 - 20 * (page - 1) - 1, max(-1, 2500 - 20 * page - 1), -1))
