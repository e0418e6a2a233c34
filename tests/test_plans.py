"""Silver, gold, read and ingest plans on inline rows with known results."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from jobmart.functions.convert import instant
from jobmart.operators import numbering
from jobmart.plans import gold, ingest, serve, silver
from jobmart.shared import new_path
from jobmart.sources import schemas, tables
from jobmart.streaming import incremental

NOW = dt.datetime(2024, 1, 31)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def document(url, at, rec, **parts):
    doc = {
        "switch": "on", "batch_id": at.replace("-", "")[:8] + "_001",
        "ingestion_timestamp": at + "T10:00:00Z", "record_index_in_batch": rec, "custNo": "C1",
        "industry": "IT", "industryNo": "I1", "employees": "250人", "closeDate": "",
        "postalCode": "110",
        "header": {"analysisUrl": url, "jobName": f"name {rec}", "appearDate": "2024/01/02",
                   "custName": f"company {rec}", "hrBehaviorPR": "0.25"},
        "jobDetail": {"jobDescription": "we use C++", "salaryMin": 5, "salaryMax": 6,
                      "salaryType": 50, "longitude": "121.5", "latitude": "x"},
        "condition": {},
    }
    for key, value in parts.items():
        if isinstance(value, dict):
            doc[key] = {**(doc.get(key) or {}), **value}
        else:
            doc[key] = value
    return doc


@pytest.fixture(scope="module")
def bronze(spark, tmp_path_factory):
    a, b = "https://jobs.example/job/a1", "https://jobs.example/job/b2/"
    cat = lambda *codes: [{"code": c, "description": "d" + c} for c in codes]
    docs = [
        document(a, "2024-01-01", 1, jobDetail={"jobCategory": cat("x", "y", "x")},
                 condition={"skill": cat("s1"), "language": [
                     {"code": "en", "language": "English", "ability": {"listening": "old"}}]}),
        document(a, "2024-01-15", 2, header={"jobName": None},
                 jobDetail={"jobCategory": cat("y"), "salaryType": 10,
                            "remoteWork": {"type": 2, "description": ""},
                            "workType": ["day", "day"]},
                 condition={"other": "knows DS1 well", "major": ["math"],
                            "certificate": [{"description": "c"}],
                            "language": [
                                {"code": "en", "language": "English", "ability": {"listening": "new"}},
                                {"code": "en", "language": "English", "ability": {"listening": "2nd"}}]}),
        document(a, "2024-01-20", 3, switch="off", header={"jobName": "gone"}),
        document(b, "2024-01-15", 4, custNo="C2", employees="暫不提供",
                 jobDetail={"remoteWork": {"type": 9, "description": "home"}}),
        document("", "2024-01-15", 5, custNo="C3", employees="1,200人"),
    ]
    path = tmp_path_factory.mktemp("bronze") / "docs.json"
    path.write_text("\n".join(json.dumps(d, ensure_ascii=False) for d in docs))
    landed = tables.read_job_details(spark, str(path))
    table = new_path(spark, "test-bronze")
    tables.write_job_details(landed, table)
    return tables.read_job_details(spark, table, "parquet")


def test_silver_company(bronze):
    got = {r["cust_no"]: r for r in silver.silver_company(bronze, instant(NOW)).collect()}
    assert got["C1"]["cust_name"] == "company 2"
    assert [got[c]["employees_count"] for c in ("C1", "C2", "C3")] == [250, None, 1]
    assert got["C1"]["_source_batch_id"] == "20240115_001"


def test_silver_job(spark, bronze):
    got = {r["job_id"]: r for r in silver.silver_job(bronze, instant(NOW)).collect()}
    assert set(got) == {"a1", "b2"}
    a = got["a1"]
    # newest active document, its NULL name included; negotiable salary is zeroed
    assert (a["job_name"], a["salary_min"], a["salary_max"]) == (None, 0, 0)
    assert a["is_salary_negotiable"] is True
    assert (a["remote_work_status"], a["remote_work_description"]) == ("HYBRID_TYPE2", None)
    assert a["appear_date"] == dt.date(2024, 1, 2) and a["close_date"] is None
    assert (a["longitude"], a["latitude"]) == (Decimal("121.5"), None)
    assert a["hr_behavior_pr"] == Decimal("0.25")
    b = got["b2"]
    assert (b["salary_min"], b["is_salary_negotiable"]) == (5, False)
    assert (b["remote_work_status"], b["remote_work_description"]) == ("NOT_SPECIFIED", "home")
    table = schemas.conform(silver.silver_job(bronze, instant(NOW)), "job")
    assert table.dtypes == spark.createDataFrame([], schemas.TABLES["job"].schema).dtypes


def test_daily_window_reads_two_days(bronze):
    daily = silver.silver_job(bronze, instant(NOW), as_of=dt.date(2024, 1, 15))
    assert {r["job_id"] for r in daily.collect()} == {"a1", "b2"}
    none = silver.silver_job(bronze, instant(NOW), as_of=dt.date(2024, 1, 18))
    assert none.count() == 0
    plan = daily._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ingest_day" in plan


def test_silver_children(bronze):
    cats = silver.silver_job_category(bronze)
    assert rows_of(cats) == [("a1", "x", "dx", 0), ("a1", "y", "dy", 0)]
    langs = silver.silver_language(bronze).select("job_id", "language_code", "listening_level")
    assert rows_of(langs) == [("a1", "en", "new")]
    needs = rows_of(silver.silver_requirement(bronze))
    assert needs == [("a1", "CERTIFICATE", "c"), ("a1", "MAJOR", "math"), ("a1", "WORK_TYPE", "day")]
    names = silver.condition_references(bronze, "skill")
    assert rows_of(names.select("code", "name")) == [("s1", "ds1")]
    # listed in one snapshot, mentioned in another: still one row
    assert rows_of(silver.silver_job_skill(bronze, names)) == [("a1", "s1", "ds1")]


@pytest.fixture(scope="module")
def market(spark):
    cat = spark.createDataFrame(
        [(j, "k", "Kind") for j in range(1, 5)] + [(1, "m", "Mix")],
        "job_id long, category_code string, category_description string",
    )
    skill = spark.createDataFrame(
        [(1, "py", "Python"), (2, "py3", "Python3"), (2, "py", "Python"), (3, "sql", "SQL")],
        "job_id long, skill_code string, skill_description string",
    )
    spec = spark.createDataFrame(
        [(4, "e", "ETL")], "job_id long, specialty_code string, specialty_name string"
    )
    options = spark.createDataFrame(
        [("py", "Python", "Python", "Lang", "skill"), ("py3", "Python", "Python3", "Lang", "skill"),
         ("sql", "SQL", "SQL", None, "skill"), ("e", "ETL", "ETL", "Data", "specialty")],
        schemas.TABLES["dim_skill_option"].schema,
    )
    return cat, skill, spec, options


def test_weights_and_ratio(market):
    cat, skill, spec, options = market
    got = {(r[0], r[2]): (r[3], r[4]) for r in
           gold.category_skill_weight(cat, skill, spec, options).collect()}
    # two raw names of one standard skill on one job count once
    assert got[("k", "Python")] == (Decimal("0.5000"), True)
    assert got[("k", "ETL")] == (Decimal("0.2500"), False)
    assert got[("m", "Python")] == (Decimal("1.0000"), True)
    ratio = {r[0]: (r[2], r[3]) for r in gold.category_ratio(cat).collect()}
    assert ratio == {"k": (4, Decimal("1.0000")), "m": (1, Decimal("0.2500"))}


def test_recommend(market):
    cat, skill, spec, options = market
    weights = gold.category_skill_weight(cat, skill, spec, options)
    got = {r["category_code"]: r for r in
           serve.recommend(weights, gold.category_ratio(cat), ["Python"]).collect()}
    assert got["k"]["match_percent"] == Decimal("50.00")
    assert got["k"]["score"] == Decimal("5000.00") and got["k"]["stars"] == 5
    assert got["m"]["match_percent"] == Decimal("100.00")
    assert got["m"]["matched_skills"] == ["Python"]
    assert serve.recommend(weights, gold.category_ratio(cat), ["Cobol"]).count() == 0


def gap_rows(spark, cores, others):
    rows = [("c", f"core{i}", Decimal("0.6"), True) for i in range(cores)]
    rows += [("c", f"o{i:02}", Decimal("0.1") + Decimal(i) / 100, False) for i in range(others)]
    return spark.createDataFrame(
        rows, "category_code string, std_skill_name string, weight decimal(7,4), is_core_skill boolean"
    )


def test_gap_skills_tops_up_to_ten(spark):
    some = serve.gap_skills(gap_rows(spark, 3, 20), [])
    names = {r["std_skill_name"] for r in some.collect()}
    assert len(names) == 10 and {"core0", "core1", "core2", "o19", "o13"} <= names
    assert serve.gap_skills(gap_rows(spark, 12, 20), []).count() == 12
    assert serve.gap_skills(gap_rows(spark, 0, 4), ["o01"]).count() == 3


def test_set_overlap(spark):
    # --- Fixed values: the worked example of the unweighted match. ---
    required = ["Python", "SQL", "GCP", "Docker", "Airflow", "MySQL", "PostgreSQL",
                "資料庫系統管理維護"]
    selected = ["Python", "SQL", "GCP", "Power BI", "Excel", "數據分析"]
    # --- End of fixed values. ---
    df = spark.createDataFrame([("de", required), ("none", [])], "id string, required_skills array<string>")
    got = {r["id"]: r for r in serve.set_overlap(df, selected).collect()}
    assert got["de"]["match_score"] == 37 and len(got["de"]["missing_skills"]) == 5
    assert got["none"]["match_score"] == 0


def test_salary_stat_and_map(spark):
    cards = spark.createDataFrame(
        [(1, 50, "N", "3年 | x", "月薪50,000~70,000元"), (2, 50, "N", "3年 | x", "月薪30,000元"),
         (3, 50, "S", "不拘 | x", "待遇面議"), (4, 50, "W", None, "月薪1元")],
        "job_id long, salary_type_code int, region_group string, exp_edu_text string, salary_text string",
    )
    bridge = spark.createDataFrame(
        [(1, "k", "Kind"), (2, "k", "Kind"), (3, "k", "Kind")],
        "job_id long, category_code string, category_name string",
    )
    stat = gold.salary_stat(cards, bridge, with_median=True)
    got = {(r["region_group"], r["exp_level"]): r for r in stat.collect()}
    n = got[("N", "1~3年")]
    assert (n["job_count"], n["avg_salary_min"], n["avg_salary_max"]) == (2, 30000, 70000)
    assert n["avg_salary_mid"] == n["median_salary"] == 45000
    assert got[("S", "不拘")]["avg_salary_mid"] is None
    assert rows_of(gold.uncategorised_cards(cards, bridge).select("job_id")) == [(4,)]
    grid = {r["region"]: r for r in serve.salary_map(stat, "50").collect()}
    assert len(grid) == 6 and grid["E"]["job_count"] == 0 and grid["E"]["exp_any"] == "尚無資料"
    assert grid["N"]["exp_1to3"] == "共 2 筆 (30,000 ~ 70,000 元)"
    assert grid["S"]["exp_any"] == "共 1 筆 (待遇面議)" and grid["S"]["unit"] == "元/月"
    assert serve.salary_map(stat, "60").count() == 0


def test_cards_follow_null_rules(spark):
    job = spark.createDataFrame(
        [(1, "c", "t", "台北市", 50, "s", None, "大學", None, "d" * 100, "on"),
         (2, "c", "t", None, 50, "s", "1年", "大學", "home", "d", "off"),
         (3, "nobody", "t", None, 50, "s", "1年", "大學", "home", "d", "on")],
        "job_id long, cust_no string, job_name string, address_region string, salary_type_code int,"
        " salary_raw_text string, work_exp_requirement string, edu_requirement string,"
        " remote_work_description string, job_description string, url_status string",
    )
    company = spark.createDataFrame([("c", "Co", "IT")], "cust_no string, cust_name string, industry_name string")
    none = spark.createDataFrame([], "job_id long, skill_code string, skill_description string")
    specs = spark.createDataFrame(
        [(1, "a", "x"), (1, "b", "x"), (1, "c", None)],
        "job_id long, specialty_code string, specialty_name string",
    )
    cards = gold.job_cards(job, company, none, specs, "https://jobs.example/job/").collect()
    assert len(cards) == 1
    card = cards[0]
    # a missing part empties the combined text; NULL and repeated names stay in the array
    assert card["exp_edu_text"] is None and card["work_mode"] == "公司未提供此資訊"
    assert json.loads(card["skills_json"]) == [None, "x", "x"]
    assert len(card["job_desc_short"]) == 80 and card["job_url"].endswith("/job/1")


def test_synonym_steps(spark, market):
    _, skill, spec, options = market
    then = instant(dt.datetime(2023, 1, 1))
    base = spark.createDataFrame([("PYTHON", "Python", "Lang")],
                                 "raw_skill_name string, std_skill_name string, skill_category string")
    known = base.withColumns({"create_time": then, "update_time": then})
    grown = gold.new_names(known, skill, spec, instant(NOW))
    assert {r[0] for r in grown.collect()} == {"PYTHON", "Python3", "SQL", "ETL"}
    assert [r[0] for r in gold.unmapped_names(grown).collect()] == ["ETL", "Python3", "SQL"]
    applied = {r["skill_code"]: r["std_skill_name"] for r in gold.apply_synonyms(options, grown).collect()}
    # the match ignores case, and an option without an entry loses its old name
    assert applied == {"py": "Python", "py3": None, "sql": None, "e": None}


def test_liveness(spark):
    job = spark.createDataFrame(
        [(i, "on", dt.datetime(2024, 1, 1)) for i in range(4)],
        "job_id int, url_status string, updated_at timestamp",
    )
    checks = spark.createDataFrame(
        [(0, ingest.NOT_FOUND, None), (1, "ok", "off"), (2, "ok", "on"), (3, None, None)],
        "job_id int, status string, switch string",
    )
    got = ingest.apply_liveness(job, checks, instant(NOW))
    assert {r[0]: r[1] for r in got.collect()} == {0: "off", 1: "off", 2: "on", 3: "on"}
    assert {r[0] for r in got.where(F.col("updated_at") == instant(NOW)).collect()} == {0, 1, 2}


def test_discover_ids(spark):
    rows = [
        ("c1", 1, 1, "20240110", "//h/job/ad1"), ("c1", 1, 2, "20240110", "//h/job/ad2"),
        ("c1", 1, 3, "20240110", "//h/job/a?x=1"), ("c1", 1, 4, "soon", "//h/job/b"),
        ("c1", 1, 5, "20240110", "//h/job/c/"), ("c1", 2, 1, "20240101", "//h/job/ad3"),
        ("c1", 2, 2, "20240110", "//h/job/ad4"), ("c1", 2, 3, "20240109", "//h/job/d"),
        ("c1", 2, 4, "20240110", "//h/job/e"), ("c2", 1, 3, "20240110", "//h/job/a"),
        ("c2", 151, 9, "20240110", "//h/job/z"), ("c2", 1, 4, "20240110", "//h/job/f"),
        ("c2", 1, 5, "20240110", "//h/job/g"),
    ]
    listing = spark.createDataFrame(rows, "jobcat string, page int, pos int, appearDate string, link string")
    known = spark.createDataFrame([("g",)], "job_id string")
    got = ingest.discover_ids(listing, known, day=dt.date(2024, 1, 10))
    # c2 page 1 loses its first two rows (a, f); g is known; d ends category c1
    assert {r["job_id"] for r in got.collect()} == {"a", "c"}
    history = ingest.discover_ids(listing, known, ads_per_page=0, zone="UTC")
    assert {r["job_id"] for r in history.collect()} == {
        "ad1", "ad2", "a", "c", "ad3", "ad4", "d", "e", "f", "z"}


def test_stream_equals_batch_and_survives_replay(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    newest = lambda: [F.col("ts").desc(), F.col("event_id").desc()]
    landed, target = new_path(spark, "days"), new_path(spark, "target")
    # late files first: arrival order is not time order
    for day in range(6, 0, -1):
        part = events.where(F.dayofmonth("ts") % 6 == day % 6).coalesce(1)
        part.write.mode("append").parquet(landed)

    def load(progress):
        stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
                  .parquet(landed))
        incremental.start_upsert_latest(stream, target, progress, ["user_id"], newest).awaitTermination()

    load(new_path(spark, "progress"))
    window = incremental.latest_rows(events, ["user_id"], newest())
    got = incremental.read_latest(spark, target, events.schema, ["user_id"], newest())
    assert rows_of(got) == rows_of(window)
    load(new_path(spark, "progress"))  # progress lost: every file is loaded again
    again = incremental.read_latest(spark, target, events.schema, ["user_id"], newest())
    assert rows_of(again) == rows_of(window)
    folded = new_path(spark, "folded")
    incremental.compact(spark, target, folded, events.schema, ["user_id"], newest())
    assert rows_of(spark.read.schema(events.schema).parquet(folded).select(events.columns)) == rows_of(window)


def test_bucketed_tables_join_without_shuffle(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet").selectExpr("l_orderkey AS job_id", "l_partkey")
    other = lines.withColumnRenamed("l_partkey", "p")
    a = tables.save_bucketed(lines, "bucketed_a", new_path(spark, "a"), buckets=4)
    b = tables.save_bucketed(other, "bucketed_b", new_path(spark, "b"), buckets=4)
    joined = a.hint("merge").join(b, "job_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE bucketed_a")
    spark.sql("DROP TABLE bucketed_b")


def test_tables_round_trip(spark, market):
    options = market[3]
    path = new_path(spark, "options")
    tables.write_table(options, path, "dim_skill_option")
    assert rows_of(tables.read_table(spark, path, "dim_skill_option")) == rows_of(options)
    report = schemas.declared_report("dim_skill_option", {"dim_skill_option": options})
    assert all(r["violations"] == 0 for r in report.collect())


def test_shared_folder_needs_a_setting_on_a_cluster(spark, monkeypatch):
    from jobmart import shared

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value or default

    class Context:
        applicationId = "app-1"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        def __init__(self, value):
            self.conf = Conf(value)

    assert shared.shared_dir(Session("hdfs:///work/")) == "hdfs:///work/jobmart-app-1"
    with pytest.raises(RuntimeError):
        shared.shared_dir(Session(None))


def test_hot_job_is_split(spark):
    """A third of the rows under one key: adaptive execution splits that partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "40",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 90000, 1, 12)
        job_of = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20000)
        bridge = rows.select(
            job_of.alias("job_id"), F.col("id").cast("string").alias("category_code"),
            F.lit("name").alias("category_name"),
        )
        cards = spark.range(20000).select(
            F.col("id").alias("job_id"), F.lit(50).alias("salary_type_code"),
            F.lit("N").alias("region_group"), F.lit("3年").alias("exp_edu_text"),
            F.lit("月薪30,000元").alias("salary_text"),
        )
        stat = gold.salary_stat(cards, bridge)
        assert len(stat.collect()) == 90000
        assert "skew=true" in stat._jdf.queryExecution().executedPlan().toString()

        labelled = numbering.number_within(
            bridge.withColumn("category_code", F.col("category_code").cast("int")),
            ["job_id"], ["category_code"], "n",
        )
        top = labelled.where("job_id = 0").agg(F.max("n")).collect()[0][0]
        assert top == 30003  # multiples of 3, and of 20000 among the others
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_newest_rows_are_reduced_before_the_shuffle(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    from jobmart.operators.latest import latest_rows

    plan = latest_rows(events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")
