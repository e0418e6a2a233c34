"""Job-market views over the star-schema tables, so every plan can run on them.

The expressions use only syntax that any SQL engine shares, so that the same view can be
stated to a second engine for checking.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmart.shared import new_path, with_room
from jobmart.sources.tables import read_job_details, write_job_details

JOB_URL = "https://jobs.example/job/"

COMPANY = ["c_custkey AS cust_no", "c_name AS cust_name", "c_mktsegment AS industry_name"]

# {price} is the order total as text with thousands separators, filled in per engine.
JOB = [
    "o_orderkey AS job_id",
    "o_custkey AS cust_no",
    "concat('Job ', o_orderkey) AS job_name",
    "CAST(o_orderdate AS DATE) AS appear_date",
    "CAST(o_orderdate + INTERVAL 2 DAY AS TIMESTAMP) AS updated_at",
    "CASE WHEN o_orderstatus = 'F' THEN 'off' ELSE 'on' END AS url_status",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 30"
    " WHEN '4-NOT SPECIFIED' THEN 60 ELSE 50 END AS salary_type_code",
    "CASE o_orderkey % 7 WHEN 0 THEN concat('月薪', {price}, '~', {price_high}, '元')"
    " WHEN 1 THEN concat('年薪', {price}, '元以上')"
    " WHEN 2 THEN '待遇面議'"
    " WHEN 3 THEN concat(CAST(floor(o_totalprice / 10000) AS BIGINT), '萬~',"
    " CAST(floor(o_totalprice / 5000) AS BIGINT), '萬')"
    " WHEN 4 THEN concat('月薪', {price}, '-', {price_high}, '元')"
    " WHEN 5 THEN concat('待遇面議(經常性薪資達', o_custkey % 9 + 1, '萬元或以上)')"
    " ELSE concat('時薪', {price}, '元') END AS salary_raw_text",
    "CASE WHEN o_custkey % 19 = 0 THEN '不拘' ELSE concat(o_custkey % 19, '年以上') END"
    " AS work_exp_requirement",
    "CASE o_orderstatus WHEN 'P' THEN '大學' WHEN 'F' THEN '碩士' ELSE '不拘' END"
    " AS edu_requirement",
    "CASE o_custkey % 10 WHEN 0 THEN '台北市' WHEN 1 THEN '新北市' WHEN 2 THEN '台中市'"
    " WHEN 3 THEN '高雄市' WHEN 4 THEN '花蓮縣' WHEN 5 THEN '金門縣' WHEN 6 THEN '臺北市'"
    " WHEN 7 THEN '嘉義縣' WHEN 8 THEN '海外' END AS address_region",
    "CASE WHEN o_orderpriority <> '3-MEDIUM' THEN concat('remote ', o_orderpriority) END"
    " AS remote_work_description",
    "concat('Order ', o_orderkey, ' of customer ', o_custkey, ' with priority ',"
    " o_orderpriority, ' and status ', o_orderstatus, ', full text follows in the posting')"
    " AS job_description",
]

SKILL_OPTION = [
    "concat('P', p_partkey) AS skill_code",
    "p_brand AS std_skill_name",
    "p_name AS raw_skill_name",
    "p_type AS skill_category",
    "'skill' AS source_type",
]


_landed: dict[tuple[str, str], str] = {}


class Views:
    """The job-market tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, table: str) -> DataFrame:
        return with_room(self.spark.read.parquet(f"{self.folder}/{table}.parquet"))

    @cached_property
    def company(self) -> DataFrame:
        return self.raw("customer").selectExpr(*COMPANY)

    @cached_property
    def job(self) -> DataFrame:
        whole = "CAST(floor(o_totalprice) AS BIGINT)"
        price = f"format_number({whole}, 0)"
        price_high = f"format_number({whole} + 20000, 0)"
        columns = [c.format(price=price, price_high=price_high) for c in JOB]
        return self.raw("orders").selectExpr(*columns)

    @cached_property
    def job_category(self) -> DataFrame:
        pairs = self.raw("lineitem").selectExpr("l_orderkey", "l_partkey").distinct()
        named = pairs.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        return named.selectExpr(
            "l_orderkey AS job_id",
            "l_partkey AS category_code",
            "p_name AS category_description",
        )

    @cached_property
    def job_skill(self) -> DataFrame:
        pairs = self.raw("lineitem").selectExpr("l_orderkey", "l_partkey").distinct()
        named = pairs.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        return named.selectExpr(
            "l_orderkey AS job_id",
            "concat('P', l_partkey) AS skill_code",
            "p_name AS skill_description",
        )

    @cached_property
    def job_specialty(self) -> DataFrame:
        pairs = self.raw("lineitem").selectExpr("l_orderkey", "l_suppkey").distinct()
        named = pairs.join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return named.selectExpr(
            "l_orderkey AS job_id",
            "concat('S', l_suppkey) AS specialty_code",
            "s_name AS specialty_name",
        )

    @cached_property
    def skill_option(self) -> DataFrame:
        return self.raw("part").selectExpr(*SKILL_OPTION)

    @cached_property
    def bronze(self) -> DataFrame:
        """The posting documents as a landed table, written once per session and folder."""
        landing = (self.spark.sparkContext.applicationId, self.folder)
        if landing not in _landed:
            path = new_path(self.spark, "bronze")
            write_job_details(self.documents, path)
            _landed[landing] = path
        return with_room(read_job_details(self.spark, _landed[landing], "parquet"))

    @cached_property
    def documents(self) -> DataFrame:
        """Posting documents built from the events: one document per event, nested fields
        and arrays from its values, many snapshots per posting."""
        e = self.raw("events").selectExpr(
            "* EXCEPT (ts)",
            "CAST(ts AS TIMESTAMP) AS ts",
            "CAST(get_json_object(props, '$.k') AS INT) AS k",
            "date_format(ts, 'yyyyMMdd') AS ymd",
        )
        return e.selectExpr(
            "CASE WHEN event_type = 'error' THEN 'off' ELSE 'on' END AS switch",
            "concat(ymd, '_', lpad(CAST(hour(ts) % 3 + 1 AS STRING), 3, '0')) AS batch_id",
            "ts AS ingestion_timestamp",
            "CAST(event_id AS INT) AS record_index_in_batch",
            "ts AS source_response_timestamp",
            "concat('C', user_id % 40) AS custNo",
            "event_type AS industry",
            "concat('I', k % 10) AS industryNo",
            "CASE k % 4 WHEN 0 THEN concat(k, '人') WHEN 1 THEN concat('1,', 200 + k, '人')"
            " WHEN 2 THEN '暫不提供' END AS employees",
            "'' AS closeDate",
            "CASE WHEN k % 3 = 0 THEN CAST(10000 + k AS STRING) ELSE 'n/a' END AS postalCode",
            "named_struct('analysisUrl', CASE WHEN k = 13 THEN '' WHEN k % 5 = 0 THEN"
            f" concat('{JOB_URL}u', user_id, '/') ELSE concat('{JOB_URL}u', user_id) END,"
            " 'jobName', concat('Posting ', k),"
            " 'appearDate', CASE k % 3 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd')"
            " WHEN 1 THEN date_format(ts, 'yyyy/MM/dd') ELSE '' END,"
            " 'custUrl', concat('//jobs.example/company/c', user_id % 40),"
            " 'custName', concat('Company ', user_id % 40, ' as of ', ymd),"
            " 'hrBehaviorPR', CASE WHEN k % 2 = 0 THEN concat('0.', 10 + k % 90)"
            " ELSE 'unknown' END) AS header",
            "named_struct('email', CASE WHEN k % 2 = 0 THEN concat('hr', k, '@jobs.example')"
            " END) AS contact",
            "named_struct('welfare', concat('welfare ', k)) AS welfare",
            "named_struct('jobDescription', concat('We use Skill ', k % 30,"
            " ', c++ and 資料庫管理 every day; ', event_type),"
            " 'salary', concat('月薪', 20000 + k * 100, '元'), 'salaryMin', 20000 + k * 100,"
            " 'salaryMax', 30000 + k * 100,"
            " 'salaryType', CASE k % 4 WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 50 ELSE 60"
            " END, 'jobType', k % 2 + 1, 'addressRegion', '台北市', 'addressArea', '信義區',"
            " 'addressDetail', concat(k, '號'), 'landmark', '',"
            " 'longitude', concat('121.', 100 + k), 'latitude',"
            " CASE WHEN k % 7 = 0 THEN '' ELSE concat('25.', 100 + k) END,"
            " 'remoteWork', CASE WHEN k % 5 <> 0 THEN named_struct('type', k % 4,"
            " 'description', CASE WHEN k % 3 = 0 THEN '' ELSE concat('remote ', k % 4) END)"
            " END, 'vacationPolicy', '週休二日', 'businessTrip', '', 'manageResp', '',"
            " 'startWorkingDay', '', 'needEmp', concat(k % 5 + 1, '人'),"
            " 'workType', array(concat('W', k % 3), concat('W', k % 2)),"
            " 'jobCategory', CASE WHEN k % 11 <> 0 THEN array("
            " named_struct('code', concat('c', k % 7), 'description', concat('Cat ', k % 7)),"
            " named_struct('code', concat('c', k % 5), 'description', concat('Cat ', k % 5)),"
            " named_struct('code', concat('c', k % 7), 'description', concat('Cat ', k % 7)))"
            " END) AS jobDetail",
            "named_struct('workExp', concat(k % 19, '年以上'), 'edu', '大學',"
            " 'other', CASE WHEN k % 3 = 0 THEN concat('knows SKILL ', k % 25, '; and more')"
            " END,"
            " 'skill', array(named_struct('code', concat('s', k % 20),"
            " 'description', concat('Skill ', k % 20)), named_struct('code', 's90',"
            " 'description', 'C++'), named_struct('code', 's91', 'description', '資料庫')),"
            " 'specialty', CASE WHEN k % 6 <> 0 THEN array(named_struct('code',"
            " concat('p', k % 12), 'description', event_type)) END,"
            " 'language', CASE WHEN k % 4 <> 0 THEN array("
            " named_struct('code', concat('l', k % 3), 'language', concat('Lang ', k % 3),"
            " 'ability', named_struct('listening', concat('L', k % 4), 'speaking',"
            " CASE WHEN k % 2 = 0 THEN concat('S', k % 4) END, 'reading', 'R', 'writing',"
            " event_type)),"
            " named_struct('code', 'l0', 'language', 'Lang 0', 'ability',"
            " named_struct('listening', 'L9', 'speaking', 'S9', 'reading', 'R9', 'writing',"
            " 'W9'))) END,"
            " 'major', CASE WHEN k % 2 = 0 THEN array(concat('M', k % 6)) END,"
            " 'driverLicense', CASE WHEN k % 5 = 0 THEN array('car', concat('D', k % 3)) END,"
            " 'acceptRole', named_struct('role', array(named_struct('description',"
            " concat('role ', k % 3)))),"
            " 'certificate', CASE WHEN k % 3 = 0 THEN array(named_struct('description',"
            " concat('cert ', k % 4))) END) AS condition",
        )
