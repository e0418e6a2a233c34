"""Check queries: stored tables, lasting ids, levelled loads, landing, cascades, medians."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobmart.checks.gold_checks import bridge_of, cards_of
from jobmart.checks.registry import check
from jobmart.functions.convert import instant
from jobmart.operators import numbering
from jobmart.operators.quality import cascade_delete
from jobmart.plans import gold, silver
from jobmart.shared import new_path
from jobmart.sources import parted, schemas
from jobmart.streaming import levels

NOW = dt.datetime(2024, 1, 31)


@check(
    "upsert_touched",
    """WITH changes AS (SELECT o_custkey AS cust_no, concat('renamed by ', o_orderkey)
 AS cust_name, o_orderpriority AS industry_name FROM orders WHERE o_orderpriority = '1-URGENT'
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)
 = 1 UNION ALL SELECT -1 - s_suppkey, s_name, 'SUPPLY' FROM supplier)
 SELECT coalesce(c.cust_no, n.cust_no) AS cust_no,
 coalesce(n.cust_name, c.cust_name) AS cust_name,
 CASE WHEN c.cust_no IS NULL THEN n.industry_name ELSE c.industry_name END AS industry_name
 FROM company c FULL JOIN changes n ON c.cust_no = n.cust_no""",
    "company",
)
def upsert_touched(v):
    """Two merges into a stored table; the industry of a known company is kept."""
    path = new_path(v.spark, "company")
    parted.create(v.company, path, ["cust_no"], parts=32)
    urgent = v.raw("orders").where("o_orderpriority = '1-URGENT'").selectExpr(
        "o_custkey AS cust_no", "concat('renamed by ', o_orderkey) AS cust_name",
        "o_orderpriority AS industry_name", "o_orderdate", "o_orderkey",
    )
    newest = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    parted.upsert(path, urgent, update_cols=["cust_name"], newest_first=newest)
    fresh = v.raw("supplier").selectExpr(
        "-1 - s_suppkey AS cust_no", "s_name AS cust_name", "'SUPPLY' AS industry_name"
    )
    parted.upsert(path, fresh)
    return parted.read(v.spark, path)


@check(
    "load_silver_job",
    """WITH old AS (SELECT DISTINCT job_id, user_id FROM docs_id
 WHERE ts < TIMESTAMP '2024-01-12')
 SELECT d.job_id, concat('Posting ', k) AS job_name, batch_id AS source_batch_id,
 CASE WHEN o.job_id IS NOT NULL AND d.user_id % 3 = 0 THEN 'off' ELSE 'on' END AS url_status
 FROM docs_id d LEFT JOIN old o ON o.job_id = d.job_id
 QUALIFY row_number() OVER (PARTITION BY d.job_id ORDER BY ts DESC, batch_id DESC,
 event_id DESC) = 1""",
    "docs_id",
)
def load_silver_job(v):
    """A first load, a liveness check that turns postings off, and a load of all documents."""
    path, now = new_path(v.spark, "job"), instant(NOW)
    first = v.bronze.where(F.col("ingestion_timestamp") < instant(dt.datetime(2024, 1, 12)))
    silver.load_silver_job(path, first, now, parts=32)
    stored = parted.read(v.spark, path)
    off = stored.where("CAST(substring(job_id, 2) AS BIGINT) % 3 = 0").select(
        "job_id", F.lit("off").alias("url_status")
    )
    parted.upsert(path, off)
    silver.load_silver_job(path, v.bronze, now, parts=32)
    return parted.read(v.spark, path).select(
        "job_id", "job_name", "source_batch_id", "url_status"
    )


@check(
    "surrogate_key_two_loads",
    """WITH keys AS (SELECT l_partkey, l_suppkey, bool_or(l_returnflag = 'R') AS early
 FROM lineitem GROUP BY 1, 2)
 SELECT l_partkey, l_suppkey, row_number() OVER (ORDER BY CASE WHEN early THEN 0 ELSE 1 END,
 l_partkey, l_suppkey) AS stat_id FROM keys""",
)
def surrogate_key_two_loads(v):
    """Ids of the first load stay, keys of the second continue after the largest."""
    keys, lines = ["l_partkey", "l_suppkey"], v.raw("lineitem")
    none = lines.select(*keys, F.lit(0).cast("long").alias("stat_id")).where("false")
    first = numbering.allocate_ids(none, lines.where("l_returnflag = 'R'"), keys, "stat_id")
    return numbering.allocate_ids(first, lines, keys, "stat_id")


@check(
    "salary_stat_ids",
    """WITH k AS (SELECT category_code, salary_type_code, region_group, exp_level, job_count,
 salary_type_code = 10 AS early FROM stat)
 SELECT row_number() OVER (ORDER BY CASE WHEN early THEN 0 ELSE 1 END, category_code,
 salary_type_code, region_group, exp_level) AS stat_id, category_code, salary_type_code,
 region_group, exp_level, job_count FROM k""",
    "stat",
)
def salary_stat_ids(v):
    """Monthly salaries are stored first; a later load brings all and keeps their ids."""
    stat = gold.salary_stat(cards_of(v), bridge_of(v))
    none = stat.withColumn("stat_id", F.lit(0).cast("long")).where("false")
    first = gold.salary_stat_table(stat.where("salary_type_code = 10"), none)
    return gold.salary_stat_table(stat, first).select(
        "stat_id", "category_code", "salary_type_code", "region_group", "exp_level", "job_count"
    )


@check(
    "salary_median",
    """SELECT category_code, salary_type_code, region_group, exp_level,
 median(CAST(lo + hi AS DOUBLE) / 2) AS true_median FROM parsed GROUP BY ALL""",
    "parsed",
)
def salary_median(v):
    return gold.salary_medians(cards_of(v), bridge_of(v))


@check(
    "price_median",
    "SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1",
)
def price_median(v):
    """Three groups hold all rows; each spans many range partitions."""
    from jobmart.operators.statistics import exact_medians

    return exact_medians(v.raw("lineitem"), ["l_returnflag"], "l_extendedprice")


@check(
    "stream_three_levels",
    "SELECT user_id, event_id, event_type, value, props, epoch_us(ts) AS ts FROM events QUALIFY"
    " row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def stream_three_levels(v):
    """Daily folders streamed one at a time into levels of two loads."""
    events = v.raw("events")
    landed = new_path(v.spark, "landed")
    days = events.withColumn("day", F.to_date("ts"))
    days.repartition("day").write.partitionBy("day").parquet(landed)
    stream = (
        v.spark.readStream.schema(events.schema)
        .option("maxFilesPerTrigger", 4).parquet(landed).select(*events.columns)
    )
    target, progress = new_path(v.spark, "levels"), new_path(v.spark, "progress")

    def newest():
        return [F.desc("ts"), F.desc("event_id")]

    levels.start(stream, target, progress, ["user_id"], newest, fanout=2).awaitTermination()
    return levels.read(v.spark, target, events.schema, ["user_id"], newest)


_RAW = """SELECT nullif(p_partkey % 11, 0) * 1000000 + p_partkey AS category_code,
 CASE WHEN p_partkey % 13 = 0 THEN repeat(p_name, 40) ELSE p_name END AS category_name,
 CASE WHEN p_partkey % 7 = 0 THEN 'unknown' WHEN p_partkey % 5 = 0 THEN NULL
 ELSE CAST(p_size AS {text}) END AS job_count, '0.5' AS category_job_ratio, p_type AS note
 FROM part"""


@check(
    "conform_quarantine",
    f"""WITH raw AS ({_RAW.format(text="VARCHAR")}), why AS (SELECT
 concat_ws('|', CASE WHEN category_code IS NULL THEN 'null:category_code' END,
 CASE WHEN length(category_name) > 100 THEN 'length:category_name' END,
 CASE WHEN job_count IS NULL THEN 'null:job_count' WHEN try_cast(job_count AS BIGINT) IS NULL
 THEN 'type:job_count' END) AS reasons, try_cast(job_count AS BIGINT) AS n FROM raw)
 SELECT reasons, reasons = '' AS accepted, count(*) AS found, sum(n)::BIGINT AS job_count
 FROM why GROUP BY 1, 2""",
)
def conform_quarantine(v):
    raw = v.raw("part")
    raw.createOrReplaceTempView("part_raw")
    rows = v.spark.sql(_RAW.format(text="STRING").replace("FROM part", "FROM part_raw"))
    path = new_path(v.spark, "landing")
    schemas.land(rows, "fact_job_ratio", path)
    good = schemas.landed(v.spark, "fact_job_ratio", path).select(
        F.lit("").alias("reasons"), F.lit(True).alias("accepted"), "job_count"
    )
    bad = schemas.landed(v.spark, "fact_job_ratio", path, accepted=False).select(
        F.array_join("reasons", "|").alias("reasons"), F.lit(False).alias("accepted"), "job_count"
    )
    return good.unionByName(bad).groupBy("reasons", "accepted").agg(
        F.count(F.lit(1)).alias("found"), F.sum("job_count").alias("job_count")
    )


@check(
    "cascade_graph",
    """WITH n AS (SELECT * FROM nation WHERE n_regionkey <> 2),
 c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
 s AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n)),
 o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
 l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)
 AND l_suppkey IN (SELECT s_suppkey FROM s))
 SELECT 'customer' AS name, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM c
 UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM l
 UNION ALL SELECT 'nation', count(*), sum(n_nationkey)::BIGINT FROM n
 UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM o
 UNION ALL SELECT 'region', count(*), sum(r_regionkey)::BIGINT FROM region
 WHERE r_regionkey <> 2
 UNION ALL SELECT 'supplier', count(*), sum(s_suppkey)::BIGINT FROM s""",
)
def cascade_graph(v):
    """A region goes; four generations of tables follow, one of them by two ways."""
    keys = {
        "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey",
        "supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "l_orderkey",
    }
    references = {
        "nation": {"n_regionkey": ("region", "r_regionkey")},
        "customer": {"c_nationkey": ("nation", "n_nationkey")},
        "supplier": {"s_nationkey": ("nation", "n_nationkey")},
        "orders": {"o_custkey": ("customer", "c_custkey")},
        "lineitem": {
            "l_orderkey": ("orders", "o_orderkey"), "l_suppkey": ("supplier", "s_suppkey"),
        },
    }
    tables = {name: v.raw(name) for name in keys}
    lost = v.raw("region").where("r_regionkey = 2").select("r_regionkey")
    left = cascade_delete(tables, references, {"region": lost})
    parts = [
        left[name].agg(F.count(F.lit(1)).alias("n"), F.sum(key).cast("long").alias("keys"))
        .select(F.lit(name).alias("name"), "n", "keys")
        for name, key in keys.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
