"""Check queries: merge rules, constraints, numbering."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobmart.checks.registry import check
from jobmart.functions.convert import instant
from jobmart.operators import merge, numbering, sequence
from jobmart.operators.quality import cascade_children, constraint_report
from jobmart.sources.schemas import declared_report

NOW = dt.datetime(2024, 1, 31)

# Changes to the company table: customers by their newest order, and suppliers as new rows.
_CHANGES = """changes AS (SELECT o_custkey AS cust_no, concat('renamed by ', o_orderkey)
 AS cust_name, o_orderpriority AS industry_name FROM orders QUALIFY row_number() OVER
 (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
 UNION ALL SELECT -1 - s_suppkey, s_name, 'SUPPLY' FROM supplier)"""


def _changes(v):
    """Every order as a change of its customer; the newest order of a customer wins."""
    updates = v.raw("orders").selectExpr(
        "o_custkey AS cust_no",
        "concat('renamed by ', o_orderkey) AS cust_name",
        "o_orderpriority AS industry_name",
        "o_orderdate AS at",
        "o_orderkey AS seq",
    )
    fresh = v.raw("supplier").selectExpr(
        "-1 - s_suppkey AS cust_no", "s_name AS cust_name", "'SUPPLY' AS industry_name",
        "CAST(NULL AS TIMESTAMP_NTZ) AS at", "s_suppkey AS seq",
    )
    return updates.unionByName(fresh)


_NEWEST_CHANGE = ("at", "seq")


def _newest():
    return [F.col(c).desc_nulls_last() for c in _NEWEST_CHANGE]


@check(
    "upsert_merge",
    f"""WITH {_CHANGES} SELECT coalesce(c.cust_no, n.cust_no) AS cust_no,
 coalesce(n.cust_name, c.cust_name) AS cust_name,
 coalesce(n.industry_name, c.industry_name) AS industry_name
 FROM company c FULL JOIN changes n ON c.cust_no = n.cust_no""",
    "company",
)
def upsert_merge(v):
    return merge.upsert(v.company, _changes(v), ["cust_no"], newest_first=_newest())


@check(
    "upsert_chosen_columns",
    f"""WITH {_CHANGES} SELECT coalesce(c.cust_no, n.cust_no) AS cust_no,
 CASE WHEN c.cust_no IS NULL THEN n.cust_name ELSE c.cust_name END AS cust_name,
 coalesce(n.industry_name, c.industry_name) AS industry_name
 FROM company c FULL JOIN changes n ON c.cust_no = n.cust_no""",
    "company",
)
def upsert_chosen_columns(v):
    return merge.upsert(
        v.company, _changes(v), ["cust_no"], update_cols=["industry_name"],
        newest_first=_newest(),
    )


@check(
    "upsert_partial",
    f"""WITH {_CHANGES} SELECT coalesce(c.cust_no, n.cust_no) AS cust_no,
 coalesce(n.cust_name, c.cust_name) AS cust_name,
 coalesce(n.industry_name, c.industry_name) AS industry_name
 FROM company c FULL JOIN changes n ON c.cust_no = n.cust_no""",
    "company",
)
def upsert_partial(v):
    """Two passes with disjoint columns end where one pass with all columns does."""
    core = _changes(v).select("cust_no", "industry_name", *_NEWEST_CHANGE)
    text = _changes(v).select("cust_no", "cust_name", *_NEWEST_CHANGE)
    first = merge.upsert(v.company, core, ["cust_no"], newest_first=_newest())
    return merge.upsert(first, text, ["cust_no"], newest_first=_newest())


@check(
    "insert_ignore",
    """SELECT cust_no, cust_name, industry_name FROM company UNION ALL
 SELECT DISTINCT s_suppkey + 1000, CAST(NULL AS VARCHAR), 'SUPPLY' FROM supplier
 WHERE s_suppkey + 1000 NOT IN (SELECT cust_no FROM company)""",
    "company",
)
def insert_ignore(v):
    fresh = v.raw("supplier").selectExpr("s_suppkey + 1000 AS cust_no", "'SUPPLY' AS industry_name")
    return merge.insert_ignore(v.company, fresh.unionByName(fresh), ["cust_no"])


@check(
    "keyed_update",
    """SELECT o.o_orderkey AS job_id, CASE WHEN l.l_orderkey IS NOT NULL THEN 'COMPLETED'
 ELSE 'PENDING' END AS status FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey
 FROM lineitem WHERE l_returnflag = 'R') l ON o.o_orderkey = l.l_orderkey""",
)
def keyed_update(v):
    ids = v.raw("orders").selectExpr("o_orderkey AS job_id", "'PENDING' AS status")
    landed = v.raw("lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS job_id")
    done = landed.distinct().withColumn("status", F.lit("COMPLETED"))
    return merge.keyed_update(ids, done, ["job_id"], ["status"])


@check(
    "keyed_update_first",
    """SELECT o_orderkey AS seq, o_custkey AS job_id, CASE WHEN c_custkey IS NOT NULL AND
 o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'COMPLETED' ELSE 'PENDING'
 END AS status FROM orders LEFT JOIN (SELECT c_custkey FROM customer
 WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey""",
)
def keyed_update_first(v):
    """Only the first registered row of an id changes, as the earlier loader had it."""
    ids = v.raw("orders").selectExpr(
        "o_orderkey AS seq", "o_custkey AS job_id", "'PENDING' AS status"
    )
    done = v.company.where("industry_name = 'BUILDING'").selectExpr(
        "cust_no AS job_id", "'COMPLETED' AS status"
    )
    return merge.keyed_update(ids, done, ["job_id"], ["status"], first_only_by=["seq"])


@check(
    "append_union",
    "SELECT cust_no, cust_name, industry_name FROM company UNION ALL SELECT s_suppkey, s_name,"
    " NULL FROM supplier",
    "company",
)
def append_union(v):
    rows = v.raw("supplier").selectExpr("s_suppkey AS cust_no", "s_name AS cust_name")
    return merge.append_rows(v.company, rows)


@check(
    "replace_table",
    "SELECT c.job_id, category_code, category_description AS category_name FROM job_category c"
    " JOIN job j ON c.job_id = j.job_id WHERE url_status = 'on'",
    "job_category job",
)
def replace_table(v):
    from jobmart.plans.gold import bridge_category

    return merge.replace_table(bridge_category(v.job_category, v.job), "bridge")


@check(
    "zero_then_merge",
    """SELECT p_partkey AS category_code, p_name AS category_name, coalesce(n, 0) AS job_count,
 concat('about ', p_type) AS category_desc FROM part LEFT JOIN (SELECT l_partkey,
 count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40
 GROUP BY 1) ON p_partkey = l_partkey""",
)
def zero_then_merge(v):
    stored = v.raw("part").selectExpr(
        "p_partkey AS category_code", "p_name AS category_name",
        "CAST(p_size AS BIGINT) AS job_count", "concat('about ', p_type) AS category_desc",
    )
    fresh = (
        v.raw("lineitem").where("l_returnflag = 'R' AND l_quantity > 40")
        .select(F.col("l_partkey").alias("category_code"), "l_orderkey").distinct()
        .groupBy("category_code").agg(F.count(F.lit(1)).alias("job_count"))
    )
    return merge.zero_then_merge(stored, fresh, ["category_code"], ["job_count"])


@check(
    "constraint_report",
    """SELECT 'unique:l_orderkey,l_linenumber' AS check_name, count(*) AS violations FROM
 (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
 UNION ALL SELECT 'not_null:l_shipdate', count(*) FROM lineitem WHERE l_shipdate IS NULL
 UNION ALL SELECT 'length:l_returnflag', count(*) FROM lineitem WHERE length(l_returnflag) > 1
 UNION ALL SELECT 'foreign:l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN
 (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
 UNION ALL SELECT 'foreign:l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN
 (SELECT p_partkey FROM part)""",
)
def constraints(v):
    open_orders = v.raw("orders").where("o_orderstatus <> 'F'")
    return constraint_report(
        v.raw("lineitem"),
        key=["l_orderkey", "l_linenumber"],
        not_null=["l_shipdate"],
        max_length={"l_returnflag": 1},
        foreign={
            "l_orderkey": (open_orders, "o_orderkey"),
            "l_partkey": (v.raw("part"), "p_partkey"),
        },
    )


@check(
    "declared_constraints",
    """SELECT 'not_null:' || unnest(['job_id', 'category_code']) AS check_name,
 CAST(0 AS BIGINT) AS violations
 UNION ALL SELECT 'unique:job_id,category_code', 0
 UNION ALL SELECT 'length:' || unnest(['job_id', 'category_code', 'category_description']), 0
 UNION ALL SELECT 'foreign:job_id', count(*) FROM job_category c WHERE job_id NOT IN
 (SELECT job_id FROM job WHERE url_status = 'on')""",
    "job_category job",
)
def declared_constraints(v):
    parents = v.job.where("url_status = 'on'")
    return declared_report("job_category", {"job_category": v.job_category, "job": parents})


@check(
    "cascade_semi",
    "SELECT c.job_id, c.skill_code FROM job_skill c SEMI JOIN (SELECT job_id FROM job"
    " WHERE url_status = 'on') j ON c.job_id = j.job_id",
    "job_skill job",
)
def cascade_semi(v):
    kept = v.job.where("url_status = 'on'")
    return cascade_children(v.job_skill, kept, "job_id").select("job_id", "skill_code")


@check(
    "surrogate_key",
    """SELECT row_number() OVER (ORDER BY l_partkey, l_suppkey) AS stat_id, l_partkey,
 l_suppkey, n FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
)
def surrogate_key(v):
    facts = v.raw("lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n")
    )
    return numbering.surrogate_key(facts, ["l_partkey", "l_suppkey"], "stat_id")


@check(
    "batch_index",
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts,
 event_id) AS record_index, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 10)
 AS BIGINT) AS batch_no FROM events""",
)
def batch_index(v):
    rows = v.raw("events").select("event_id", "user_id", "event_type", "ts")
    indexed = numbering.number_within(rows, ["event_type"], ["ts", "event_id"], "record_index")
    return numbering.batches_of(indexed, ["event_id"], 10).drop("event_type", "ts")


@check(
    "positional_join",
    """SELECT row_no, job_id, event_id FROM (SELECT row_number() OVER (ORDER BY o_orderdate,
 o_orderkey) AS row_no, o_orderkey AS job_id FROM orders) JOIN (SELECT row_number() OVER
 (ORDER BY ts, event_id) AS row_no, event_id FROM events) USING (row_no)""",
)
def positional_join(v):
    jobs = v.raw("orders").selectExpr("o_orderkey AS job_id", "o_orderdate")
    details = v.raw("events").select("event_id", "ts")
    paired = numbering.positional_join(
        jobs, details, ["o_orderdate", "job_id"], ["ts", "event_id"]
    )
    return paired.select("row_no", "job_id", "event_id")


@check(
    "skip_head",
    """SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id
 ORDER BY ts, event_id) > 2""",
)
def skip_head(v):
    rows = v.raw("events").select("user_id", "event_id", "ts")
    return sequence.skip_head(rows, ["user_id"], ["ts", "event_id"], 2).drop("ts")


@check(
    "take_while",
    """SELECT user_id, event_id, event_type FROM events QUALIFY max(CASE WHEN
 event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
 ROWS UNBOUNDED PRECEDING) = 0""",
)
def take_while(v):
    rows = v.raw("events").select("user_id", "event_id", "event_type", "ts")
    kept = sequence.take_while(
        rows, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error"
    )
    return kept.drop("ts")


@check(
    "first_occurrence",
    """SELECT props, user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY
 props ORDER BY user_id, ts, event_id) = 1""",
)
def first_occurrence(v):
    rows = v.raw("events").select("props", "user_id", "event_id", "ts")
    return sequence.first_occurrence(rows, ["props"], ["user_id", "ts", "event_id"]).drop("ts")


@check(
    "new_ids_antijoin",
    """SELECT DISTINCT o_custkey AS job_id FROM orders WHERE o_custkey NOT IN
 (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def new_ids_antijoin(v):
    seen = v.company.where("industry_name = 'BUILDING'").selectExpr("cust_no AS job_id")
    return v.raw("orders").selectExpr("o_custkey AS job_id").distinct().join(
        seen, "job_id", "left_anti"
    )


@check(
    "default_timestamps",
    """SELECT p_name AS raw_skill_name, epoch_us(TIMESTAMP '2024-01-31') AS create_time
 FROM part GROUP BY 1""",
)
def default_timestamps(v):
    names = v.raw("part").selectExpr("p_name AS raw_skill_name").distinct()
    return names.withColumn("create_time", instant(NOW))
