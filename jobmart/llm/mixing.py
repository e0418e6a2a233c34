"""Mixing of sources to target weights under a budget of tokens.

Sources are leaves of a tree of columns. A node's budget is dealt to its children by their
weights; a child that has fewer tokens (over all its epochs) than its share keeps what it has,
and what is missing goes to its siblings in proportion to their weights. A node is never given
more than its leaves hold together, so what a whole family lacks has gone to the family's own
siblings one level up. Inside a leaf documents are ordered by a seeded hash, anew for each
epoch; the leaf takes whole epochs and then the documents of the next one as long as their
tokens fit.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmart.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3


def text_tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def path(levels: list[str]) -> Column:
    """The names of a node and its ancestors as JSON; a null name is its own node."""
    names = [F.coalesce(F.to_json(F.struct(F.col(c).alias("n"))), F.lit("{}")) for c in levels]
    return F.concat(F.lit("["), F.concat_ws(",", *names), F.lit("]"))


def node(*names: str | None) -> str:
    """The path of a node, for the keys of ``weights``."""
    parts = ["{}" if n is None else json.dumps({"n": n}, separators=(",", ":"), ensure_ascii=False)
             for n in names]
    return f"[{','.join(parts)}]"


def fill(nodes: DataFrame) -> DataFrame:
    """Deal each parent's budget: rows (parent, node, weight, cap, given), where ``given`` is
    the parent's, get ``budget``. Children whose share exceeds what they hold keep ``cap``;
    by rising cap per weight these come first, so one pass over the siblings finds them."""
    siblings = Window.partitionBy("parent").orderBy("_ratio", "node")
    before = siblings.rowsBetween(Window.unboundedPreceding, -1)
    onward = siblings.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("parent")
    rated = nodes.withColumn(
        "_ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(None)
    )
    open_ = rated.where(F.col("weight") > 0)
    left = F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(onward)
    full = F.col("_ratio") <= F.col("_level")
    marked = open_.withColumn("_level", level).withColumn("_full", full)
    used = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0.0)).over(whole)
    rest = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(whole)
    share = F.col("weight") * (F.col("given") - used) / rest
    return marked.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(share)).drop(
        "_ratio", "_level", "_full"
    )


def leaf_budgets(
    leaves: DataFrame, levels: list[str], budget: float, weights: dict[str, float], epochs: int
) -> DataFrame:
    """(path, tokens, budget) of each leaf, from rows of ``levels`` and ``tokens``.

    ``weights`` is a configured map from ``node(...)`` to a weight; nodes that are not named
    weigh 1. Nodes of weight 0 get nothing.
    """
    spark = leaves.sparkSession
    named = materialize(
        spark.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 1.0)],
                              "_node string, _weight double"),
        "weights",
    )
    tree = leaves.select(
        *[path(levels[: i + 1]).alias(f"p{i}") for i in range(len(levels))],
        "tokens",
        (F.col("tokens") * epochs).cast("double").alias("cap"),
    )
    # Weights of 0 anywhere above a leaf leave it nothing to give.
    for i in range(len(levels)):
        tree = tree.join(named, F.col(f"p{i}") == F.col("_node"), "left").withColumn(
            f"w{i}", F.coalesce("_weight", F.lit(1.0))
        ).drop("_node", "_weight")
    shut = F.least(*[F.col(f"w{i}") for i in range(len(levels))], F.lit(1.0)) <= 0
    tree = materialize(tree.withColumn("cap", F.when(shut, 0.0).otherwise(F.col("cap"))), "leaves")
    total = tree.agg(F.sum("cap")).first()[0] or 0.0
    given = None
    for i in range(len(levels)):
        parent = F.col(f"p{i - 1}") if i else F.lit("")
        nodes = tree.groupBy(parent.alias("parent"), F.col(f"p{i}").alias("node")).agg(
            F.max(f"w{i}").alias("weight"), F.sum("cap").alias("cap")
        )
        if i:
            nodes = nodes.join(given, "parent")
        else:
            nodes = nodes.withColumn("given", F.lit(float(min(budget, total))))
        given = fill(nodes).select(F.col("node").alias("parent"), F.col("budget").alias("given"))
    return tree.join(given, F.col(f"p{len(levels) - 1}") == F.col("parent"), "left").select(
        F.col(f"p{len(levels) - 1}").alias("path"),
        "tokens",
        F.floor(F.coalesce("given", F.lit(0.0)) + 1e-6).alias("budget"),
    )


def order_key(epoch: Column, seed: int) -> Column:
    """The place of a document in an epoch: rows with the same doc_id stand together, rows
    without one by their text."""
    nameless = F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    name = F.coalesce(F.col("doc_id").cast("string"), nameless)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name).cast("binary"))


def plan(
    docs: DataFrame, levels: list[str], budget: float | None = None, share: float = 1.0,
    weights: dict[str, float] | None = None, epochs: int = 1, seed: int = 7,
) -> DataFrame:
    """One row per leaf: path, tokens, budget, full (whole epochs) and ``cutoff``, the last
    place that the leaf takes from its next epoch, null if none.

    Reads doc_id, text and ``levels``; other columns may have any names. A null or empty text
    has no tokens; a leaf of such texts alone is not taken. Rows that repeat a doc_id, and rows
    without one that repeat a text, are taken or left together, at any length: a leaf stops
    before the first such group that does not fit, and what it leaves over is not dealt again.
    Nulls in ``levels`` are a name of their own. An empty table gives no rows.

    The budget is ``budget`` tokens, or ``share`` of what there is. The running sums of a leaf
    are taken in two steps, over hash ranges and then over the one range in which the budget
    ends, so that a leaf with a third of all rows is no group of one task.
    """
    names = [f"level{i}" for i in range(len(levels))]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("doc_id").isNull(), F.col("text")).alias("text"),
        path(levels).alias("path"),
        *[F.col(c).alias(n) for c, n in zip(levels, names, strict=True)],
        text_tokens().alias("tokens"),
    )
    rows = materialize(rows, "sized")
    leaves = materialize(rows.groupBy("path", *names).agg(F.sum("tokens").alias("tokens")), "leaf")
    if budget is None:
        budget = share * (leaves.agg(F.sum("tokens")).first()[0] or 0)
    budgets = leaf_budgets(leaves, names, float(budget), weights or {}, epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0)
    budgets = materialize(
        budgets.withColumn("full", full).withColumn(
            "rest", F.col("budget") - F.col("full") * F.col("tokens")
        ),
        "budgets",
    )
    open_ = budgets.where("rest > 0").select("path", "full", "rest")
    placed = rows.select("doc_id", "text", "path", "tokens").join(open_, "path")
    placed = placed.withColumn("place", order_key(F.col("full"), seed)).withColumn(
        "bucket", F.substring("place", 1, BUCKET_DIGITS)
    ).drop("text", "doc_id")
    sums = placed.groupBy("path", "bucket", "rest").agg(F.sum("tokens").alias("in_bucket"))
    upto = Window.partitionBy("path").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("in_bucket").over(upto))
    # The first range that the budget does not cover whole, and what is left for it.
    ends = sums.where("upto > rest").groupBy("path").agg(
        F.min_by(
            F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("in_bucket")).alias("room")),
            "bucket",
        ).alias("end")
    )
    ends = materialize(ends, "ends")
    inside = placed.join(ends, "path").where("bucket = end.bucket")
    running = F.sum("tokens").over(Window.partitionBy("path").orderBy("place"))
    last = (
        inside.withColumn("running", running)
        .where("running <= end.room")
        .groupBy("path")
        .agg(F.max("place").alias("last"))
    )
    # Without a document of that range the prefix ends just before it.
    cutoffs = ends.join(last, "path", "left").select(
        "path", F.coalesce("last", F.col("end.bucket")).alias("cutoff")
    )
    return materialize(budgets.join(cutoffs, "path", "left").drop("rest"), "mix")


def selected(docs: DataFrame, leaves: DataFrame, levels: list[str], seed: int = 7) -> DataFrame:
    """Rows of ``docs``, as often as the plan takes them, with ``epoch`` from 0, which takes the
    place of a column of that name; all other columns stay, whatever their names.

    The plan has one row per leaf, so it is broadcast while it is small, and texts stay where
    they are read.
    """
    names = {c.lower() for c in docs.columns}
    ours = next(c for c in (f"_leaf{i}" for i in range(len(names) + 1)) if c not in names)
    chosen = leaves.select(F.struct("path", "full", "cutoff").alias(ours))
    full = F.col(ours)["full"]
    more = F.coalesce(order_key(full, seed) <= F.col(ours)["cutoff"], F.lit(False))
    times = full + more.cast("int")
    return (
        docs.join(chosen, path(levels) == F.col(ours)["path"])
        .where(times > 0)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))
        .drop(ours)
    )
