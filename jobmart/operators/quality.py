"""Declared constraints as checks, and referential clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmart.shared import materialize


def constraint_report(
    df: DataFrame,
    key: Sequence[str] = (),
    not_null: Sequence[str] = (),
    max_length: Mapping[str, int] | None = None,
    foreign: Mapping[str, tuple[DataFrame, str]] | None = None,
) -> DataFrame:
    """One row per declared constraint with the number of rows or keys that break it."""
    parts: list[DataFrame] = []
    row_checks = {f"not_null:{c}": F.col(c).isNull() for c in not_null}
    row_checks |= {f"length:{c}": F.length(c) > n for c, n in (max_length or {}).items()}
    if row_checks:
        counted = df.agg(*[F.count_if(cond).alias(name) for name, cond in row_checks.items()])
        parts.append(
            counted.unpivot([], list(row_checks), "check_name", "violations")
        )
    if key:
        repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        name = "unique:" + ",".join(key)
        parts.append(
            repeated.agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit(name).alias("check_name"), "violations"
            )
        )
    for column, (parent, parent_key) in (foreign or {}).items():
        refs = parent.select(F.col(parent_key).alias(column))
        orphans = df.where(F.col(column).isNotNull()).join(refs, column, "left_anti")
        parts.append(
            orphans.agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit(f"foreign:{column}").alias("check_name"), "violations"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def cascade_children(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent still exists."""
    return children.join(parents.select(key), key, "left_semi")


def cascade_delete(
    tables: Mapping[str, DataFrame],
    references: Mapping[str, Mapping[str, tuple[str, str]]],
    removed: Mapping[str, DataFrame],
) -> dict[str, DataFrame]:
    """All tables after rows were deleted with everything that refers to them.

    ``references[child][column] = (parent, key)`` are the declared references, in any graph:
    children of children follow to any depth, and tables that refer to themselves or to one
    another are followed until nothing more goes. ``removed`` holds, by table, the rows to
    delete, with the columns that name them. A NULL reference refers to nothing and stays; so
    does one to a key that was not there before, which is a violation and not a cascade.
    """
    named: dict[str, list[str]] = {}
    for columns in references.values():
        for parent, key in columns.values():
            if parent in tables and key not in named.setdefault(parent, []):
                named[parent].append(key)

    def lost_rows(child: str, lost: Mapping[str, DataFrame]) -> list[DataFrame]:
        """Rows of ``child`` that refer to a lost key, once for each reference."""
        return [
            tables[child].join(lost[parent].select(F.col(key).alias(column)), column, "left_semi")
            for column, (parent, key) in references.get(child, {}).items()
            if parent in lost
        ]

    # of the lost rows only the keys that others refer to are carried along
    fresh = {
        name: tables[name].join(rows, rows.columns, "left_semi").select(*named[name]).distinct()
        for name, rows in removed.items()
        if name in named
    }
    gone = dict(fresh)
    while fresh:
        found = {}
        for child in named:
            parts = [rows.select(*named[child]) for rows in lost_rows(child, fresh)]
            if parts:
                keys = reduce(DataFrame.unionByName, parts).distinct()
                keys = keys.subtract(gone[child]) if child in gone else keys
                # written once: the next generation and the deletion both read it
                found[child] = materialize(keys, "cascade")
        fresh = {child: keys for child, keys in found.items() if not keys.isEmpty()}
        for child, keys in fresh.items():
            gone[child] = gone[child].unionByName(keys) if child in gone else keys
    out = {}
    for name, rows in tables.items():
        if name in removed:
            rows = rows.join(removed[name], removed[name].columns, "left_anti")
        for column, (parent, key) in references.get(name, {}).items():
            if parent in gone:
                lost = gone[parent].select(F.col(key).alias(column))
                rows = rows.join(lost, column, "left_anti")
        out[name] = rows.select(*tables[name].columns)
    return out
