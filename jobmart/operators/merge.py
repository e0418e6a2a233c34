"""Merge rules over tables: each returns the new content of the target.

The input tables are never written in place. ``replace_table`` writes the new content to a
fresh folder, after which the caller points its readers there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmart.operators.latest import latest_rows
from jobmart.shared import materialize


def append_rows(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows, allowMissingColumns=True)


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str] | None = None,
    newest_first: Sequence[Column] | None = None,
    defaults: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Insert source rows, or update ``update_cols`` of the target row with the same key.

    Target columns outside ``update_cols`` keep their value on an update and take the source
    value on an insert (or ``defaults``, or NULL when the source lacks the column). The
    source needs unique keys unless ``newest_first`` says which of its rows wins. Source rows
    with a NULL in the key are left out: a primary key takes none, and none would ever match.
    """
    source = source.dropna(subset=list(keys))
    if newest_first is not None:
        source = latest_rows(source, keys, newest_first)
    values = [c for c in target.columns if c not in keys]
    given = [c for c in values if c in source.columns]
    updated = set(given if update_cols is None else update_cols)
    old = target.select(*keys, F.struct(F.lit(True).alias("hit"), *values).alias("_old"))
    new = source.select(*keys, F.struct(F.lit(True).alias("hit"), *given).alias("_new"))
    in_old, in_new = F.col("_old.hit").isNotNull(), F.col("_new.hit").isNotNull()

    def merged(name: str) -> Column:
        kind = target.schema[name].dataType
        old_value = F.col("_old")[name]
        if name in given:
            new_value = F.col("_new")[name].cast(kind)
        else:
            new_value = (defaults or {}).get(name, F.lit(None)).cast(kind)
        takes_new = in_new if name in updated else in_new & ~in_old
        return F.when(takes_new, new_value).otherwise(old_value).alias(name)

    joined = old.join(new, list(keys), "full_outer")
    out = joined.select(*keys, *[merged(c) for c in values])
    return out.select(*target.columns)


def insert_ignore(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    first_by: Sequence[Column] | None = None,
) -> DataFrame:
    """Add the source rows whose key is new; rows with a NULL key are not inserted.

    Of several source rows with one key the first by ``first_by`` is added, by default in the
    order of all other columns.
    """
    order = first_by or [F.col(c).asc_nulls_last() for c in source.columns if c not in keys]
    valid = latest_rows(source.dropna(subset=list(keys)), keys, order or [F.lit(0)])
    fresh = valid.join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def keyed_update(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    set_cols: Sequence[str],
    touch: Mapping[str, Column] | None = None,
    first_only_by: Sequence[str] | None = None,
    newest_first: Sequence[Column] | None = None,
) -> DataFrame:
    """Set ``set_cols`` of every target row whose key is in ``changes``.

    Of several changes of one key the first by ``newest_first`` counts, by default the one
    with the greatest values, so that a target row is never doubled.

    ``touch`` sets further columns of the matched rows. With ``first_only_by`` only the
    first matching row of a key in that order is changed.
    """
    order = newest_first or [F.col(c).desc_nulls_last() for c in set_cols]
    changes = latest_rows(changes, keys, order)
    new = changes.select(*keys, F.struct(*set_cols).alias("_new"), F.lit(True).alias("_hit"))
    base = target
    matched = F.col("_hit").isNotNull()
    if first_only_by is not None:
        position = F.struct(*first_only_by)
        first = target.groupBy(*keys).agg(F.min(position).alias("_first"))
        new = new.join(first, list(keys))
        matched = matched & (position == F.col("_first"))
    joined = base.join(new, list(keys), "left")

    def updated(name: str) -> Column:
        old = F.col(name)
        if name in set_cols:
            new_value = F.col("_new")[name].cast(target.schema[name].dataType)
        elif touch and name in touch:
            new_value = touch[name].cast(target.schema[name].dataType)
        else:
            return old
        return F.when(matched, new_value).otherwise(old).alias(name)

    return joined.select(*[updated(c) for c in target.columns])


def zero_then_merge(
    target: DataFrame,
    fresh: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    newest_first: Sequence[Column] | None = None,
) -> DataFrame:
    """Refresh ``measures`` from ``fresh`` and set them to 0 for keys it no longer has.

    Other columns of ``fresh`` replace the stored ones; columns only the target has (such as
    a description) are kept. Of several fresh rows of one key the first by ``newest_first``
    counts, by default the one with the greatest measures, then the other columns.
    """
    rest = [c for c in fresh.columns if c not in keys and c not in measures]
    order = newest_first or [F.col(c).desc_nulls_last() for c in [*measures, *rest]]
    zeroed = target.withColumns(
        {m: F.lit(0).cast(target.schema[m].dataType) for m in measures}
    )
    return upsert(zeroed, fresh, keys, newest_first=order)


def replace_table(rows: DataFrame, label: str) -> DataFrame:
    """Truncate-and-reload: write ``rows`` to a new folder and return the table read back.

    The former content stays readable until the new folder is complete, so a failed load
    leaves the old table instead of an empty one.
    """
    return materialize(rows, label)
