"""Check queries over the star-schema tables, each with the SQL that must agree with it."""

from __future__ import annotations


def _load():
    from jobmart.checks import (  # noqa: F401
        gold_checks,
        ingest_checks,
        merge_checks,
        read_checks,
        registry,
        serve_checks,
        silver_checks,
        stored_checks,
    )

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().ORACLE)
