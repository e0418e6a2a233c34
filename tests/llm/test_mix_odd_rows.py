"""Mixing on rows without ids, clashing columns, long and empty texts, against a plain version."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobmart.llm import mixing


def _place(row, epoch, seed=7):
    name = row["doc_id"]
    if name is None:
        name = "text " + hashlib.md5((row["text"] or "").encode()).hexdigest()
    return hashlib.md5(f"{seed}:{epoch}:{name}".encode()).hexdigest()


def _plain(rows, budgets):
    """Whole epochs, then the longest prefix of the next one that fits, leaf by leaf."""
    taken = []
    leaves = defaultdict(list)
    for row in rows:
        leaves[row["lang"]].append(row)
    for lang, some in leaves.items():
        size = lambda r: len((r["text"] or "").split())
        total, budget = sum(map(size, some)), budgets[lang]
        full = budget // total if total else 0
        taken += [(r["k"], e) for e in range(full) for r in some]
        rest, used = budget - full * total, 0
        groups = defaultdict(list)
        for r in some:
            groups[_place(r, full)].append(r)
        for place in sorted(groups):
            used += sum(map(size, groups[place]))
            if used > rest or not rest:
                break
            taken += [(r["k"], full) for r in groups[place]]
    return sorted(taken)


@pytest.fixture(scope="module")
def rows():
    out = []
    for k in range(240):
        doc_id = None if k % 3 == 0 else k // 4
        text = None if k % 17 == 0 else "" if k % 19 == 0 else f"w{k % 40} " * (1 + k % 13)
        out.append({"k": k, "doc_id": doc_id, "text": text, "lang": [None, "en", "de"][k % 3]})
    out.append({"k": 240, "doc_id": 999, "text": "long " * 5000, "lang": "fr"})
    return out


SCHEMA = "k long, doc_id long, text string, lang string"


@pytest.mark.parametrize("share,epochs", [(0.5, 1), (1.6, 3)])
def test_against_plain_prefixes(spark, rows, share, epochs):
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    leaves = mixing.plan(docs, ["lang"], share=share, epochs=epochs)
    names = {mixing.node(x): x for x in (None, "en", "de", "fr")}
    budgets = {names[r["path"]]: r["budget"] for r in leaves.collect()}
    got = mixing.selected(docs, leaves, ["lang"]).select("k", "epoch").collect()
    assert sorted(map(tuple, got)) == _plain(rows, budgets)


def test_rows_without_ids_are_taken(spark):
    docs = spark.createDataFrame(
        [(k, None, f"a{k} b c d", "en") for k in range(50)], SCHEMA
    )
    leaves = mixing.plan(docs, ["lang"], budget=100)
    assert mixing.selected(docs, leaves, ["lang"]).count() == 25


def test_clashing_columns(spark, rows):
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    clash = ["full", "cutoff", "epoch", "path", "_path", "tokens", "budget", "place", "rest", "_leaf0"]
    odd = docs.select("*", *[F.lit(-1).alias(c) for c in clash])
    leaves = mixing.plan(odd, ["lang"], share=0.5)
    found = mixing.selected(odd, leaves, ["lang"])
    plain = mixing.selected(docs, mixing.plan(docs, ["lang"], share=0.5), ["lang"])
    assert sorted(map(tuple, found.select("k", "epoch").collect())) == sorted(
        map(tuple, plain.select("k", "epoch").collect())
    )
    assert found.where("full = -1 AND cutoff = -1 AND _leaf0 = -1").count() == found.count()
    named = docs.withColumnRenamed("lang", "tokens")  # a level with the name of a measure
    again = mixing.selected(named, mixing.plan(named, ["tokens"], share=0.5), ["tokens"])
    assert again.count() == found.count()
