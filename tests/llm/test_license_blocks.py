"""License labels over runs of words against all runs, and statements that are easily confused."""

import random
import re

import pytest

from jobmart.llm import licenses
from jobmart.llm.queries import ORACLE, QUERIES

CASES = [
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("Licensed under CC BY 4.0.", "cc-by,cc-by-4.0"),
    ("Licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa-4.0"),
    ("Licensed under CC BY-NC-ND 4.0.", "cc-by"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("This library is licensed under the GNU Lesser General Public License.", "lgpl"),
    ("Released under the Apache License", "apache"),
    ("Released under the\nMIT License", "mit,mit-statement"),
    ("MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
     "of this software and associated documentation files (the", "mit,mit-notice"),
    ("// This program is free software: you can redistribute it and/or modify\n// it under the"
     " terms of the GNU General Public License as published by\n// the Free Software Foundation,"
     " either version 3 of the License, or", "gpl,gpl-3.0"),
    ("The work of this library was general and public; gnu herds are licensed, a lesser version"
     " under the hills, and the license is number 2 or 3", ""),
    ("", ""), (None, ""), ("..\n--", ""),
]


def _plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    labels, best = set(), 0.0
    for label, length, template, must, never in licenses.statements():
        for at in range(len(words)):
            run = set(words[at : at + length])
            share = len(run & set(template)) / len(template)
            if share >= 0.8 - 1e-9 and run >= set(must) and not run & set(never):
                labels.add(label)
                best = max(best, share)
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        if any(words[i : i + len(p)] == p for i in range(len(words))):
            labels.add(label)
            best = 1.0
    return ",".join(sorted(labels)), best


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    pool = [w for s in licenses.statements() for w in [*s[2], *s[4]]]
    out = [t for t, _ in CASES]
    for _ in range(150):  # statements with words lost, added and put elsewhere
        _, text = rng.choice(licenses.TEMPLATES)
        words = text.split()
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [rng.choice(pool)] * rng.randrange(2)
        out.append(" ".join(rng.choices(pool, k=9)) + rng.choice("\n ") + rng.choice("\n ").join(words))
    out.append("filler words " * 4000 + licenses.TEMPLATES[0][1] + " license the" * 4000)
    return out


def test_all_runs(spark, texts):
    docs = spark.createDataFrame(
        [(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, label string, key int"
    )
    docs = docs.selectExpr("*", "key AS hits", "key AS at", "key AS token", "key AS n_words")
    got = {r["doc_id"]: r for r in licenses.scanned(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        labels, score = _plain(text)
        assert (got[i]["labels"], got[i]["score"]) == (labels, pytest.approx(score)), text
    for i, (_, want) in enumerate(CASES):
        assert got[i]["labels"] == want


def test_sql_on_odd_texts(spark, texts, tmp_path):
    import duckdb

    folder = str(tmp_path)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op4_license_scan"](spark, folder).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE["op4_license_scan"]).fetchall()
    assert got == sorted(want, key=str)


def test_repeats_and_empty_table(spark):
    text = "Released under the MIT License."
    docs = spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string")
    assert [r["labels"] for r in licenses.scanned(docs).collect()] == ["mit,mit-statement"] * 3
    assert licenses.scanned(docs.where("false")).count() == 0
