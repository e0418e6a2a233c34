"""Byte-level BPE, whitening and collocations against libraries and brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from jobmart.llm import byte_bpe, collocations, whitening
from jobmart.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, lang string, ids string, c0 int, words string, _x int, n int"
ODD = [
    None, "", " ", "\n\n \t ", "don't I'LL 'S '", "x" * 700, "aaaaaaaaaaaaaaaa bbbb", "漢字🙂 x é́",
    "12 345٣٤ Ⅷ ½", " two  spaces   three nbsp em", "<|endoftext|>", "a\x00b﻿c",
    "\U00031350\U0001e4d0 ՘x", "naïve ÉTÉ zzqq!!! ...?", " ".join(f"w{i % 97}x{i}" for i in range(9000)),
]


def library(name):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(name))
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i % 5 == 4 else i // 2, t, None, "c", 1, "w", 2, 3) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows[:7], DOCS)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_equal_the_library(spark, odd, name):
    path, encoding = public_tokenizers.path(name), library(name)
    texts = odd.withColumn("own", F.coalesce("text", F.lit("null")))
    found = byte_bpe.encode(texts, path, public_tokenizers.PATTERN, decoded="decoded")
    assert found.columns == [*[c for c in texts.columns if c not in ("text", "ids")], "ids", "decoded"]
    rows = found.collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = "" if r["own"] == "null" else r["own"]
        assert np.frombuffer(r["ids"], "<u4").tolist() == encoding.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    again = byte_bpe.decode(found.drop("decoded"), path, name="back")
    assert {bytes(r["back"]) for r in again.collect()} == {bytes(r["decoded"]) for r in rows}


def test_words_of_many_batches_and_a_full_memory(spark, monkeypatch):
    rng = random.Random(5)
    letters = "abcdeé ,."
    texts = ["".join(rng.choice(letters) for _ in range(300)) for _ in range(60)]
    path, encoding = public_tokenizers.path("byte_bpe_50k.tiktoken"), library("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    byte_bpe.ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(byte_bpe, "ready", lambda _: None)
    for r in byte_bpe.encode(docs, path, public_tokenizers.PATTERN, most_words=900).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == encoding.encode_ordinary(texts[r["doc_id"]])


def test_empty_table_has_no_ids(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert byte_bpe.encode(odd.where("false"), path, public_tokenizers.PATTERN).count() == 0


def test_query_of_whole_table_equals_the_library(spark, data):
    encoding = library("byte_bpe_50k.tiktoken")
    got = {r["doc_id"]: r for r in QUERIES["op11_byte_bpe"](spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = encoding.encode_ordinary(text or "")
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def matrix_of(values, seed):
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))
    matrix = basis @ np.diag(values) @ basis.T
    return (matrix + matrix.T) / 2


@pytest.mark.parametrize(
    "values",
    [[5, 4, 3, 2, 1, 0.5], [3, 3, 3, 3, 3, 1], [7, 0, 0, 0, 0], [1e6, 1, 1e-3], [2, 2], [4],
     [9, 8, 7, 6, 6 - 1e-10, 1], list(np.linspace(1, 2, 48))],
)
def test_leading_pairs_equal_a_dense_solver(values):
    matrix = matrix_of(np.array(values, float), len(values))
    want = np.linalg.eigvalsh(matrix)[::-1]
    want = want[want > 1e-12 * want.sum()][:4]
    found, vectors = whitening.leading(matrix, 4)
    assert np.allclose(found, want, rtol=1e-11, atol=1e-13 * max(values))
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-10 * max(values)
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)


def test_inertia_counts_eigenvalues():
    for seed in range(30):
        values = np.random.default_rng(seed).integers(-3, 4, 9).astype(float)
        matrix = matrix_of(values, seed)
        for shift in (-2.5, -0.5, 0.5, 1.5, 3.5):
            assert whitening.inertia_above(matrix, shift) == (values > shift).sum()
    assert whitening.inertia_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.leading(np.zeros((3, 3)), 4)[0].size == 0


def test_whitening_against_numpy_with_odd_rows(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2])
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(base)]
    rows += [(i, rows[0][1], 1) for i in range(150)] + [(None, rows[1][1], 1)]
    bad = [None, [], [1.0] * 5, [1.0] * 5 + [None], [1.0] * 5 + [float("nan")], [float("inf")] * 6]
    rows += [(1000 + i, v, 1) for i, v in enumerate(bad)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    got = whitening.whitened(frame).toPandas()
    x = np.floor(256 * base).astype(np.int64)
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    want = centred @ vectors / np.sqrt(values)
    assert len(got) == 4 * 451 and set(got["n"]) == {n} and not (got["vec_id"] >= 1000).any()
    for i in (0, 1, 299):
        mine = got[got["vec_id"] == i].drop_duplicates(["component", "vec_id"]).sort_values("component")
        assert np.allclose(np.abs(mine["whitened"]), np.abs(want[i]), atol=1e-9)
        assert set(mine["deviation"]) == {int(((n * x[i] - sums) ** 2).sum())}
    assert np.allclose(got.groupby("component")["explained"].first(), values / np.trace(centred.T @ centred / n))
    assert got["identity_error"].max() < 1e-10


def test_whitening_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], kind)
    assert {r["component"] for r in whitening.whitened(line).collect()} == {1}


def brute(rows, least=3, longest=3, top=2000):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\f\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        kept = []
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        for p in candidates:
            a = f[p]
            score, _, left, right = min(
                (1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]])
                for k in range(1, len(p))
            )
            inside = any(
                len(q) > len(p) and 100 * f[q] >= 50 * a
                and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q in candidates
            )
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["A", "b", "C", "d", "é", "É", "f g", "h'"]
    rows = [
        ("".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " "]) for _ in range(40)),
         rng.choice(["en", "en", "en", None, "und", ""]))
        for _ in range(60)
    ]
    return rows + [(None, "en"), ("", None), (" \t\n..", "xx"), rows[0], rows[0], ("A b C d " * 4000, "en")]


@pytest.mark.parametrize("sample", [1, 4, 10**9])
def test_collocations_equal_brute_force(spark, texts, sample, monkeypatch):
    """With the last sample nothing is proposed: the expansion pass finds every longer phrase."""
    docs = spark.createDataFrame([(*r, 1, "p") for r in texts], "text string, lang string, size int, phrase string")
    frequent = collocations.frequent_phrases

    for size in (collocations.BATCH_BYTES, 500):

        def seeded(docs, least, longest, size=size):
            return frequent(docs, least, longest, sample=sample, batch_bytes=size)

        monkeypatch.setattr(collocations, "frequent_phrases", seeded)
        got = collocations.collocations(docs, least=3).collect()
        assert sorted(map(tuple, got)) == brute(texts)


def test_longer_phrases_and_failures(spark, texts):
    docs = spark.createDataFrame(texts, "text string, lang string")
    for sample in (2, 10**9):
        found, passes = collocations.frequent_phrases(docs, least=2, longest=5, sample=sample)
        got = {(r["lang"], r["phrase"]): r["a"] for r in found.where("size > 0").collect()}
        assert found.where("size > 0").count() == len(got) and passes == 2
        want = Counter()
        for text, lang in texts:
            for piece in re.split("[.,;:!?\n\x0b\f\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
                w = re.findall("[^ \t]+", piece)
                for k in range(1, 6):
                    for i in range(len(w) - k + 1):
                        want["und" if lang is None else lang, " ".join(w[i : i + k])] += 1
        assert got == {p: a for p, a in want.items() if a >= 2}


def test_scores_beyond_64_bits(spark):
    big = 10**12
    rows = [("x", 1, "a", 3 * big), ("x", 1, "b", 2 * big), ("x", 2, "a b", big)]
    frequent = spark.createDataFrame(rows, "lang string, size int, phrase string, a long")
    row = collocations.scored(frequent).first()
    assert (row["l"], row["r"], row["score"]) == (3 * big, 2 * big, 10**6 // 6)


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_collocation_query_equals_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    df = QUERIES["op13_phrase_collocations"](spark, data)
    want = con.execute(ORACLE["op13_phrase_collocations"])
    assert [d[0] for d in want.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
