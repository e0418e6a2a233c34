"""The corpus operators against brute force, round trips and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobmart.llm import (
    bm25, licenses, line_dedup, mixing, near_dedup, packing, pu_classifier, quality_rules,
    suffix_dedup, token_store,
)
from jobmart.llm.queries import ORACLE, QUERIES, vocabulary
from jobmart.llm.tokens import Encoder
from jobmart.shared import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, data int, doc string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated texts, ties, columns with clashing names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    more = base + " rho sigma tau upsilon phi chi psi omega and so on until the line is long."
    rows = [
        (1, more), (2, more), (2, more), (3, None), (4, ""), (5, LONG), (None, more), (6, "x"),
        (7, "É " + more + " Ünïcode 🙂 " + base), (8, "Released under the MIT License.\n" + base),
        (9, "a b " * 40), (10, "z" * 400), (4, " \n\t "),
    ]
    return spark.createDataFrame(
        [(i, t, None, None if k % 3 else "s", None, 1, "d") for k, (i, t) in enumerate(rows)], DOCS
    )


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def small(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


OPERATORS = {
    "rules": lambda d: quality_rules.judged(d),
    "licenses": licenses.scanned,
    "near": lambda d: near_dedup.near_duplicates(d),
    "lines": lambda d: line_dedup.cleaned(d),
    "suffixes": lambda d: suffix_dedup.deduplicated(d),
    "packing": lambda d: packing.pack(d, vocabulary()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_table(odd, empty, name):
    rows = OPERATORS[name](odd).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None}
    if name != "packing":
        assert len(rows) == odd.count()
    assert OPERATORS[name](empty).count() == 0


def test_encoder_equals_library():
    e = Encoder(vocabulary())
    texts = ["", " ", "́a b́", "<|endoftext|>x", "İI ſ K ﬁ", "\x1c a\x0bb", "漢字🙂 x",
             "don't I'LL 'S '", "x" * 3000, "ẹ́ ̣", "naïve,ÉTÉ!! a_b 12.5"]
    assert e.by_word and e.encode([t.encode() for t in texts]) == e._whole(texts)


def test_token_store_round_trip(spark, odd, empty):
    path = new_path(spark, "store")
    token_store.write_store(odd, path, vocabulary(), end_id=1)
    e = Encoder(vocabulary())
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for doc_id, text in rows:
        ids = e._whole([text])[0] + (1).to_bytes(4, "little")
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = [tuple(r) for r in token_store.scan_store(spark, path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    found = token_store.read_keys(spark, path, [2, 7, 12345]).collect()
    assert Counter(r["doc_id"] for r in found) == {2: 2, 7: 1}
    path = new_path(spark, "store")
    token_store.write_store(empty, path, vocabulary())
    assert token_store.scan_store(spark, path).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    slots = token_store.PerfectHash.build(keys).slots(keys)
    assert sorted(slots) == list(range(len(keys)))


def test_packing_is_tight_and_whole(small):
    rows = packing.pack(small, vocabulary()).toPandas()
    placed = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length
    assert placed.sum().max() <= 2048
    by = rows.sort_values(["sequence_id", "offset"])
    assert (by.offset == by.groupby("sequence_id").length.cumsum() - by.length).all()
    e = Encoder(vocabulary())
    for r in small.collect():
        assert rows[rows.doc_id == r["doc_id"]].length.sum() == len(e._whole([r["text"]])[0]) // 4 + 1
    assert rows.sequence_id.nunique() <= max(
        math.ceil(rows.length.sum() / 2048), (rows.length > 1024).sum()
    ) + 2


def test_swaps_empty_a_bin():
    lengths = [6, 5, 5, 4, 3, 3, 2, 2]
    bins = packing.pack_shard(lengths, 10)
    assert len(set(bins)) == 3
    poor = packing.pack_shard([6, 3, 5, 4, 2], 10, groups=[0, 0, 1, 1, 2])
    assert len(set(poor)) <= 3 and sorted(np.bincount(poor, [6, 3, 5, 4, 2]))[-1] <= 10


def test_suffix_dedup_against_brute_force(small, odd):
    for docs in (small, odd):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, want = set(), []
        for doc_id, text in rows:
            b = text.encode()
            mark = np.zeros(len(b) + 1, int)
            for p in range(len(b) - 99):
                w = b[p : p + 100]
                if w in seen:
                    mark[p] += 1
                    mark[p + 100] -= 1
                seen.add(w)
            gone = np.cumsum(mark)[:-1] > 0
            kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
            runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
            want.append((doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
        got = suffix_dedup.deduplicated(docs).drop("kept")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_all_pairs(small, size):
    of = {r["doc_id"]: shingles(r["text"], size) for r in small.collect()}
    label = {i: i for i in of}
    ids = sorted(of)
    for a in ids:
        for b in ids:
            if a < b and of[a] and 100 * len(of[a] & of[b]) >= 80 * len(of[a] | of[b]):
                x, y = sorted((label[a], label[b]))
                label = {i: x if c == y else c for i, c in label.items()}
    got = near_dedup.near_duplicates(small, size=size).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == label
    assert all(r["n_shingles"] == len(of[r["doc_id"]]) for r in got)


def test_bm25_against_scoring_all(spark, data, small, empty):
    got = defaultdict(list)
    for r in QUERIES["op1_bm25_search"](spark, data).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    words = {r["doc_id"]: re.findall(rb"[0-9a-z\x80-\xff]+", r["text"].encode().lower())
             for r in small.collect()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    times = {i: Counter(w) for i, w in words.items()}
    df = Counter(t for c in times.values() for t in c)
    for q in (i for i in words if i % 50 == 0):
        scored = []
        for i in words:
            score = sum(
                m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * times[i][t] * 2.2
                / (times[i][t] + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
                for t, m in times[q].items() if t in times[i]
            )
            if score:
                scored.append((-round(score, 6), i))
        want = sorted(scored)[:10]
        assert [i for i, _ in got[q]] == [i for _, i in want]
        assert np.allclose([s for _, s in got[q]], [-s for s, _ in want], atol=2e-6)
    asked = empty.select(F.col("doc_id").alias("query_id"), "text")
    assert bm25.top_k(bm25.build_index(empty), asked).count() == 0


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = QUERIES["op2_pu_quality"](spark, folder).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.97


def test_classifier_without_labels(spark, odd, empty):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    rows = pu_classifier.scored(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert pu_classifier.scored(empty, labels).count() == 0


def test_bad_host_is_rejected_small_host_is_not(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "bad", good if i % 10 == 0 else "too short") for i in range(400)]
    rows += [(1000 + i, "good", good) for i in range(400)] + [(2000, "tiny", good)]
    rows += [(2001, "tiny", "short"), (2002, None, good)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs).collect()}
    assert not kept[0] and kept[1000] and kept[2000] and not kept[2001] and kept[2002]


def test_repeated_words():
    assert quality_rules.repeated("a b c d e x a b c d e".encode().split()) == 10
    assert quality_rules.repeated("a a a a a a".encode().split()) == 6
    assert quality_rules.repeated([]) == 0


def test_license_templates_against_all_templates(spark, small):
    odd_lines = ["licensed UNDER the apache license version 2", "CC-BY", "mit licence", "",
                 "under the GNU lesser general public license this library is licensed", None]
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd_lines)], "doc_id long, text string")
    docs = small.select("doc_id", "text").unionByName(extra)
    got = {r["doc_id"]: r for r in licenses.scanned(docs).collect()}
    for r in docs.collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
        words = re.findall(pattern, low)
        places, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        labels, best = set(base), 0.0
        for label, length, template, must, never in licenses.statements():
            if not set(must) <= set(words):
                continue
            for at in range(len(words)):
                run = set(words[at : at + length])
                share = len(run & set(template)) / len(template)
                if share >= licenses.CONTAINMENT - 1e-9 and run >= set(must) and not run & set(never):
                    labels.add(label)
                    best = max(best, share)
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"]) == (len(words), len(places))
        assert (g["first_word"], g["last_word"]) == (min(places, default=None), max(places, default=None))
        assert g["labels"] == ",".join(sorted(labels)) and g["base_labels"] == ",".join(sorted(base))
        assert abs(g["score"] - (1.0 if places else best)) < 1e-9


def test_line_dedup_against_brute_force(small):
    seen, want = set(), {}
    for r in sorted(small.collect(), key=lambda r: r["doc_id"]):
        spans = []
        for a, b, digest in line_dedup.text_units(r["text"]):
            if digest in seen:
                spans.append((a, b))
            seen.add(digest)
        kept, at = "", 0
        for a, b in spans:
            kept, at = kept + r["text"][at:a], b
        want[r["doc_id"]] = (spans, kept + r["text"][at:])
    got = {r["doc_id"]: ([tuple(s) for s in r["spans"]], r["kept_text"])
           for r in line_dedup.cleaned(small).collect()}
    assert got == want


def test_mix_redistributes_to_siblings_first(spark):
    rows = [(i, "a", "x", "t " * 10) for i in range(10)]
    rows += [(100 + i, "a", "y", "t " * 10) for i in range(100)]
    rows += [(1000 + i, "b", "z", "t " * 10) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, text string")
    levels = ["domain", "lang"]
    leaves = mixing.plan(docs, levels, budget=1000, weights={mixing.node("b"): 1.0})
    budget = {r["path"]: r["budget"] for r in leaves.collect()}
    # a and b get 500 each; x has only 100 of its 250, its sibling y takes what is missing
    assert budget[mixing.node("a", "x")] == 100 and budget[mixing.node("a", "y")] == 400
    assert budget[mixing.node("b", "z")] == 500
    chosen = mixing.selected(docs, leaves, levels)
    assert {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()} == {
        "x": 10, "y": 40, "z": 50}
    again = mixing.plan(docs, levels, budget=5000, weights={}, epochs=2)
    twice = mixing.selected(docs, again, levels).groupBy("doc_id").count()
    assert twice.where("doc_id < 100").agg(F.min("count")).first()[0] == 2
    assert mixing.selected(docs, mixing.plan(docs.where("false"), levels), levels).count() == 0


def test_pipeline_stages(spark, data):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{data}/documents.parquet")
    counts = [docs.count()]
    for _, stage in cp.STAGES[:-1]:
        path = new_path(spark, "stage")
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == cp.COLUMNS
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1] < counts[0]
    assert cp.pack(spark, docs, data).count() >= counts[-1]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.execute(ORACLE[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    got = QUERIES[name](spark, data).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(
        str(tuple(row[i] for i in order)) for row in want.fetchall()
    )
