"""Several shards and pruned postings give what scoring every document gives."""

import random

import numpy as np
from pyspark.sql import functions as F

from jobmart.llm import bm25


def texts(n, seed=5):
    """Texts over a few frequent words and words of ten topics, some of them long."""
    rng = random.Random(seed)
    for i in range(n):
        topic = rng.randrange(10)
        words = [f"t{topic}x{min(int(rng.expovariate(0.02)), 400)}" for _ in range(rng.randint(5, 90))]
        yield i, " ".join([*rng.choices("the of and to in".split(), k=10), *words])


def test_rows_do_not_depend_on_shards(spark, monkeypatch):
    docs = spark.createDataFrame([*texts(1500), (1500, None), (1501, "")], "doc_id long, text string")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    asked = asked.unionByName(asked.select(F.lit(None).cast("long").alias("query_id"), "text"))

    def found(parts):
        index = bm25.build_index(docs.repartition(parts, "doc_id"))
        rows = bm25.top_k(index, asked).orderBy("query_id", "rank").collect()
        return [tuple(r) for r in rows], index.count()

    one, shards = found(1)
    assert shards == 1 and len(one) == 30 * 10
    many, shards = found(5)
    assert shards == 5 and many == one


def test_a_shard_ends_before_it_has_too_many_pairs():
    pairs = [bm25.counted_pairs([t.encode()]) for _, t in texts(20)]
    names = np.concatenate([p[1] for p in pairs])
    doc = np.concatenate([p[0] + np.uint16(i) for i, p in enumerate(pairs)])
    row = bm25.index_row(0, np.arange(20), doc, names, np.concatenate([p[2] for p in pairs]))
    assert row["n_words"] == sum(len(t.split()) for _, t in texts(20))
    assert len(row["postings"]) == 2 * len(names)


def test_sparse_postings_are_skipped_and_the_best_are_exact():
    given = [t.encode() for _, t in texts(4000)]
    doc, names, counts = bm25.counted_pairs(given)
    shard = bm25.Shard(bm25.index_row(0, np.arange(len(given)), doc, names, counts), 60.0)
    queries = []
    for q in range(40):
        _, terms, times = bm25.counted_pairs([b" ".join(given[q * 90].split()[10:16])])
        order = np.argsort(terms)
        queries.append((q, terms[order], times[order].astype(float)))
    norm = np.bincount(doc, counts, minlength=len(given))
    norm = bm25.K1 * (1 - bm25.B + bm25.B * norm / 60.0)
    for q, ids, scores in shard.search(queries, 10):
        weight = dict(zip(queries[q][1], queries[q][2], strict=True))
        w = np.array([weight.get(t, 0.0) for t in names])
        want = np.round(np.bincount(doc, w * counts * 2.2 / (counts + norm[doc])), bm25.DIGITS)
        best = np.lexsort((np.arange(len(want)), -want))[:10]
        best = best[want[best] > 0]
        assert ids.tolist() == best.tolist() and np.allclose(scores, want[best])
    assert 0 < shard.postings_read < shard.postings


def test_a_shard_takes_its_weights_in_pieces(monkeypatch):
    """Weights and postings of a shard take little more than their own size."""
    given = [t.encode() for _, t in texts(3000)]
    doc, names, counts = bm25.counted_pairs(given)
    row = bm25.index_row(0, np.arange(len(given)), doc, names, counts)
    whole = bm25.Shard(row, 60.0).weight
    monkeypatch.setattr(bm25, "POSTINGS", 1000)
    assert (bm25.Shard(row, 60.0).weight == whole).all()


def test_searching_copies_no_query_vectors(spark):
    """Before, every group was turned into pandas rows and sorted copies of all its vectors."""
    docs = spark.createDataFrame([*texts(200)], "doc_id long, text string")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    plan = bm25.top_k(bm25.build_index(docs), asked)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "InPandas" not in plan


def test_stored_rows_are_small_and_give_the_index_back():
    for given in ([t.encode() for _, t in texts(3000)], [b""]):
        doc, names, counts = bm25.counted_pairs(given)
        row = bm25.index_row(0, np.arange(len(given)), doc, names, counts)
        stored = bm25.packed(row)
        for name in ("postings", "counts"):
            assert len(names) == 0 or len(stored[name]) < len(row[name])
            assert bm25.unpacked(stored)[name].tobytes() == row[name]


def test_long_queries_meet_shard_after_shard_and_the_best_are_exact():
    """Before, each shard gave every query k rows, and found them with bounds that pruned little."""
    given = [(t + " " + " ".join(f"r{i % 700}y{j}" for j in range(40))).encode() for i, t in texts(3000)]
    doc, names, counts = bm25.counted_pairs(given)
    lengths = np.bincount(doc, counts, minlength=len(given))
    mean = float(lengths.mean())
    terms, df = np.unique(names, return_counts=True)
    idf = np.log1p((len(given) - df + 0.5) / (df + 0.5))
    asked = [*range(0, 3000, 60)]
    mine = [np.flatnonzero(doc == q) for q in asked]
    term = [np.sort(np.searchsorted(terms, names[at])) for at in mine]
    weight = [idf[t] for t in term]
    assert min(len(t) for t in term) > bm25.FEW
    row = {
        "ids": np.array(asked), "bounds": np.cumsum([0, *map(len, term)]), "words": terms,
        "word": np.concatenate(term).astype(np.uint32), "weights": np.concatenate(weight),
    }
    block = bm25.QueryBlock({c: x.tobytes() for c, x in row.items()}, 10)
    for at in range(0, len(given), 500):
        some = (doc >= at) & (doc < at + 500)
        ids = np.arange(at, at + 500)
        shard = bm25.index_row(at, ids, doc[some] - np.uint16(at), names[some], counts[some])
        block.meet(bm25.Shard(shard, mean))
    found = block.rows().to_pandas()
    assert found.groupby("query_id").size().max() == 10
    norm = bm25.K1 * (1 - bm25.B + bm25.B * lengths / mean)
    number = np.searchsorted(terms, names)
    for q, t, w in zip(asked, term, weight, strict=True):
        full = np.zeros(len(terms))
        full[t] = w
        want = np.bincount(doc, full[number] * counts * 2.2 / (counts + norm[doc]))
        want = np.round(want, bm25.DIGITS)
        best = np.lexsort((np.arange(len(want)), -want))[:10]
        got = found[found.query_id == q]
        assert got.doc_id.tolist() == best.tolist() and np.allclose(got.score, want[best])


def test_the_index_is_not_shuffled(spark, monkeypatch):
    """Before, each block of queries had a copy of the index sent, and each shard the queries."""
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 8)
    docs = spark.createDataFrame([*texts(1000)], "doc_id long, text string")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    index = bm25.materialize(bm25.build_index(docs.repartition(12, "doc_id")), "bm25-index")
    found = bm25.top_k(index, asked)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    # what lies above the scan of the postings, up to the product
    lines = [x for x in plan.splitlines() if "postings" in x or "Cartesian" in x or "Exchange" in x]
    product = next(i for i, x in enumerate(lines) if "CartesianProduct" in x)
    assert "FileScan" in lines[product + 1] and "postings" in lines[product + 1]
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 4096)
    rows = [tuple(r) for r in found.orderBy("query_id", "rank").collect()]
    assert rows == [tuple(r) for r in bm25.top_k(index, asked).orderBy("query_id", "rank").collect()]
    assert len(rows) == 200


def _long_queries(n):
    """A shard's row of ``n`` texts, a twelfth of which share 40 words each, and as queries every
    20th of its texts with all its words."""
    given = [(t + " " + " ".join(f"g{i % 12}y{j}" for j in range(40))).encode() for i, t in texts(n)]
    doc, names, counts = bm25.counted_pairs(given)
    queries = []
    for q in range(0, n, 20):
        mine = np.flatnonzero(doc == q)
        order = np.argsort(names[mine])
        queries.append((q, names[mine][order], counts[mine][order].astype(float)))
    row = bm25.index_row(0, np.arange(n), doc, names, counts)
    lengths = np.bincount(doc, counts, minlength=n)
    norm = bm25.K1 * (1 - bm25.B + bm25.B * lengths / 60.0)
    weight = counts * (bm25.K1 + 1) / (counts + norm[doc])
    return row, queries, (doc, names, weight)


def test_shared_terms_are_multiplied_once_for_a_batch(monkeypatch):
    """Before, each query added up alone all postings of terms in a tenth of the shard or less."""
    row, queries, (doc, names, weight) = _long_queries(3000)
    shard = bm25.Shard(row, 60.0)
    one_by_one = []
    added = bm25.Block._added

    def counted(self, query, weight, low, count, queries):
        one_by_one.append(int(count.sum()))
        return added(self, query, weight, low, count, queries)

    monkeypatch.setattr(bm25.Block, "_added", counted)
    results = dict((q, (ids, scores)) for q, ids, scores in shard.search(queries, 10))
    assert len(results) == len(queries)
    often = dict(zip(shard.terms.tolist(), shard.often.tolist(), strict=True))
    alone = sum(often[t] for _, terms, _ in queries for t in terms.tolist() if often[t] <= 300)
    assert 0 < sum(one_by_one) < alone / 2
    for q, terms, times in queries:
        at = np.minimum(np.searchsorted(terms, names), len(terms) - 1)
        want = np.where(terms[at] == names, weight * times[at], 0.0)
        want = np.round(np.bincount(doc, want, 3000), bm25.DIGITS)
        best = np.lexsort((np.arange(3000), -want))[:10]
        assert results[q][0].tolist() == best.tolist()
        assert np.allclose(results[q][1], want[best], rtol=0, atol=2e-6)


def test_settings_of_the_search_change_no_result(monkeypatch):
    row, queries, _ = _long_queries(700)

    def found():
        rows = bm25.Shard(row, 60.0).search([*queries, (-1, np.zeros(0, np.uint64), np.zeros(0))], 10)
        return {q: (ids.tolist(), scores.tolist()) for q, ids, scores in rows}

    want = found()
    assert want[-1] == ([], []) and len(want) == 36
    for name, value in (
        ("BATCH", 3), ("BATCH_TERMS", 1), ("POSTINGS", 50), ("CELLS", 1), ("WIDE", 64),
        ("SPARE", 0), ("SPARE", 10**9), ("FEW", 1000),
    ):
        with monkeypatch.context() as changed:
            changed.setattr(bm25, name, value)
            assert found() == want, name


def test_documents_that_are_alike_are_ranked_by_id():
    given = [b"one text that many hold"] * 5000 + [b"another text"] * 20
    doc, names, counts = bm25.counted_pairs(given)
    shard = bm25.Shard(bm25.index_row(0, np.arange(5020)[::-1], doc, names, counts), 4.0)
    _, terms, times = bm25.counted_pairs([given[0]])
    for _, ids, scores in shard.search([(0, np.sort(terms), times.astype(float))] * 2, 10):
        assert ids.tolist() == [*range(20, 30)] and len(set(scores.tolist())) == 1
