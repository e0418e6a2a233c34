"""The swap search against best fit alone, and packed pieces against the tokenizers library."""

import zlib

import numpy as np
import pytest

from jobmart.llm import packing
from jobmart.llm.queries import QUERIES, vocabulary


def _used(lengths, bins, capacity):
    fill = np.bincount(bins, lengths)
    assert fill.max() <= capacity and fill.sum() == sum(lengths)
    return int((fill > 0).sum())


@pytest.mark.parametrize("low,high,least_gain", [(300, 900, 5), (400, 700, 20), (600, 1100, 10)])
def test_search_needs_fewer_bins_than_best_fit(low, high, least_gain):
    lengths = np.random.default_rng(5).integers(low, high, 3000).tolist()
    alone = _used(lengths, packing.pack_shard(lengths, 2048, patience=0), 2048)
    found = _used(lengths, packing.pack_shard(lengths, 2048), 2048)
    assert -(-sum(lengths) // 2048) <= found <= alone - least_gain
    assert packing.pack_shard(lengths, 2048) == packing.pack_shard(lengths, 2048)


def test_each_exchange_raises_squared_fill():
    random = np.random.default_rng(2)
    given, taken = random.integers(0, 9, (500, 8)), random.integers(0, 9, (500, 8))
    room = random.integers(0, 12, 500)
    gain, p, q, t = packing._exchanges(given, taken, room)
    rows = np.arange(500)
    moved = given[rows, p] + np.where(q >= 0, given[rows, q], 0) - np.where(t >= 0, taken[rows, t], 0)
    some = gain > 0
    assert some.any() and (moved[some] == gain[some]).all() and (gain <= room).all()
    for i in range(100):  # no exchange of the pair gains more
        best = 0
        for x in range(8):
            for y in range(-1, x):
                if not given[i, x] or (y >= 0 and not given[i, y]):
                    continue
                out = given[i, x] + (given[i, y] if y >= 0 else 0)
                best = max([best, *(out - b for b in (0, *taken[i]) if 0 < out - b <= room[i])])
        assert gain[i] == best


def test_pieces_equal_the_library(spark, data):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    got = QUERIES["op7_best_fit_packing"](spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").toPandas()
    want = []
    for doc_id, text in docs.itertuples(index=False):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            want.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[columns].to_numpy().tolist())) == sorted(want)
    for _, some in got.groupby("sequence_id"):
        ordered = some.sort_values("offset")
        ends = ordered["offset"] + ordered["length"]
        assert ends.max() <= 2048
        assert ordered["offset"].tolist() == [0, *ends.tolist()[:-1]]


def test_packing_of_odd_rows(spark):
    rows = [(None, None, 1), (None, "", 1), (7, "a b c", 1), (7, "a b c", 1), (8, "word " * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin long")
    docs = docs.selectExpr("*", "bin AS sequence_id", "bin AS length", "bin AS shard", "bin AS copy")
    found = packing.pack(docs, vocabulary()).toPandas()
    assert found["doc_id"].isna().sum() == 2 and (found["doc_id"] == 7).sum() == 2
    long = found[found["doc_id"] == 8].sort_values("piece")
    assert long["length"].tolist()[:-1] == [2048] * (len(long) - 1)
    assert packing.pack(docs.where("false"), vocabulary()).count() == 0
