"""Exact top-k search by BM25 over an inverted index in shards.

The index is built where the texts are read, one row per shard of at most ``SHARD_DOCS``
documents and ``SHARD_PAIRS`` distinct words of documents: terms in order, their postings, document lengths. Documents of a shard are laid out
by their most frequent term, which puts those of one language side by side, and by length, so
that the maxima of blocks of ``BLOCK`` documents are tight.

The index is read in at most ``GROUPS`` groups of shards, whatever its size, and each meets
each bounded block of queries in one task, without a shuffle: a task takes its shards one after
the other and keeps the best k of each query so far, so it gives k rows a query at most. As in
block-max WAND, the sum over a query's terms of their greatest weight in a block bounds every
score of the block, and only blocks whose bound reaches the k-th best score so far are scored,
so nothing that belongs to the top k is skipped.

A shard is searched in blocks of ``WIDE`` documents by batches of like queries. A query of more
than ``FEW`` words prunes little: bounds of smaller blocks cost it as much as the scores. For
queries of few words the postings are read only in those parts of ``BLOCK`` documents whose own
bound reaches the k-th best score. A term that many queries of a batch share with many documents
of a block becomes a row of a matrix, and one product with 32 bits scores it for all of them;
which terms these are is decided for each batch and block by what both ways cost. The postings
of all others are added up one by one, block by block in the order of terms, so that they are
read from the processor's cache. Whatever comes within the error of the k-th best is scored
again with 64 bits.
Collection size, mean length and document frequencies are those of all shards, which makes
scores comparable, and the groups' best are merged into the exact overall best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmart.llm.common import materialize, ready
from jobmart.llm.near_dedup import mixed

K1, B = 1.2, 0.75
SHARD_DOCS = 16_384
#: A shard also ends before its (document, term) pairs pass this number; one document alone may.
SHARD_PAIRS = 4_000_000
#: Bytes of text whose words are counted at once.
PIECE = 1 << 20
BLOCK, WIDE = 64, 2_048
#: Words up to which a query has small blocks, without those in over 1 / ``OFTEN`` of a shard.
FEW, OFTEN = 32, 10
#: Products of a matrix that cost as much as adding up one posting.
SPARE = 200
#: Groups of shards, each of which gives every query k rows at most.
GROUPS = 8
QUERY_BLOCK = 8_192
#: Queries of a batch, and the sum of their numbers of words; one query alone may have more.
BATCH, BATCH_TERMS = 256, 1 << 17
#: Scores are compared after rounding, so that the order of additions decides nothing.
DIGITS = 6
INDEX = (
    "shard long, n_docs int, n_words long, doc_ids binary, lengths binary, terms binary,"
    " starts binary, postings binary, counts binary"
)
INDEX_COLUMNS = [c.split()[0] for c in INDEX.split(",")]
BLOCK_COLUMNS = ["ids", "bounds", "words", "word", "weights"]
BUFFER = 1 << 18
#: Postings whose weights are worked out, or that are added up, at once.
POSTINGS = 1 << 16
#: Cells of the matrices that are copied out at once to add up scores again.
CELLS = 1 << 20

_random = np.random.default_rng(20_250_103)
_letters = _random.integers(0, 2**64, 256, np.uint64)
_factor = np.uint64(int(_random.integers(2**62, 2**63)) | 1)
_inside = np.zeros(256, bool)
_inside[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def term_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit name of every word: runs of letters, digits and characters
    outside ASCII, with A-Z lower-cased."""
    owners, names = [], []
    at = 0
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * BUFFER, _factor)]))
    back = np.uint64(pow(int(_factor), -1, 2**64))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * BUFFER, back)]))
    while at < len(texts):
        first, some, total = at, [], 0
        while at < len(texts) and (not some or total + len(texts[at]) < BUFFER):
            some.append(texts[at].lower())
            total += len(some[-1]) + 1
            at += 1
        data = np.frombuffer(b" ".join(some), np.uint8)
        if len(data) >= len(up):
            up = np.multiply.accumulate(np.concatenate([up[:1], np.full(len(data), _factor)]))
            down = np.multiply.accumulate(np.concatenate([down[:1], np.full(len(data), back)]))
        edge = np.diff(np.concatenate([[0], _inside[data].view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_letters[data] * up[1 : len(data) + 1], out=sums[1:])
        found = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
        bounds = np.cumsum([len(x) + 1 for x in some])
        owners.append(first + np.searchsorted(bounds, starts, "right"))
        names.append(mixed(found))
    if not names:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(names)


def counted_pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, term name and count of every distinct word of every text, by text."""
    owner, names = term_names(texts)
    order = np.lexsort((names, owner))
    owner, names = owner[order], names[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (names[1:] != names[:-1])
    at = np.flatnonzero(fresh)
    counts = np.diff(np.append(at, len(owner)))
    return owner[at].astype(np.uint16), names[at], counts.astype(np.uint32)


def index_row(
    shard: int, doc_ids: np.ndarray, doc: np.ndarray, names: np.ndarray, counts: np.ndarray
) -> dict:
    """One shard's index from the distinct (document, term) pairs of its documents."""
    n = len(doc_ids)
    lengths = np.bincount(doc, counts, minlength=n).astype(np.int64)
    # Number the terms in place of their names, sorted pair by pair, with 32 bits.
    order = np.argsort(names)
    names = names[order]
    fresh = np.ones(len(names), bool)
    fresh[1:] = names[1:] != names[:-1]
    terms = names[fresh]
    del names
    term = (np.cumsum(fresh, dtype=np.uint32) - np.uint32(1)).astype(np.uint32)
    doc, counts = doc[order], counts[order]
    del order, fresh
    # Lay documents out by the most frequent of their terms, then by length.
    often = np.bincount(term, minlength=len(terms))
    rank = np.empty(len(terms), np.uint32)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(terms), dtype=np.uint32)
    best = np.full(n, len(terms), np.uint32)
    np.minimum.at(best, doc, rank[term])
    by = np.lexsort((lengths, best))
    place = np.empty(n, np.uint16)
    place[by] = np.arange(n, dtype=np.uint16)
    key = term.astype(np.uint64) << np.uint64(16) | place[doc]
    again = np.argsort(key)
    starts = np.concatenate([[0], np.cumsum(often)])
    return {
        "shard": shard, "n_docs": n, "n_words": int(lengths.sum()),
        "doc_ids": doc_ids[by].astype("<i8").tobytes(),
        "lengths": lengths[by].astype("<u4").tobytes(),
        "terms": terms.astype("<u8").tobytes(), "starts": starts.astype("<u4").tobytes(),
        "postings": (key[again] & np.uint64(0xFFFF)).astype("<u2").tobytes(),
        "counts": counts[again].astype("<u4").tobytes(),
    }


def packed(row: dict) -> dict:
    """An index row as it is stored: steps between postings and counts, low bytes first, with
    zstd. Rows travel through the JVM, and counts, mostly 1, are the larger part of them."""
    steps = np.diff(np.frombuffer(row["postings"], "<u2"), prepend=np.uint16(0))
    planes = {"postings": steps.astype("<u2"), "counts": np.frombuffer(row["counts"], "<u4")}
    small = {}
    for name, values in planes.items():
        split = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
        small[name] = pa.compress(split, "zstd", asbytes=True)
    return row | small


def unpacked(row: dict) -> dict:
    """The index row of a stored one."""
    n = int(np.frombuffer(row["starts"], "<u4")[-1])

    def plain(name: str, kind: str) -> np.ndarray:
        width = np.dtype(kind).itemsize
        split = np.frombuffer(pa.decompress(row[name], n * width, "zstd"), np.uint8)
        return np.ascontiguousarray(split.reshape(width, n).T).view(kind).ravel()

    postings = np.cumsum(plain("postings", "<u2"), dtype=np.uint16)
    return row | {"postings": postings, "counts": plain("counts", "<u4")}


def build_index(docs: DataFrame) -> DataFrame:
    """Index rows over all ``docs`` (``doc_id``, ``text``; others are ignored). A null text is
    empty; rows without a doc_id cannot be named as results and are left out."""
    ready(docs.sparkSession)
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 20
        schema = pa.schema(
            [("shard", pa.int64()), ("n_docs", pa.int32()), ("n_words", pa.int64())]
            + [(x.split()[0], pa.binary()) for x in INDEX.split(",")[3:]]
        )
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        n = pairs = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held])
            shift = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
            doc = np.concatenate([x[1] + np.uint16(s) for x, s in zip(held, shift, strict=True)])
            names = np.concatenate([x[2] for x in held])
            counts = np.concatenate([x[3] for x in held])
            held.clear()
            pa.default_memory_pool().release_unused()
            row = index_row(shard, ids, doc, names, counts)
            return pa.RecordBatch.from_pylist([packed(row)], schema)

        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < batch.num_rows:
                # a piece is at most PIECE bytes of text, or one text that alone is longer
                most = (sizes[at - 1] if at else 0) + PIECE
                until = max(at + 1, int(np.searchsorted(sizes, most, "right")))
                doc, names, counts = counted_pairs(texts.slice(at, until - at).to_pylist())
                full = n + (until - at) > SHARD_DOCS or pairs + len(doc) > SHARD_PAIRS
                if held and full:
                    yield flush()
                    n, pairs, shard = 0, 0, shard + 1
                held.append((ids[at:until], doc, names, counts))
                n, pairs, at = n + (until - at), pairs + len(doc), until
        if held:
            yield flush()

    return rows.mapInArrow(run, INDEX)


def frequencies(index: DataFrame) -> DataFrame:
    """(term, df): in how many documents of all shards a term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                df = np.diff(np.frombuffer(starts, "<u4").astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(terms, "<i8")), pa.array(df)], names=["term", "n"]
                )

    found = index.select("terms", "starts").mapInArrow(run, "term long, n long")
    return found.groupBy("term").agg(F.sum("n").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, terms, times): the distinct words of each row (query_id, text), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, names = term_names(batch.column(1).to_pylist())
            order = np.lexsort((names, owner))
            owner, names = owner[order], names[order]
            fresh = np.ones(len(owner), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (names[1:] != names[:-1])
            at = np.flatnonzero(fresh)
            times = np.diff(np.append(at, len(owner)))
            starts = np.searchsorted(owner[at], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(starts), pa.array(x))
                for x in (names[at].view(np.int64), times)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *lists], names=["query_id", "terms", "times"]
            )

    rows = queries.where(F.col("query_id").isNotNull()).select(
        F.col("query_id").cast("long").alias("query_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, "query_id long, terms array<long>, times array<long>")


def query_blocks(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """One row for each ``part`` of ``queries`` (part, query_id, terms, times): its queries'
    terms as numbers of the block's terms and their weights. Rows of one query_id count
    together; terms without a row (to, term, idf) in ``weights``, ``to`` being the part, do
    not occur."""

    def pack(left: pa.Table, right: pa.Table) -> pa.Table:
        terms = right.column("term").to_numpy().view(np.uint64)
        order = np.argsort(terms)
        terms, idf = terms[order], right.column("idf").to_numpy()[order]
        given = left.column("query_id").to_numpy()
        lists = left.column("terms").combine_chunks()
        names = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        times = left.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids, owner = np.unique(given, return_inverse=True)
        owner = np.repeat(owner, lists.value_lengths().to_numpy(zero_copy_only=False))
        term = np.searchsorted(terms, names)
        known = term < len(terms)
        known[known] = terms[term[known]] == names[known]
        owner, term, times = owner[known], term[known], times[known]
        order = np.lexsort((term, owner))
        owner, term, times = owner[order], term[order], times[order]
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])
        at = np.flatnonzero(fresh)
        times = np.add.reduceat(times, at) if len(at) else times
        owner, term = owner[at], term[at]
        columns = [
            ids.astype("<i8"), np.searchsorted(owner, np.arange(len(ids) + 1)).astype("<i8"),
            terms.astype("<u8"), term.astype("<u4"), (idf[term] * times).astype("<f8"),
        ]
        part = left.column("part")[:1].combine_chunks()
        return pa.table(
            [part, *[pa.array([c.tobytes()], pa.binary()) for c in columns]],
            names=["part", *BLOCK_COLUMNS],
        )

    kinds = ", ".join(f"{c} binary" for c in BLOCK_COLUMNS)
    return queries.groupBy("part").cogroup(weights.groupBy("to")).applyInArrow(
        pack, f"part int, {kinds}"
    )


class QueryBlock:
    """A row of :func:`query_blocks`, and the best k results of each of its queries so far."""

    def __init__(self, row: dict, k: int):
        kinds = zip(BLOCK_COLUMNS, ("<i8", "<i8", "<u8", "<u4", "<f8"), strict=True)
        plain = [np.frombuffer(row[c], kind) for c, kind in kinds]
        self.ids, self.starts, self.terms, self.term, self.weight = plain
        self.ids, self.terms, self.k = self.ids.copy(), self.terms.copy(), k
        #: Made of the other columns when the first shard is met.
        self.batches: list[Batch] = []

    def meet(self, shard: Shard) -> None:
        number = shard.numbers(self.terms)
        if not self.batches:
            self._deal(shard, number)
        for block in shard.blocks():
            places = block.places(number)
            for batch in self.batches:
                block.add(batch, places)

    def _deal(self, shard: Shard, number: np.ndarray) -> None:
        """Queries that prune alike and share many words go together: of few words or more, with
        the same most frequent word, of like length."""
        kinds = np.zeros((3, len(self.ids)), np.int64)
        for q, (a, b) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
            t = number[self.term[a:b]]
            kinds[:, q] = b - a, *shard.kind(t[t >= 0])
        order = np.lexsort(kinds)
        long = kinds[2, order] > 0
        for some, few in ((order[~long], True), (order[long], False)):
            ends = np.cumsum(kinds[0, some])
            first = 0
            while first < len(some):
                most = ends[first] - kinds[0, some[first]] + BATCH_TERMS
                last = max(first + 1, int(np.searchsorted(ends, most, "right")))
                mine = some[first : min(last, first + BATCH)]
                at, owner = _ranges(self.starts, mine)
                self.batches.append(Batch(mine, owner, self.term[at], self.weight[at], few, self.k))
                first += len(mine)
        del self.starts, self.term, self.weight

    def rows(self) -> pa.RecordBatch:
        found = [(self.ids[b.queries], b.ids, b.scores) for b in self.batches]
        ids, docs, scores = (
            np.concatenate([np.zeros((0, *n), kind), *c])
            for n, kind, c in zip(
                ((), (self.k,), (self.k,)), ("<i8", "<i8", "<f8"),
                zip(*found, strict=True) if found else [()] * 3, strict=True,
            )
        )
        some = scores > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (np.repeat(ids, some.sum(axis=1)), docs[some], scores[some])],
            names=["query_id", "doc_id", "score"],
        )


class Batch:
    """Queries that are scored together: the queries that have each of their terms, with weights,
    and the best k results of each so far, a score of 0 where there is none."""

    def __init__(
        self, queries: np.ndarray, owner: np.ndarray, term: np.ndarray, weight: np.ndarray,
        few: bool, k: int,
    ):
        self.queries, self.few, self.k = queries, few, k
        order = np.argsort(term, kind="stable")
        term = term[order]
        self.owner, self.weight = owner[order].astype(np.int32), weight[order]
        first = np.ones(len(term), bool)
        first[1:] = term[1:] != term[:-1]
        first = np.flatnonzero(first)
        self.terms, self.starts = term[first], np.append(first, len(term))
        self.ids = np.zeros((len(queries), k), np.int64)
        self.scores = np.zeros((len(queries), k))

    @property
    def floor(self) -> np.ndarray:
        """The score that a further result of each query has to reach."""
        return self.scores[:, -1]

    def take(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take further results of queries by their numbers."""
        which, place = np.unique(query, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(which)), self.k), place])
        ids = np.concatenate([self.ids[which].ravel(), ids])
        scores = np.concatenate([self.scores[which].ravel(), scores])
        order = np.lexsort((ids, -scores, place))
        first = np.searchsorted(place[order], np.arange(len(which)))
        order = order[first[:, None] + np.arange(self.k)]
        self.ids[which], self.scores[which] = ids[order], scores[order]


def _runs(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs of ``count`` from ``low`` on, and which run each belongs to."""
    at = np.repeat(low - (np.cumsum(count) - count), count)
    at += np.arange(len(at))
    return at, np.repeat(np.arange(len(low)), count)


def _ranges(starts: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of terms ``t``, and which of ``t`` each belongs to."""
    return _runs(starts[t], starts[t + 1] - starts[t])


class Shard:
    """Postings of an index row with their weights, by blocks of ``WIDE`` documents, in a block
    by term."""

    def __init__(self, row: dict, mean_length: float):
        self.n = int(row["n_docs"])
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.terms = np.frombuffer(row["terms"], "<u8")
        docs = np.frombuffer(row["postings"], "<u2")
        times = np.frombuffer(row["counts"], "<u4")
        lengths = np.frombuffer(row["lengths"], "<u4")
        norm = K1 * (1 - B + B * lengths / max(mean_length, 1e-9))
        #: In how many documents each term occurs.
        self.often = np.diff(np.frombuffer(row["starts"], "<u4").astype(np.int64))
        term = np.repeat(np.arange(len(self.terms), dtype=np.uint32), self.often)
        block = (docs // np.uint16(WIDE)).astype(np.uint8)
        order = np.argsort(block, kind="stable").astype(np.uint32)
        self.cuts = np.append(0, np.cumsum(np.bincount(block, minlength=-(-self.n // WIDE))))
        self.term, self.docs, times = term[order], docs[order], times[order]
        del term, block, order
        self.weight = np.empty(len(docs))
        for at in range(0, len(docs), POSTINGS):
            some = slice(at, at + POSTINGS)
            tf = times[some]
            np.divide(tf * (K1 + 1), norm[self.docs[some]] + tf, out=self.weight[some])
        self.docs %= np.uint16(WIDE)
        #: Postings of terms that queries have, and how many of them were read.
        self.postings = self.postings_read = 0

    def blocks(self) -> Iterator[Block]:
        for b in range(len(self.cuts) - 1):
            yield Block(self, b)

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The shard's numbers of ``terms``, -1 for those that it does not have."""
        t = np.searchsorted(self.terms, terms)
        t[t == len(self.terms)] = -1
        t[t >= 0] = np.where(self.terms[t[t >= 0]] == terms[t >= 0], t[t >= 0], -1)
        return t

    def kind(self, t: np.ndarray) -> tuple[int, bool]:
        """The most frequent of terms ``t``, and whether more than ``FEW`` are not frequent."""
        often = self.often[t]
        most = int(t[np.argmax(often)]) if len(t) else -1
        return most, int((often * OFTEN <= self.n).sum()) > FEW

    def search(self, queries: list[tuple], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, doc_ids, scores) of the best k of this shard for (query, terms, weights)."""
        names, lists, weights = zip(*queries, strict=True)
        terms, term = np.unique(np.concatenate(lists), return_inverse=True)
        row = {
            "ids": np.arange(len(names)), "bounds": np.cumsum([0, *map(len, lists)]),
            "words": terms, "word": term.astype("<u4"), "weights": np.concatenate(weights),
        }
        block = QueryBlock({c: x.tobytes() for c, x in row.items()}, k)
        block.meet(self)
        for batch in block.batches:
            for q, ids, scores in zip(batch.queries, batch.ids, batch.scores, strict=True):
                yield names[q], ids[scores > 0], scores[scores > 0]


class Block:
    """A block of ``WIDE`` documents: an entry for each term that occurs, its postings and the
    greatest of their weights; and the same for each of its parts of ``BLOCK`` documents."""

    def __init__(self, shard: Shard, b: int):
        some = slice(shard.cuts[b], shard.cuts[b + 1])
        self.shard, self.docs, self.weight = shard, shard.docs[some], shard.weight[some]
        self.width = min(WIDE, shard.n - b * WIDE)
        self.doc_ids = shard.doc_ids[b * WIDE : b * WIDE + self.width]
        term = shard.term[some]
        fresh = np.ones(len(term), bool)
        fresh[1:] = term[1:] != term[:-1]
        self.begin = np.flatnonzero(fresh)
        self.terms, self.count = term[self.begin], np.diff(np.append(self.begin, len(term)))
        self.top = np.maximum.reduceat(self.weight, self.begin) if len(term) else self.weight
        self.fresh = fresh

    @cached_property
    def parts(self) -> tuple[np.ndarray, ...]:
        """Where the parts of each entry start, and the number, the first posting, the number of
        postings and the greatest weight of each part."""
        part = self.docs // np.uint16(BLOCK)
        fresh = self.fresh.copy()
        fresh[1:] |= part[1:] != part[:-1]
        begin = np.flatnonzero(fresh)
        top = np.maximum.reduceat(self.weight, begin) if len(begin) else self.weight
        starts = np.append(np.searchsorted(begin, self.begin), len(begin))
        return starts, part[begin], begin, np.diff(np.append(begin, len(part))), top

    def places(self, number: np.ndarray) -> np.ndarray:
        """The entries of terms by their numbers in the shard, -1 where there is none."""
        place = np.full(len(self.shard.terms) + 1, -1, np.int32)
        place[self.terms] = np.arange(len(self.terms))
        return place[number]

    def add(self, batch: Batch, places: np.ndarray) -> None:
        """Add to the best of ``batch`` what this block has.

        Only queries whose bound reaches their worst result so far are scored, and of those of few
        words only such parts. What many queries share with many documents is multiplied as
        matrices of 32 bits, all else is added up posting by posting; what comes within the error
        of the k-th best is multiplied again with 64 bits.
        """
        entry = places[batch.terms]
        given = np.flatnonzero(entry >= 0)
        entry = entry[given]
        low = batch.starts[given]
        pair, of = _runs(low, batch.starts[given + 1] - low)
        query, weight = batch.owner[pair], batch.weight[pair]
        self.shard.postings += int(self.count[entry][of].sum())
        parts = 1
        if batch.few:
            parts = -(-self.width // BLOCK)
            starts, part, begin, counts, top = self.parts
            piece, mine = _ranges(starts, entry[of])
            into = query[mine] * parts + part[piece]
            bound = np.bincount(into, weight[mine] * top[piece], len(batch.queries) * parts)
        else:
            bound = np.bincount(query, weight * self.top[entry][of], len(batch.queries))
        bound = bound.reshape(-1, parts)
        wanted = (bound + 10.0**-DIGITS >= batch.floor[:, None]) & (bound > 0)
        queries = np.flatnonzero(wanted.any(axis=1))
        if not len(queries):
            return
        if len(queries) < len(batch.queries):
            number = np.full(len(batch.queries), -1)
            number[queries] = np.arange(len(queries))
            query = number[query]
            mine = query >= 0
            query, weight, of = query[mine], weight[mine], of[mine]
            wanted = wanted[queries]
        times = np.bincount(of, minlength=len(entry))
        low, count = self.begin[entry], self.count[entry]
        many = times * count * SPARE > len(queries) * self.width
        # as matrices
        dense = np.zeros((int(many.sum()), self.width))
        run, row = _runs(low[many], count[many])
        dense[row, self.docs[run]] = self.weight[run]
        common = np.zeros((len(queries), len(dense)))
        mine = many[of]
        common[query[mine], (np.cumsum(many) - 1)[of[mine]]] = weight[mine]
        total = common.astype(np.float32) @ dense.astype(np.float32)
        self.shard.postings_read += int((times * count)[many].sum())
        # posting by posting
        mine = np.flatnonzero(~mine)
        query, weight, of = query[mine], weight[mine], of[mine]
        if batch.few:
            piece, mine = _ranges(starts, entry[of])
            read = wanted[query[mine], part[piece]]
            piece, mine = piece[read], mine[read]
            query, weight, low, count = query[mine], weight[mine], begin[piece], counts[piece]
        else:
            low, count = low[of], count[of]
        rest = self._added(query, weight, low, count, len(queries))
        self.shard.postings_read += int(count.sum())
        total += rest
        if not wanted.all():
            total[~np.repeat(wanted, BLOCK if batch.few else WIDE, axis=1)[:, : self.width]] = 0
        self._first(batch, queries, total, rest, common, dense)

    def _added(
        self, query: np.ndarray, weight: np.ndarray, low: np.ndarray, count: np.ndarray,
        queries: int,
    ) -> np.ndarray:
        """Sums over runs of postings, each times a weight, for each query and document. Runs are
        taken some at a time, so that the arrays stay in the processor's cache."""
        ends = np.cumsum(count)
        low = low - (ends - count)
        base = query * np.int64(self.width)
        sums = np.zeros(queries * self.width)
        cuts = np.searchsorted(ends, np.arange(0, count.sum(), POSTINGS)).tolist() + [len(ends)]
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            some, times = slice(first, last), count[first:last]
            start = ends[first - 1] if first else 0
            run = np.repeat(low[some], times)
            run += np.arange(start, start + len(run))
            into = np.repeat(base[some], times)
            into += self.docs[run]
            value = self.weight[run]
            value *= np.repeat(weight[some], times)
            np.add.at(sums, into, value)
        return sums.reshape(queries, self.width)

    def _first(
        self, batch: Batch, queries: np.ndarray, total: np.ndarray, rest: np.ndarray,
        common: np.ndarray, dense: np.ndarray,
    ) -> None:
        """Add up again with 64 bits what may be among the best k by ``total``."""
        # What sums of 32 bits may be off by, as a share.
        slack = 4 * (len(dense) + 8) * 2.0**-24

        def least(limit: np.ndarray) -> np.ndarray:
            limit = limit * (1 - slack) - 2 * 10.0**-DIGITS
            return np.maximum(limit, np.finfo(np.float32).tiny).astype(np.float32)

        limit, k = least(batch.floor[queries]), batch.k
        at = np.flatnonzero(total >= limit[:, None])
        query = at // self.width
        more = np.flatnonzero(np.bincount(query, minlength=len(queries)) > k)
        if len(more):
            kth = np.partition(total[more], self.width - k, axis=1)[:, self.width - k]
            limit[more] = np.maximum(limit[more], least(kth.astype(np.float64)))
            at = at[total.ravel()[at] >= limit[query]]
        if not len(at):
            return
        query, doc = np.divmod(at, self.width)
        scores = rest.ravel()[at]
        if len(at) * 16 > total.size:  # many documents that are alike
            scores += (common @ dense).ravel()[at]
        else:
            step = max(1, CELLS // max(1, len(dense)))
            for i in range(0, len(at), step):
                some = slice(i, i + step)
                scores[some] += np.einsum("ij,ji->i", common[query[some]], dense[:, doc[some]])
        scores = np.round(scores, DIGITS)
        some = scores > 0
        batch.take(queries[query[some]], self.doc_ids[doc[some]], scores[some])


def top_k(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score of the best ``k`` documents of every query, ties by doc_id.

    ``queries`` has query_id and text; rows without a query_id cannot be named and give none. A query without a word that occurs gives no row, nor
    does a document that shares no word with it. Repeated doc_ids are results of their own. An
    empty index gives no rows.
    """
    ready(index.sparkSession)
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("words")).first()
    n, words = total["n"] or 0, total["words"] or 0
    mean_length = words / max(n, 1)
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = materialize(query_terms(queries), "query-terms")
    # Query blocks of a bounded size; each meets every group of shards once.
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    wanted = asked.select(F.col("part").alias("to"), F.explode("terms").alias("term")).distinct()
    weights = wanted.join(frequencies(index), "term").select("to", "term", idf.alias("idf"))
    blocks = query_blocks(asked, weights)
    groups = index.coalesce(GROUPS).hint("shuffle_replicate_nl")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, QueryBlock] = {}
        shard = held = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: _held(batch.column(c)[i]) for c in [*INDEX_COLUMNS, "part"]}
                if row["part"] not in met:
                    block = {c: _held(batch.column(c)[i]) for c in BLOCK_COLUMNS}
                    met[row["part"]] = QueryBlock(block, k)
                if held != row["shard"]:
                    shard, held = None, row["shard"]
                    pa.default_memory_pool().release_unused()
                    shard = Shard(unpacked(row), mean_length)
                met[row["part"]].meet(shard)
        for block in met.values():
            yield block.rows()

    best = groups.crossJoin(blocks).mapInArrow(run, "query_id long, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", "score")


def _held(value: pa.Scalar):
    """A binary value where Arrow has it, any other as Python's."""
    return value.as_buffer() if pa.types.is_binary(value.type) else value.as_py()
