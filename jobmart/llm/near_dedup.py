"""Near duplicates by b-bit MinHash, confirmed on full shingle sets.

Documents with the same set of shingles form a class, and only its smallest document goes on,
so a group of copies costs one row. ``BANDS * ROWS`` minima under random permutations name a
class's buckets, ``ROWS`` minima each. Members of shared buckets get a signature of
``PERMUTATIONS`` minima of which only the low ``BITS`` bits are kept, packed into longs. The
share of equal low bits, corrected for those that are equal by chance, estimates similarity,
and pairs clearly below the threshold are dropped. The others are confirmed on their sets. Two
documents at the threshold of 0.8 share no bucket with probability (1 - 0.8^5)^32, 3 in a
million.

Buckets are never expanded into all their pairs. In each of ``TURNS`` turns every member meets
a few members of its buckets that are not yet in its component, in a random order, and its
most similar one is confirmed; links give components. At last the members outside the largest
component of a bucket, few by then, meet all members of its other components: first pairs whose
estimate reaches the threshold, then, of what is still apart, all that may reach it. Pairs that
are left out lie in one component already, so no component is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmart.llm.common import materialize, ready

BANDS, ROWS = 32, 5
PERMUTATIONS, BITS = 2048, 2
#: Longs of one bit plane: the first holds the lowest bit of each minimum, and so on.
PLANE = PERMUTATIONS // 64
LONGS = PLANE * BITS
#: Pairs whose estimate is this far below the threshold are dropped: over five deviations.
SLACK = 0.057
TURNS = 2
#: Large buckets are cut at random for the turns, not for the last step.
TURN_MEMBERS = 4096
#: Outside members of a bucket that one task pairs with the bucket's members.
BLOCK = 256
BUFFER = 1 << 18

_random = np.random.default_rng(20_250_102)
_letters = _random.integers(0, 2**64, 256, np.uint64)
_factor = np.uint64(int(_random.integers(2**62, 2**63)) | 1)
_scales = _random.integers(0, 2**32, PERMUTATIONS, np.uint32) | np.uint32(1)
_shifts = _random.integers(0, 2**32, PERMUTATIONS, np.uint32)
_numbers = np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32)
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_factor), -1, 2**64))
    ones = np.ones(n, np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = _factor, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit name of every word: a sum of its letters times powers of a factor."""
    inside = ~_space[data]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters[data] * up[1:], out=sums[1:])
    names = (sums[ends] - sums[starts]) * down[starts]
    return starts, mixed(names + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit names. Words are cut at ASCII white
    space and only A-Z are lower-cased. A text of fewer words than ``size`` is one shingle."""
    at = 0
    while at < len(texts):
        some, total = [], 0
        while at < len(texts) and (not some or total + len(texts[at]) < BUFFER):
            some.append(texts[at].lower())  # bytes: ASCII letters only
            total += len(some[-1]) + 1
            at += 1
        data = np.frombuffer(b" ".join(some), np.uint8)
        ends = np.cumsum([len(x) + 1 for x in some])
        starts, words = word_names(data) if len(data) else (np.zeros(0, int), np.zeros(0, "u8"))
        bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
        rolled = words
        for k in range(1, size):
            rolled = mixed(rolled[: max(0, len(words) - k)] * _factor + words[k:])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                name = np.uint64(b - a)
                for w in words[a:b]:
                    name = mixed(np.array([name * _factor + w]))[0]
                yield np.array([name], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def minima(names: np.ndarray, count: int) -> np.ndarray:
    """The least value of the set under each of ``count`` permutations."""
    folded = (names ^ (names >> np.uint64(32))).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 18) // count)
    for a in range(0, len(folded), step):
        part = folded[a : a + step]
        found = part[None, :] * _scales[:count, None] + _shifts[:count, None]
        out = np.minimum(out, found.min(axis=1))
    return out


def bucket_names(names: np.ndarray) -> list[int]:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in minima(names, BANDS * ROWS).astype(np.uint64).reshape(BANDS, ROWS).T:
        keys = mixed(keys * _factor + row)
    return keys.view(np.int64).tolist()


def packed_bits(names: np.ndarray) -> np.ndarray:
    """The low bits of the mixed minima. The low bits of a minimum itself follow from those of
    its shingle alike under all permutations; mixed with the permutation's number, unequal
    minima agree in them by chance, each on its own."""
    found = mixed(minima(names, PERMUTATIONS).astype(np.uint64) | _numbers)
    planes = [np.packbits((found >> np.uint64(k)) & np.uint64(1) != 0) for k in range(BITS)]
    return np.concatenate(planes).view(np.int64)


def texts_of(docs: DataFrame) -> DataFrame:
    ready(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_id (a digest of the set) and bucket keys; null without shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids, keys = [], [], []
            for names in shingle_sets(batch.column(1).to_pylist(), size):
                some = len(names) > 0
                counts.append(len(names))
                ids.append(hashlib.blake2b(names, digest_size=16).digest() if some else None)
                keys.append(bucket_names(names) if some else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_id", "keys"],
            )

    return texts_of(docs).mapInArrow(
        run, "doc_id long, n_shingles long, set_id binary, keys array<long>"
    )


def sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc, n, packed, shingles, keys): every document's set, its size, its packed low bits and
    its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = pa.list_(pa.int64())
        kinds = (pa.int64(), pa.int64(), many, many, many)
        for batch in batches:
            found = list(shingle_sets(batch.column(1).to_pylist(), size))
            columns = (
                batch.column(0).to_pylist(),
                [len(x) for x in found],
                [packed_bits(x) for x in found],
                [x.view(np.int64) for x in found],
                [bucket_names(x) for x in found],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc", "n", "packed", "shingles", "keys"],
            )

    return texts_of(docs).mapInArrow(
        run,
        "doc long, n long, packed array<long>, shingles array<long>, keys array<long>",
    )


def facts_of(rows: DataFrame) -> DataFrame:
    """``rows`` with the packed longs as columns of their own, known not to be null: conditions
    on them stay short enough for the JVM to compile."""
    longs = [F.coalesce(F.col("packed")[i], F.lit(0)).alias(f"p{i}") for i in range(LONGS)]
    return rows.select(*[c for c in rows.columns if c != "packed"], *longs)


def differing(a: str, b: str) -> Column:
    """How many of the permutations' low bits differ."""
    out = None
    for i in range(PLANE):
        x = None
        for at in range(i, LONGS, PLANE):
            y = F.col(f"{a}.p{at}").bitwiseXOR(F.col(f"{b}.p{at}"))
            x = y if x is None else x.bitwiseOR(y)
        out = F.bit_count(x) if out is None else out + F.bit_count(x)
    return out


def most_differing(similarity: float) -> int:
    """Differing low bits at which the estimate, corrected for those that are equal by chance,
    is still ``similarity``: (equal - c) / (1 - c) for a chance of c."""
    return math.floor(PERMUTATIONS * (1 - similarity) * (1 - 2.0**-BITS) + 1e-9)


def may_link(a: str, b: str, threshold: int, slack: float = SLACK) -> Column:
    """Sizes and estimate do not speak against the pair."""
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= threshold * F.greatest(f"{a}.n", f"{b}.n")
    return sizes & (differing(a, b) <= most_differing(threshold / 100 - slack))


def confirmed(pairs: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """Pairs (x, y) that reach the threshold on their sets."""
    x = full.select(F.col("doc").alias("x"), F.col("shingles").alias("of_x"))
    y = full.select(F.col("doc").alias("y"), F.col("shingles").alias("of_y"))
    shared = F.size(F.array_intersect("of_x", "of_y"))
    union = F.size("of_x") + F.size("of_y") - shared
    return (
        pairs.join(x, "x").join(y, "y").where(100 * shared >= threshold * union).select("x", "y")
    )


def components(links: DataFrame) -> DataFrame:
    """(doc, component) for every document in ``links`` (x, y): the smallest document that can
    be reached. Each round takes the smallest component among the neighbours, then the
    component of that one, so paths shorten by half and more."""
    both = links.select(F.col("x").alias("doc"), F.col("y").alias("to")).union(
        links.select(F.col("y").alias("doc"), F.col("x").alias("to"))
    )
    both = materialize(both.distinct(), "links")
    state = both.groupBy("doc").agg(F.min("to").alias("to"))
    state = materialize(state.select("doc", F.least("doc", "to").alias("component")), "components")
    while True:
        near = (
            both.join(state.withColumnRenamed("doc", "to"), "to")
            .groupBy("doc")
            .agg(F.min("component").alias("near"))
        )
        step = state.join(near, "doc").select(
            "doc", "component", F.least("component", "near").alias("new")
        )
        jump = state.select(F.col("doc").alias("new"), F.col("component").alias("next"))
        step = step.join(jump, "new", "left").select(
            "doc", "component", F.least("new", "next").alias("new")
        )
        step = materialize(step, "components")
        changed = step.where("new <> component").limit(1).count()
        state = step.select("doc", F.col("new").alias("component"))
        if not changed:
            return state


def joined_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after ``links`` (x, y): only the graph of the components that they connect
    is searched."""
    x = found.select(F.col("doc").alias("x"), F.col("component").alias("of_x"))
    y = found.select(F.col("doc").alias("y"), F.col("component").alias("of_y"))
    between = links.join(x, "x").join(y, "y").where("of_x <> of_y")
    moved = components(between.select(F.col("of_x").alias("x"), F.col("of_y").alias("y")))
    moved = moved.select(F.col("doc").alias("component"), F.col("component").alias("moved"))
    return found.join(moved, "component", "left").select(
        "doc", F.coalesce("moved", "component").alias("component")
    )


def open_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, doc, component, m, outside, big): members of buckets that hold several components,
    with the bucket's size, its members outside the largest component, and that component."""
    of = found.withColumnRenamed("doc", "_doc")
    placed = members.join(of, F.col("doc") == F.col("_doc"), "left").select(
        "key", "doc", F.coalesce("component", "doc").alias("component")
    )
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
    parts = (
        parts.groupBy("key")
        .agg(F.sum("m").alias("m"), F.count("*").alias("parts"),
             (F.sum("m") - F.max("m")).alias("outside"),
             F.max_by("component", F.struct("m", "component")).alias("big"))
        .where("parts > 1")
        .drop("parts")
    )
    return placed.join(parts, "key")


def best_pairs(open_: DataFrame, facts: DataFrame, threshold: int, turn: int) -> DataFrame:
    """For each member the most similar of its neighbours, in a random order, in its buckets."""
    part = F.pmod(F.xxhash64("doc", F.lit(turn)), F.ceil(F.col("m") / TURN_MEMBERS))
    order = Window.partitionBy("key", "part").orderBy(F.xxhash64("key", "doc", F.lit(turn)), "doc")
    near = F.lead(F.struct("doc", "component")).over(order)
    facts = facts_of(facts)
    pairs = (
        open_.withColumn("part", part)
        .select("doc", "component", near.alias("other"))
        .where(F.col("other.component") != F.col("component"))
        .select(F.least("doc", "other.doc").alias("x"), F.greatest("doc", "other.doc").alias("y"))
        .distinct()
    )
    rated = (
        pairs.join(facts.alias("a"), F.col("x") == F.col("a.doc"))
        .join(facts.alias("b"), F.col("y") == F.col("b.doc"))
        .where(may_link("a", "b", threshold))
        .select("x", "y", (-differing("a", "b")).alias("rate"))
    )
    both = rated.union(rated.select(F.col("y").alias("x"), F.col("x").alias("y"), "rate"))
    best = both.groupBy("x").agg(F.max_by("y", F.struct("rate", -F.col("y"))).alias("y"))
    return best.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def cross_pairs(open_: DataFrame, facts: DataFrame, threshold: int, slack: float) -> DataFrame:
    """All pairs of different components of a bucket that may link. At least one of the two is
    outside the bucket's largest component. Outside members are dealt into blocks, and the
    bucket's members go to each of them."""
    rows = open_.join(facts, "doc").withColumn("big", F.col("component") == F.col("big"))
    rows = facts_of(materialize(rows, "open-facts"))
    blocks = F.ceil(F.col("outside") / BLOCK)
    a = rows.where("NOT big").withColumn("block", F.pmod(F.xxhash64("doc"), blocks)).alias("a")
    b = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    b = b.alias("b")
    return (
        a.join(
            b,
            (F.col("a.key") == F.col("b.key"))
            & (F.col("a.block") == F.col("b.block"))
            & (F.col("a.component") != F.col("b.component"))
            & (F.col("b.big") | (F.col("a.doc") < F.col("b.doc")))
            & may_link("a", "b", threshold, slack)
            # a pair counts in the first bucket that both have
            & (F.col("a.key") == F.array_min(F.array_intersect("a.keys", "b.keys"))),
        )
        .select(F.col("a.doc").alias("x"), F.col("b.doc").alias("y"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (``doc_id``, ``text``;
    others are ignored); linked are documents with ``100 * shared >= threshold * union``.

    A text without words has no shingle and is linked with nothing; so is a row without a
    doc_id, whose component is null and which is kept. Rows that share a doc_id are one
    document. An empty table gives no rows.
    """
    rows = materialize(signatures(docs, size), "signatures")
    named = rows.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(
        named.groupBy("set_id").agg(F.min("doc_id").alias("doc"), F.first("keys").alias("keys")),
        "classes",
    )
    banded = classes.select("doc", F.explode("keys").alias("key"))
    buckets = (
        banded.groupBy("key")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
        .where("low < high")
        .select("key")
    )
    members = materialize(banded.join(buckets, "key"), "members")
    inside = materialize(members.select("doc").distinct(), "in-buckets")
    full = materialize(
        sets(docs.join(inside, docs["doc_id"] == inside["doc"], "left_semi"), size), "sets"
    )
    facts = full.select("doc", "n", "packed", "keys")
    found = inside.select("doc", F.col("doc").alias("component"))
    for turn in range(TURNS + 2):
        open_ = materialize(open_members(members, found), "open-members")
        if turn < TURNS:
            pairs = best_pairs(open_, facts, threshold, turn)
        else:
            pairs = cross_pairs(open_, facts, threshold, 0.0 if turn == TURNS else SLACK)
        new = materialize(confirmed(pairs, full, threshold), "links")
        if new.limit(1).count():
            found = materialize(joined_components(found, new), "components")

    class_of = classes.select(F.col("set_id").alias("_set"), F.col("doc").alias("_first"))
    linked = found.select(F.col("doc").alias("_linked"), F.col("component").alias("_component"))
    joined = rows.join(class_of, F.col("set_id") == F.col("_set"), "left").join(
        linked, F.col("_first") == F.col("_linked"), "left"
    )
    component = F.when(
        F.col("doc_id").isNotNull(), F.coalesce("_component", "_first", "doc_id")
    ).alias("component_id")
    return joined.select("doc_id", "n_shingles", component).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
