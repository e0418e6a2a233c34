"""Packing of token runs into sequences of a fixed length.

Documents are cut into pieces only where they are longer than a sequence. Pieces are dealt to
shards by a hash, so a hot source or a group of copies does not matter. In a shard every piece
first goes to the bin it fits best, longest piece first. Then underfull bins are drawn in pairs,
and in each pair the emptier one gives a piece away, or two or one for a shorter one, so that
the sum of squared fills grows by as much as that pair allows, until bins are empty. The search
ends at the least number of bins that the total length permits, or when many rounds in a row
emptied no bin. A second round deals the bins that stayed underfull anew, in shards of whole
bins, since what is left over in one shard fills gaps of another.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmart.llm.common import materialize, ready
from jobmart.llm.tokens import encoder, slices

SHARD_PIECES = 40_000
#: The search ends after this many rounds without a bin emptied.
PATIENCE = 120
#: Pieces of a bin that one round tries; bins with more of them offer others in other rounds.
OFFERED = 8
#: Pairs of bins whose exchanges are compared at once.
PAIRS = 4096
SEED = 20_250_207
PIECES = "doc_id long, copy long, piece int, start long, length int, ids_crc32 long"
BINS = "doc_id long, copy long, piece int, length int, bin long, fill int"
#: A bin's number is its round, its shard and its place in the shard.
PLACE_BITS = 24


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Rows of ``PIECES``: each document's ids and ``end_id``, cut every ``capacity`` ids."""
    ready(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        F.monotonically_increasing_id().alias("copy"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts, copies = (batch.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            for a, b in slices(texts):
                for i, ids in enumerate(encoder(tokenizer).encode(texts[a:b]), a):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append(
                            (doc_ids[i], copies[i], n, at // 4, len(part) // 4, zlib.crc32(part))
                        )
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[x.split()[0] for x in PIECES.split(", ")],
            )

    return rows.mapInArrow(cut, PIECES)


class Bins:
    """Bins of one shard, found by their room. An item is (length, number)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.content: list[list[tuple[int, int]]] = []
        self.room: list[int] = []
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.rooms = 0  # bit r is set where some bin has room r

    def put_room(self, b: int, room: int) -> None:
        old = self.room[b]
        self.by_room[old].discard(b)
        if not self.by_room[old]:
            self.rooms &= ~(1 << old)
        self.room[b] = room
        self.by_room[room].add(b)
        self.rooms |= 1 << room

    def open(self, items: list[tuple[int, int]]) -> int:
        room = self.capacity - sum(x for x, _ in items)
        self.content.append(items)
        self.room.append(room)
        self.by_room[room].add(len(self.room) - 1)
        self.rooms |= 1 << room
        return len(self.room) - 1

    def tightest(self, length: int, without: int = -1) -> int:
        """The bin with the least room that still takes ``length``, or -1."""
        mask = self.rooms >> length
        while mask:
            r = length + (mask & -mask).bit_length() - 1
            for b in self.by_room[r]:
                if b != without:
                    return b
            mask &= mask - 1
            if r == self.capacity:
                break
            mask = (self.rooms >> (r + 1)) << (r + 1 - length)
        return -1

    def best_fit(self, items: list[tuple[int, int]]) -> None:
        for item in sorted(items, reverse=True):
            b = self.tightest(item[0])
            if b < 0:
                self.open([item])
            else:
                self.content[b].append(item)
                self.put_room(b, self.room[b] - item[0])


def _offers(
    content: list[list[tuple[int, int]]], bins: np.ndarray, random: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and numbers of up to ``OFFERED`` pieces of each bin, drawn anew, 0 and -1 beyond."""
    lengths = np.zeros((len(bins), OFFERED), np.int32)
    numbers = np.full((len(bins), OFFERED), -1, np.int64)
    for row, b in enumerate(bins):
        some = content[b]
        if len(some) > OFFERED:
            some = [some[i] for i in random.choice(len(some), OFFERED, replace=False)]
        for k, (length, number) in enumerate(some):
            lengths[row, k], numbers[row, k] = length, number
    return lengths, numbers


def _exchanges(
    given: np.ndarray, taken: np.ndarray, room: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of bins the greatest feasible gain of the fuller one, and what to exchange:
    two places of pieces of the emptier bin (the second -1 for a single piece) for one place of
    the fuller bin (-1 for none)."""
    first, second = np.triu_indices(OFFERED, 1)
    one = np.arange(OFFERED)
    sums = np.concatenate([given, given[:, first] + given[:, second]], axis=1)
    # A pair with an empty place is the single piece over again.
    sums[:, OFFERED:][(given[:, first] == 0) | (given[:, second] == 0)] = 0
    back = np.concatenate([np.zeros((len(taken), 1), taken.dtype), taken], axis=1)
    gain = sums[:, :, None] - back[:, None, :]
    bad = (gain <= 0) | (gain > room[:, None, None]) | (sums == 0)[:, :, None]
    bad[:, :, 1:] |= (taken == 0)[:, None, :]
    gain[bad] = 0
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    which, place = np.divmod(best, OFFERED + 1)
    p = np.concatenate([one, first])[which]
    q = np.concatenate([np.full(OFFERED, -1), second])[which]
    return flat[np.arange(len(flat)), best], p, q, place - 1


def search(bins: Bins, random: np.random.Generator, patience: int = PATIENCE) -> int:
    """Exchange pieces between underfull bins until none can be emptied; returns how many were.

    Every exchange moves length from an emptier to a fuller bin, so squared fill grows with each.
    """
    content, capacity = bins.content, bins.capacity
    room = np.array(bins.room, np.int64)
    total = int((capacity - room).sum())
    used = int((room < capacity).sum())
    least, emptied, idle = -(-total // capacity), 0, 0
    while used > least and idle < patience:
        idle += 1
        under = np.flatnonzero((room > 0) & (room < capacity))
        if len(under) < 2:
            break
        # One round in two sets the emptiest bins against the others, else all are drawn.
        if idle % 2:
            by = under[np.argsort(-room[under], kind="stable")]
            half = len(by) // 2
            givers, takers = by[:half], random.permutation(by[half:])[:half]
        else:
            drawn = random.permutation(under)
            half = len(drawn) // 2
            givers, takers = drawn[:half], drawn[half : 2 * half]
            wrong = room[givers] < room[takers]
            givers, takers = np.where(wrong, takers, givers), np.where(wrong, givers, takers)
        for at in range(0, half, PAIRS):
            a, b = givers[at : at + PAIRS], takers[at : at + PAIRS]
            given, given_no = _offers(content, a, random)
            taken, taken_no = _offers(content, b, random)
            gain, p, q, t = _exchanges(given, taken, room[b])
            for i in np.flatnonzero(gain):
                x, y = int(a[i]), int(b[i])
                out = {int(given_no[i, p[i]])} | ({int(given_no[i, q[i]])} if q[i] >= 0 else set())
                back = int(taken_no[i, t[i]]) if t[i] >= 0 else -1
                moved = [g for g in content[x] if g[1] in out]
                returned = [g for g in content[y] if g[1] == back]
                content[x] = [g for g in content[x] if g[1] not in out] + returned
                content[y] = [g for g in content[y] if g[1] != back] + moved
                room[x] += gain[i]
                room[y] -= gain[i]
                if not content[x]:
                    emptied, used, idle = emptied + 1, used - 1, 0
    bins.room = room.tolist()
    return emptied


def pack_shard(
    lengths: list[int], capacity: int, groups: list[int] | None = None, patience: int = PATIENCE
) -> list[int]:
    """Bin number of each piece. ``groups`` names the bins that pieces already share: these
    are kept at the start and only searched. Equal input gives equal bins, so that a task that
    is run again after a loss gives the same; ``patience`` 0 searches nothing."""
    bins = Bins(capacity)
    items = [(int(x), i) for i, x in enumerate(lengths)]
    if groups is None:
        bins.best_fit(items)
    else:
        held: dict[int, list[tuple[int, int]]] = {}
        for item, g in zip(items, groups, strict=True):
            held.setdefault(g, []).append(item)
        for some in held.values():
            bins.open(some)
    search(bins, np.random.default_rng(SEED), patience)
    out = [0] * len(items)
    for b, some in enumerate(bins.content):
        for _, i in some:
            out[i] = b
    return out


def _packed(shard: int, pdf: pd.DataFrame, capacity: int, again: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "copy", "piece"], kind="stable")
    groups = pd.factorize(pdf["bin"])[0].tolist() if again else None
    found = pack_shard(pdf["length"].tolist(), capacity, groups)
    pdf["bin"] = [(shard << PLACE_BITS | b) << 2 | again for b in found]
    pdf["fill"] = pdf.groupby("bin")["length"].transform("sum").astype("int32")
    return pdf[[x.split()[0] for x in BINS.split(", ")]]


def deal(rows: DataFrame, key: list[str], again: bool, capacity: int) -> DataFrame:
    n = rows.count()
    shards = max(1, math.ceil(n / SHARD_PIECES))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(int(again)), *key), F.lit(shards)))

    def pack(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _packed(int(k[0]), pdf, capacity, again)

    return dealt.groupBy("shard").applyInPandas(pack, BINS)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack whole ``docs`` (``doc_id``, ``text``; other columns are ignored) into sequences.

    A null text is empty and still has its ``end_id``. Repeated rows are packed as often as
    they occur, a null ``doc_id`` stays null. An empty table gives no rows. Returns doc_id,
    piece, start, length, ids_crc32, sequence_id, offset.
    """
    cut = materialize(pieces(docs, tokenizer, capacity, end_id), "pieces")
    key = ["doc_id", "copy", "piece"]
    part = cut.where(F.col("length") < capacity).select(*key, "length")
    first = materialize(deal(part.withColumn("bin", F.lit(0)), key, False, capacity), "bins")
    # Bins with little room are done; the others are searched once more, dealt by whole bins.
    done = first.where(F.col("fill") * 16 >= capacity * 15)
    left = first.where(F.col("fill") * 16 < capacity * 15)
    placed = done.unionByName(deal(left, ["bin"], True, capacity)).select(*key, "bin")
    placed = materialize(placed, "placed")
    whole = cut.where(F.col("length") == capacity).select(
        *cut.columns,
        (F.monotonically_increasing_id() * 4 + 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    inside = Window.partitionBy("bin").orderBy("doc_id", "copy", "piece")
    before = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    shared = (
        cut.where(F.col("length") < capacity)
        .join(placed, [cut[k].eqNullSafe(placed[k]) for k in key])
        .select(*[cut[c] for c in cut.columns], placed["bin"])
        .withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
        .withColumnRenamed("bin", "sequence_id")
    )
    return whole.unionByName(shared).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        "sequence_id", "offset",
    )
