"""Token ids on disk, with a minimal perfect hash from document key to place.

A store is a folder of Parquet files. Each row is one block: the raw ids of consecutive
documents in key order, as little-endian integers, and an index over the block's keys. The
index is a perfect hash in levels of bit arrays: a key sets one bit per level until it meets a
bit of its own, and the rank of that bit is its slot. Slots hold a 32-bit fingerprint of the
key, the first row of that key and the number of rows. A lookup tests about two bits, compares
the fingerprint and cuts the ids out of the payload, whatever the size of the block.

Blocks end at ``BLOCK_IDS`` ids, so a row is bounded unless a single document is longer. They
are written by Spark's own writer, which commits whole tasks: a lost executor leaves no part
of a block behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmart.llm.common import part_count, ready
from jobmart.llm.tokens import encoder, slices

BLOCK_IDS = 2_000_000
#: Bits of a level for each key that is still without a slot.
SPARSE = 2.0
STORE_SCHEMA = (
    "shard int, block int, first_key long, last_key long, n_rows long, n_ids long,"
    " id_bytes int, keys binary, index binary, ends binary, payload binary"
)
READ_SCHEMA = "shard int, block int, row long, doc_id long, at long, n_tokens long, ids_crc32 long"


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over keys, one family member per seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        rest = keys
        while len(rest):
            size = max(64, int(SPARSE * len(rest)))
            at = mix(rest, len(levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at.astype(np.int64)]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not built in may get any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = (mix(keys[left], i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[i] + self.ranks[i][at[hit]]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1_000) >> np.uint64(32)).astype("<u4")


def pack_index(keys: np.ndarray) -> bytes:
    """Index over sorted keys, which may repeat."""
    distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
    found = PerfectHash.build(distinct.astype(np.uint64))
    slots = found.slots(distinct.astype(np.uint64))
    table = np.zeros((3, len(distinct)), "<u4")
    table[:, slots] = fingerprints(distinct), first, count
    sizes = np.array([len(found.levels), *map(len, found.levels)], "<u4")
    bits = b"".join(np.packbits(x).tobytes() for x in found.levels)
    return sizes.tobytes() + bits + table.tobytes()


class BlockIndex:
    def __init__(self, data: bytes):
        (n,) = np.frombuffer(data, "<u4", 1)
        sizes = np.frombuffer(data, "<u4", int(n), 4)
        at, levels = 4 * (int(n) + 1), []
        for size in map(int, sizes):
            raw = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
            levels.append(np.unpackbits(raw, count=size).astype(bool))
            at += (size + 7) // 8
        self.hash = PerfectHash(levels)
        self.prints, self.first, self.count = np.frombuffer(data, "<u4", -1, at).reshape(3, -1)

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key, 0 rows for one that is not here."""
        slots = self.hash.slots(keys.astype(np.uint64))
        known = slots >= 0
        known[known] = self.prints[slots[known]] == fingerprints(keys[known])
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[known], count[known] = self.first[slots[known]], self.count[slots[known]]
        return first, count


def _block(shard: int, block: int, keys: list[int | None], rows: list[bytes]) -> dict:
    known = np.array([k for k in keys if k is not None], np.int64)
    ids = np.frombuffer(b"".join(rows), "<u4")
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return {
        "shard": shard, "block": block,
        "first_key": int(known[0]) if len(known) else None,
        "last_key": int(known[-1]) if len(known) else None,
        "n_rows": len(rows), "n_ids": len(ids), "id_bytes": width,
        "keys": known.tobytes(), "index": pack_index(known),
        "ends": np.cumsum([len(r) // 4 for r in rows], dtype="<u8").tobytes(),
        "payload": ids.astype(f"<u{width}").tobytes(),
    }


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Write the ids of ``docs`` (``doc_id``, ``text``; others are ignored) in key order.

    A null text counts as empty. Rows without a key come first and are in no index. Rows that
    share a key stay together, ordered by text, and a lookup returns all of them. An empty
    table gives a store without blocks.
    """
    spark = docs.sparkSession
    ready(spark)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    parts = part_count(rows)
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, size = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        held: list[bytes] = []
        schema = _arrow(STORE_SCHEMA)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for key, ids in zip(
                    doc_ids[a:b], encoder(tokenizer).encode(texts[a:b]), strict=True
                ):
                    if held and size + len(ids) > 4 * BLOCK_IDS:
                        yield pa.RecordBatch.from_pylist(
                            [_block(shard, block, keys, held)], schema
                        )
                        keys, held, size, block = [], [], 0, block + 1
                    keys.append(key)
                    held.append(ids + end)
                    size += len(ids) + len(end)
        if held:
            yield pa.RecordBatch.from_pylist([_block(shard, block, keys, held)], schema)

    ordered.mapInArrow(encode, STORE_SCHEMA).write.option("compression", "zstd").parquet(path)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


def _payload(row: dict) -> np.ndarray:
    return np.frombuffer(row["payload"], f"<u{row['id_bytes']}")


def block_rows(row: dict, keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, key, ids) of every row of the block that has one of ``keys``."""
    ids, ends = _payload(row), np.frombuffer(row["ends"], "<u8").astype(np.int64)
    shift = int(row["n_rows"]) - len(row["keys"]) // 8
    first, count = BlockIndex(row["index"]).rows(keys)
    for key, a, n in zip(keys.tolist(), (first + shift).tolist(), count.tolist(), strict=True):
        for r in range(a, a + n):
            yield r, key, ids[ends[r - 1] if r else 0 : ends[r]]


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the store, found through the index: doc_id, start (ids of all rows before
    it), n_tokens and the crc32 of its ids as unsigned 32-bit integers. Rows without a key are
    read in their order."""
    blocks = spark.read.schema(STORE_SCHEMA).parquet(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.unique(np.frombuffer(row["keys"], "<i8"))
                ids, ends = _payload(row), np.frombuffer(row["ends"], "<u8").tolist()
                found = [
                    (r, None, ids[ends[r - 1] if r else 0 : ends[r]])
                    for r in range(int(row["n_rows"]) - len(row["keys"]) // 8)
                ]
                found += block_rows(row, keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(found), pa.int32()),
                        pa.array([row["block"]] * len(found), pa.int32()),
                        pa.array([r for r, _, _ in found], pa.int64()),
                        pa.array([k for _, k, _ in found], pa.int64()),
                        pa.array([ends[r] - len(x) for r, _, x in found], pa.int64()),
                        pa.array([len(x) for _, _, x in found], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4")) for _, _, x in found], pa.int64()),
                    ],
                    schema=_arrow(READ_SCHEMA),
                )

    # Blocks before a block: first the shards, one row each, then the blocks of a shard.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(
        F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    shards = shards.select("shard", before.alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("b"))
        .join(shards, "shard")
        .select("shard", "block", (F.col("shard_start") + F.col("b")).alias("block_start"))
    )
    rows = blocks.mapInArrow(read, READ_SCHEMA)
    return rows.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_keys(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """Ids of the documents with the given keys (doc_id, ids); reads only blocks whose range
    holds one of them. Keys that are not stored give no row."""
    wanted = np.unique(np.array(keys, np.int64))
    blocks = spark.read.schema(STORE_SCHEMA).parquet(path)
    inside = F.lit(False)
    for key in wanted.tolist():
        inside = inside | ((F.col("first_key") <= key) & (F.col("last_key") >= key))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = list(block_rows(row, wanted))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for _, k, _ in found], pa.int64()),
                        pa.array([x.tolist() for _, _, x in found], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "ids"],
                )

    return blocks.where(inside).mapInArrow(read, "doc_id long, ids array<long>")
