"""Removal of every byte covered by a long enough string that starts earlier in the corpus.

Positions are ranked by prefix doubling: the name of the first 2h bytes at a position is made
of the names of its first h bytes and of those h bytes on. Names are 64-bit fingerprints of
the bytes, so they mean the same in every task. Short names are made where the text is
read; from there on Spark sorts positions by pairs of names.

Round 1 sorts a sparse set of positions. Of the ``SEED``-byte names in a window of ``least``
bytes the smallest, the first of equals, is the window's seed; equal windows have the same seed
at the same place. The windows of one seed are neighbours, a block. Blocks are sorted by
(seed name, name of the whole block): a block whose pair occurred earlier is removed whole,
and a block whose seed is unique has only unique windows and is done. Round 2 does the same
with what is left in steps of ``STEP`` windows, ranked by the bytes that all windows of a step
share (93 of 100), and round 3 with single windows, the threshold. So each round reads only
positions whose shorter prefix is not unique, and the last ones are few: the ends of copies.

All sorts are spilling sorts of a shuffle, groups are read as streams, and of equal pairs in
one batch only the earliest is shuffled, so a passage that stands in a third of all documents
sends one row per batch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmart.llm.common import materialize, new_path, part_count, ready
from jobmart.operators.numbering import number_rows

SEED = 24
#: Bytes of text whose names are made at one time.
BUFFER = 1 << 18
STEP = 8
#: A row's ``more`` holds the further windows, the way to the seed and the mark of a repeat.
LEAD, FLAG = 10, 1 << 24
BLOCK_ROWS = "part long, name long, doc long, at long, more int"
PLACES = "doc long, at long, more int, sure boolean"
MORE = (1 << LEAD) - 1

_letters = np.random.default_rng(20_250_101).integers(0, 2**64, 256, np.uint64)


def pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Names of pairs of names."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(salt * 0xD1B54A32D192ED03 % 2**64))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


class Names:
    """Names of the first h bytes at every position of a buffer, by doubling."""

    def __init__(self, data: np.ndarray):
        self.levels = {1: _letters[data]}

    def of(self, h: int) -> np.ndarray:
        """For positions from which h bytes follow."""
        if h not in self.levels:
            half = 1 << (h - 1).bit_length() - 1
            names = self.of(half)
            shift = h - half
            n = len(self.levels[1]) - h + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            self.levels[h] = pair(names[:n], names[shift : shift + n], h)
        return self.levels[h]


def windows_min(keys: np.ndarray, size: int) -> np.ndarray:
    """The least key of every run of ``size`` keys."""
    reach = 1
    while 2 * reach <= size:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    rest = size - reach
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def buffers(texts: list[bytes], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into buffers: (bytes, text number, place in the text) per position, where
    a place of -1 marks a position from which no window of the text starts. A text longer than
    a buffer is read in parts that overlap by a window less a byte."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        lengths = [len(x) for _, _, x in held]
        number = np.repeat([i for i, _, _ in held], lengths)
        place = np.concatenate([np.arange(a, a + len(x)) for _, a, x in held])
        for end in np.cumsum(lengths):
            place[max(0, end - least + 1) : end] = -1
        return data, number, place

    for i, text in enumerate(texts):
        if len(text) < least:
            continue
        for a in range(0, len(text) - least + 1, BUFFER):
            part = text[a : a + BUFFER + least - 1]
            held.append((i, a, part))
            size += len(part)
            if size >= BUFFER:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def blocks(texts: list[bytes], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, place, further windows and way to the seed, seed name, block name) of every
    block."""
    span = least - SEED + 1
    for data, number, place in buffers(texts, least):
        names = Names(data)
        seeds = names.of(SEED)
        low = np.arange(len(seeds), dtype=np.uint64)
        bits = np.uint64(24)  # a buffer has fewer positions than that
        keys = (seeds >> bits << bits) | low
        best = (windows_min(keys, span) & np.uint64((1 << 24) - 1)).astype(np.int64)
        start = np.flatnonzero(place[: len(best)] >= 0)
        best = best[start]
        fresh = np.ones(len(start), bool)
        # A new block where the seed changes or the windows are not neighbours in a text.
        fresh[1:] = (
            (best[1:] != best[:-1])
            | (start[1:] != start[:-1] + 1)
            | (place[start[1:]] != place[start[:-1]] + 1)
        )
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(start)) - 1
        a, b = start[first], start[last]
        whole = names.of(least)
        name = pair(whole[a], whole[b] + (b - a).astype(np.uint64), 7)
        yield number[a], place[a], b - a | best[first] - a << LEAD, seeds[best[first]], name


def earliest(names: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True for rows that are not the earliest with their names in these arrays."""
    order = np.lexsort((at, doc, *names))
    same = np.ones(len(order), bool)
    same[:1] = False
    for x in names:
        same[1:] &= x[order][1:] == x[order][:-1]
    out = np.zeros(len(order), bool)
    out[order] = same
    return out


def _batch(columns: list[np.ndarray], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _rows(doc, at, more, part, name) -> pa.RecordBatch:
    """Rows of ``BLOCK_ROWS``. One that has an equal, earlier row in the batch is marked and
    dealt by its document instead of its name."""
    again = earliest([part, name], doc, at)
    part = np.where(again, doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), part)
    return _batch(
        [_signed(part), _signed(name), doc, at, more + FLAG * again],
        ["part", "name", "doc", "at", "more"],
        [pa.int64()] * 4 + [pa.int32()],
    )


def block_rows(texts: DataFrame, least: int) -> DataFrame:
    """Rows of ``BLOCK_ROWS``; ``more`` carries ``FLAG`` if an equal block is earlier in the
    same batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            found = list(blocks(batch.column(1).to_pylist(), least))
            if not found:
                continue
            number, at, more, seed, name = (np.concatenate(x) for x in zip(*found, strict=True))
            yield _rows(docs[number], at, more, seed, name)

    return texts.mapInArrow(run, BLOCK_ROWS)


def rank_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks sorted by (part, name, doc, at) those that are removed for sure and those
    whose seed stands with other blocks, which round 2 decides. Holds one row between batches:
    a seed's first block, until another one of that seed turns up or not."""
    names, kinds = ["doc", "at", "more", "sure"], [pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    before: tuple[int, int] | None = None
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
    many: int | None = None  # the seed at the end of the last batch, if it has several blocks
    for batch in batches:
        part, name, doc, at, more = (c.to_numpy() for c in batch.columns)
        flagged = more >= FLAG
        if flagged.any():
            n = int(flagged.sum())
            yield _batch(
                [doc[flagged], at[flagged], more[flagged] - FLAG, np.ones(n, bool)], names, kinds
            )
            part, name, doc, at, more = (x[~flagged] for x in (part, name, doc, at, more))
        if not len(part):
            continue
        same = np.zeros(len(part), bool)
        same[1:] = (part[1:] == part[:-1]) & (name[1:] == name[:-1])
        same[0] = before == (int(part[0]), int(name[0]))
        before = int(part[-1]), int(name[-1])
        if same.any():
            yield _batch(
                [doc[same], at[same], more[same], np.ones(int(same.sum()), bool)], names, kinds
            )
        first = [
            np.concatenate([h, x[~same]])
            for h, x in zip(held, (part, doc, at, more.astype(np.int64)), strict=True)
        ]
        seeds = first[0]
        if not len(seeds):
            continue
        alone = np.ones(len(seeds), bool)
        alone[1:] &= seeds[1:] != seeds[:-1]
        alone[:-1] &= seeds[1:] != seeds[:-1]
        if many is not None:
            alone &= seeds != many
        # The last block waits if its seed may go on.
        wait = alone[-1]
        many = None if wait else int(seeds[-1])
        keep = ~alone
        if keep.any():
            yield _batch([x[keep] for x in first[1:]] + [np.zeros(int(keep.sum()), bool)],
                         names, kinds)
        held = [x[-1:] if wait else x[:0] for x in first]


def step_rows(texts: DataFrame, least: int, step: int) -> DataFrame:
    """Rows of ``BLOCK_ROWS`` for runs of up to ``step`` windows of the open places (doc, data,
    open), aligned to the seed: ``part`` names the bytes that all windows of a full run share."""
    half = 1 << (least - 1).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, places = batch.column(0).to_numpy(), batch.column(2)
            owner = np.repeat(np.arange(len(docs)), np.diff(places.offsets.to_numpy()))
            bounds = np.searchsorted(owner, np.arange(len(docs) + 1))
            ats = places.flatten().field("at").to_numpy()
            mores = places.flatten().field("more").to_numpy().astype(np.int64)
            ends, leads = ats + (mores & MORE) + 1, mores >> LEAD
            found: list[tuple] = []
            held: list[tuple] = []
            size = 0

            def ranked(held: list[tuple]) -> tuple:
                data = np.frombuffer(b"".join(x[0] for x in held), np.uint8)
                shift = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
                mine = [x[2] for x in held]
                base = np.repeat(shift, [len(m) for m in mine])
                origin = np.repeat([x[1] for x in held], [len(m) for m in mine])
                top = np.repeat([x[1] + len(x[0]) - least + 1 for x in held],
                                [len(m) for m in mine])
                rows = np.concatenate(mine)
                low, high = np.maximum(ats[rows], origin), np.minimum(ends[rows], top)
                count = np.maximum(high - low, 0)
                place = np.repeat(np.arange(len(rows)), count)
                p = low[place] + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
                seed = (ats + leads)[rows][place]
                run_no = (seed - p) // step
                fresh = np.ones(len(p), bool)
                fresh[1:] = (place[1:] != place[:-1]) | (run_no[1:] != run_no[:-1])
                a = np.flatnonzero(fresh)
                b = np.append(a[1:], len(p)) - 1
                move = (base - origin)[place]
                first, last = (p + move)[a], (p + move)[b]
                core = (seed - step * run_no + move)[a]
                names = Names(data)
                ahead = names.of(half)
                part = names.of(least - step + 1)[core]

                def whole(x: np.ndarray) -> np.ndarray:
                    return pair(ahead[x + least - half], ahead[x], 11)

                extent = (last - first << LEAD | core - first).astype(np.uint64)
                name = pair(whole(first), whole(last) + extent, 7)
                more = last - first | core - first << LEAD
                return docs[owner[rows][place]][a], p[a], more, part, name

            data = batch.column(1)
            for i in range(len(docs)):
                mine = np.arange(bounds[i], bounds[i + 1])
                text = data[i].as_py()
                for a in range(0, len(text) - least + 1, BUFFER):
                    here = mine
                    if len(text) > BUFFER:
                        here = mine[(ends[mine] > a) & (ats[mine] < a + BUFFER)]
                    if len(here):
                        part = text[a : a + BUFFER + least - 1]
                        held.append((part, a, here))
                        size += len(part)
                    if size >= BUFFER:
                        found.append(ranked(held))
                        held, size = [], 0
            if held:
                found.append(ranked(held))
            found = [x for x in found if len(x[0])]
            if found:
                doc, at, more, part, name = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _rows(doc, at, more, part, name)

    return texts.mapInArrow(run, BLOCK_ROWS)


def ranked_places(rows: DataFrame, parts: int) -> DataFrame:
    """One round: sort by rank pair, then tell repeats from what stays open."""
    return (
        rows.repartition(parts, "part")
        .sortWithinPartitions("part", "name", "doc", "at")
        .mapInArrow(rank_blocks, PLACES)
    )


def by_doc(places: DataFrame) -> DataFrame:
    """The places of a document, as many as its bytes at most."""
    return places.groupBy(F.col("doc").alias("_doc")).agg(
        F.collect_list(F.struct("at", "more", "sure")).alias("places")
    )


def keyed(docs: DataFrame) -> DataFrame:
    """``doc``, the rank of a row, and ``data``, its text's bytes. The rank is doc_id where that
    is a key; else rows are numbered by (doc_id, text), nulls first, and repeated rows follow
    one another."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    twice = ids.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    data = F.coalesce("text", F.lit("")).cast("binary").alias("data")
    if not twice.limit(1).count():
        return docs.select("*", F.col("doc_id").cast("long").alias("doc"), data)
    return number_rows(docs.select("*", data), ["doc_id", "text"], "doc")


def removed(rows: DataFrame, least: int, texts_too: bool) -> tuple[DataFrame, DataFrame]:
    """For rows (doc, data): per row its size, its bytes and the places that round 1 removes, or
    its digest if no round can remove any (and its bytes only with ``texts_too``), and by
    document what the later rounds remove.

    The texts are shuffled once, into a table bucketed by document: the later rounds and the
    last step join their few places to it without moving texts again.
    """
    spark = rows.sparkSession
    ready(spark)
    parts = min(part_count(rows, 32), 100_000)
    texts = rows.select("doc", "data").where(F.octet_length("data") >= least)
    lists = by_doc(ranked_places(block_rows(texts, least), parts)).repartition(parts, "_doc")
    hit = F.col("places").isNotNull()
    joined = rows.repartition(parts, "doc").join(lists, F.col("doc") == F.col("_doc"), "left")
    joined = joined.select(
        *[c for c in rows.columns if c != "data"],
        F.octet_length("data").cast("long").alias("n_bytes"),
        F.when(hit | F.lit(texts_too), F.col("data")).alias("data"),
        F.when(~hit, F.sha2("data", 256)).alias("sha"),
        F.filter("places", lambda x: x["sure"]).alias("gone"),
        F.filter("places", lambda x: ~x["sure"]).alias("open"),
    )
    table = f"suffix_texts_{uuid.uuid4().hex}"
    writer = joined.write.bucketBy(parts, "doc").option("compression", "zstd")
    writer.option("path", new_path(spark, "suffix-texts")).saveAsTable(table)
    seen = spark.table(table)
    second = seen.where(F.size("open") > 0).select("doc", "data", "open")
    second = materialize(ranked_places(step_rows(second, least, STEP), parts), "suffix-steps")
    third = (
        seen.select("doc", "data")
        .join(by_doc(second.where("NOT sure")), F.col("doc") == F.col("_doc"))
        .select("doc", "data", F.col("places").alias("open"))
    )
    third = ranked_places(step_rows(third, least, 1), parts)
    sure = second.where("sure").unionByName(third.where("sure"))
    return seen, by_doc(sure)


def deduplicated(
    docs: DataFrame, least: int = 100, keep: tuple[str, ...] = (), texts_too: bool = False
) -> DataFrame:
    """Per row of ``docs``: doc_id, the columns ``keep``, n_bytes, n_removed, n_spans (maximal
    removed runs), ``kept`` (the remaining bytes; null where nothing was removed, unless
    ``texts_too``) and kept_sha256.

    A string of ``least`` bytes counts as earlier by (doc_id, place); it is judged on the
    input and never spans two texts. A null text is empty. Where doc_id repeats or is null,
    rows are ranked by (doc_id, text), nulls first, so of rows that repeat the first stays.
    Texts are taken as bytes: what remains can start or end inside a character.
    """
    if least < SEED:
        raise ValueError(f"a window has {SEED} bytes at least")
    rows = keyed(docs.select("doc_id", "text", *keep)).drop("text")
    seen, pairs = removed(rows, least, texts_too)
    carried = ["doc_id", *keep]
    clean = seen.where(F.col("sha").isNotNull()).select(
        *carried, "n_bytes",
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.col("data").alias("kept"), F.col("sha").alias("kept_sha256"),
    )
    touched = seen.where(F.col("sha").isNull()).join(
        pairs, F.col("doc") == F.col("_doc"), "left"
    )
    none = F.array().cast("array<struct<at:bigint,more:int,sure:boolean>>")
    gone = F.concat(F.coalesce("gone", none), F.coalesce("places", none))
    touched = touched.select(*carried, "n_bytes", "data", gone.alias("gone"))
    w = len(carried)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            data, gone_places = batch.column(w + 1), batch.column(w + 2)
            bounds = gone_places.offsets.to_numpy() - gone_places.offsets[0].as_py()
            starts = gone_places.flatten().field("at").to_numpy()
            mores = gone_places.flatten().field("more").to_numpy() & MORE
            for i in range(batch.num_rows):
                text = np.frombuffer(data[i].as_py(), np.uint8)
                mark = np.zeros(len(text) + 1, np.int64)
                mine = slice(bounds[i], bounds[i + 1])
                np.add.at(mark, starts[mine], 1)
                np.add.at(mark, starts[mine] + mores[mine] + least, -1)
                gone = np.cumsum(mark)[:-1] > 0
                runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                n = int(gone.sum())
                kept = text[~gone].tobytes()
                out.append((n, runs, kept if n or texts_too else None, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(w + 1)]
                + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[*carried, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema)
    return clean.unionByName(touched.mapInArrow(cut, schema))



def _decoded(rows):
    return rows.map(lambda b: None if b is None else b.decode("utf-8", "ignore"))


def whole_characters(data: Column) -> Column:
    """The characters of UTF-8 bytes; remains of characters that were cut are left out."""
    return F.pandas_udf(_decoded, "string", F.PandasUDFType.SCALAR)(data)
