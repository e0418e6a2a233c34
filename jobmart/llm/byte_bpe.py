"""Byte-level BPE: whole texts to token ids and back, from a file of ranks.

``encode`` runs in one stage without a shuffle:

1. The texts are split by the pattern, and every distinct word of a partition is kept once. A
   word that is a token itself has its id at once, as the rank files want it.
2. Spark higher-order functions fold the ranked merges over the byte array of every other
   distinct word: each step joins the pair of the lowest rank, the first of equals, until no
   pair has a rank. The ranks of pairs are a literal of the plan.
3. Every text gets the ids of its words in their order.

``decode`` concatenates the binary pieces of the ids.

A literal Spark map is searched from its start for every lookup, which 50,000 entries do not
allow. The rank map is therefore a literal array with a perfect hash: two multiplications lead
to the one cell that a pair can have, and the cell names its pair.

Nulls and empty texts have no ids and decode to no bytes. Repeated rows, equal or null ids and
columns of any other name are carried along. A text of any length is one row of its batch; the
work of the fold grows with the square of a single word's bytes, not of a text's.
"""

from __future__ import annotations

import base64
import math
import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmart.llm.common import ready

#: The distinct words a task remembers; beyond it starts anew, so memory stays bounded.
MOST_WORDS = 1 << 19
#: What a lookup gives for a pair without a rank is not below the span of ids.
ABSENT = 1 << 52


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, which is also the id. The file is installed on every machine."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(p[0]): int(p[1]) for p in pairs if p}


class RankMap:
    """Ranks of pairs of ids as literal arrays, see the module's text.

    Keys are hashed to groups of about three; each group has the smallest factor that sends
    its keys to cells of their own.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.span = 1 << max(ranks.values()).bit_length()
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left * self.span + right] = rank
        self.groups = _prime_from(len(found) // 3 + 2)
        self.size = _prime_from(2 * len(found) + 2)
        self.factors = np.ones(self.groups, np.int64)
        self.cells = np.full(self.size, -1, np.int64)
        self._lay(found)

    def _lay(self, found: dict[int, int]) -> None:
        groups = defaultdict(list)
        for key in found:
            groups[key % self.groups].append(key)
        used = bytearray(self.size)
        for group in sorted(groups, key=lambda g: (-len(groups[g]), g)):
            keys, factor = groups[group], 1
            while True:
                places = {key * factor % self.size for key in keys}
                if len(places) == len(keys) and not any(used[p] for p in places):
                    break
                factor += 1
            self.factors[group] = factor
            for key in keys:
                place = key * factor % self.size
                used[place] = 1
                self.cells[place] = key * self.span + found[key]

    def key(self, left: Column, right: Column) -> Column:
        return left * F.lit(self.span) + right

    def rank(self, key: Column) -> Column:
        """The rank of a pair; NULL without a pair, at least ``span`` if it has none."""
        factor = F.get(_literal(self.factors), F.pmod(key, F.lit(self.groups)).cast("int"))
        cell = F.get(_literal(self.cells), F.pmod(key * factor, F.lit(self.size)).cast("int"))
        return F.pmod(cell - key * F.lit(self.span), F.lit(ABSENT))


def _prime_from(number: int) -> int:
    while any(number % d == 0 for d in range(2, math.isqrt(number) + 1)):
        number += 1
    return number


def _literal(values) -> Column:
    """A literal array from one string; Catalyst folds the split and the cast."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


@lru_cache(maxsize=2)
def rank_map(path: str) -> RankMap:
    return RankMap(read_ranks(path))


def merged(word: Column, ranks: RankMap) -> Column:
    """The ids (array of long) of one word, given as an array of signed bytes.

    The state of the fold is one long for each piece: the rank of the pair that it opens, its
    first byte's place, its id. The least is then the leftmost pair of the lowest rank.
    """
    id_bits = ranks.span.bit_length()
    shift = 62 - id_bits
    none, low_bits = F.lit(ranks.span), F.lit((1 << shift) - 1)
    places, id_mask = F.lit((1 << shift) - (1 << id_bits)), F.lit((1 << id_bits) - 1)

    def piece(rank: Column, place_and_id: Column) -> Column:
        return F.least(rank, none) * F.lit(1 << shift) + place_and_id

    def join(state: Column, at: Column) -> Column:
        """The piece at ``at`` takes in the next one. The pair's rank is the joined token's id;
        only the ranks of the pairs to its left and right are new."""
        low, before = F.get(state, at - 1), F.get(state, at - 2)
        new = F.shiftright(low, shift)
        keys = F.array(
            ranks.key(before.bitwiseAND(id_mask), new),
            ranks.key(new, F.get(state, at + 1).bitwiseAND(id_mask)),
        )
        kept = F.array(before.bitwiseAND(low_bits), low.bitwiseAND(places) + new)
        around = F.zip_with(keys, kept, lambda key, x: piece(ranks.rank(key), x))
        return F.flatten(
            F.array(
                F.slice(state, F.lit(1), F.greatest(at - 2, F.lit(0))),
                F.slice(around, F.when(at == 1, 2).otherwise(1), F.lit(2)),
                F.slice(state, at + 2, F.size(state)),
            )
        )

    def step(state: Column, _) -> Column:
        low = F.array_min(state)
        at = F.array(F.array_position(state, low).cast("int"))
        done = F.get(F.transform(at, lambda x: join(state, x)), F.lit(0))
        return F.when(low < F.lit(ranks.span << shift), done).otherwise(state)

    single = _literal([ranks.single[b] for b in [*range(128, 256), *range(128)]])
    ids = F.transform(word, lambda b: F.get(single, b.cast("int") + 128))

    def opened(ids: Column) -> Column:
        keys = F.transform(ids, lambda a, i: ranks.key(a, F.get(ids, i + 1)))
        return F.zip_with(
            F.transform(keys, lambda k, i: piece(ranks.rank(k), i * F.lit(1 << id_bits))),
            ids, lambda a, b: a + b,
        )

    start = F.get(F.transform(F.array(ids), opened), F.lit(0))
    finish = lambda state: F.transform(state, lambda x: x.bitwiseAND(id_mask).cast("int"))
    return F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(word), F.lit(2))), start, step, finish)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, … of every run, one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _split(path: str, most_words: int, batches: Iterator[pa.RecordBatch]):
    """One row per batch: its other columns, how many words each row has, all words as numbers
    of distinct words, ids of the words that are new in this task if they are tokens (else -1),
    and the bytes of those that are not. ``fresh`` tells that numbering starts anew."""
    ranks, number = read_ranks(path), {}
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        coded = lists.flatten().cast(pa.binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        fresh = len(number) + len(words) > most_words
        if fresh:
            number = {}
        new = [w for w in words if w not in number]
        number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
        numbers = np.array([number[w] for w in words], "<u4")
        known = np.array([ranks.get(w, -1) for w in new], np.int64)
        rest = [w for w in new if w not in ranks]
        ends = np.array([0, *np.cumsum([len(w) for w in rest])], np.int32)
        folded = pa.ListArray.from_arrays(
            pa.array(ends), pa.array(np.frombuffer(b"".join(rest), np.int8))
        )
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        kept = pa.Table.from_batches([batch.select(range(batch.num_columns - 1))])
        values = [
            _packed(kept), sizes.astype(np.int64).tobytes(),
            numbers[coded.indices.to_numpy(zero_copy_only=False)].tobytes(), known.tobytes(),
        ]
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.array([v], pa.binary()) for v in values],
                pa.array([fresh]),
                pa.ListArray.from_arrays(pa.array([0, len(folded)], pa.int32()), folded),
            ],
            names=["kept", "sizes", "numbers", "known", "fresh", "words"],
        )


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _join(batches: Iterator[pa.RecordBatch]):
    """The rows of each batch with the ids of their words."""
    ids, sizes = np.empty(0, "<u4"), np.empty(0, np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            kept, rows, numbers, known = (batch.column(k)[i].as_py() for k in range(4))
            if batch.column(4)[i].as_py():
                ids, sizes = ids[:0], sizes[:0]
            known = np.frombuffer(known, np.int64)
            lists = batch.column(5).slice(i, 1).flatten()
            size = np.ones(len(known), np.int64)
            size[known < 0] = lists.value_lengths().to_numpy(zero_copy_only=False)
            first = _bounds(size)
            new = np.empty(first[-1], "<u4")
            new[first[:-1][known >= 0]] = known[known >= 0]
            folded = lists.flatten().to_numpy(zero_copy_only=False)
            new[_ragged(first[:-1][known < 0], size[known < 0])] = folded
            ids, sizes = np.concatenate((ids, new)), np.concatenate((sizes, size))
            begins = _bounds(sizes)
            bounds = _bounds(np.frombuffer(rows, np.int64))
            words = np.frombuffer(numbers, "<u4")
            out = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                some = words[a:b]
                out.append(ids[_ragged(begins[some], sizes[some])].tobytes())
            table = pa.ipc.open_stream(kept).read_all().combine_chunks()
            columns = [c.combine_chunks() for c in table.columns]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(out, pa.binary())], names=[*table.column_names, "ids"]
            )


def java_pattern(spark: SparkSession, pattern: str) -> str:
    """``pattern`` with white space as Unicode has it, and with the letters and numbers that
    are younger than this Java."""
    compiled = spark._jvm.java.util.regex.Pattern.compile
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for name in ("L", "N"):
        kind = regex.compile(rf"\p{{{name}}}").fullmatch
        all_of = "".join(c for c in every if kind(c))
        unknown = compiled(rf"\p{{{name}}}+").matcher(all_of).replaceAll("")
        if unknown:
            ranges = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _runs(unknown))
            # the long list of ranges is tried only from its least code point on
            young = rf"[[^\x{{0}}-\x{{{ord(min(unknown)) - 1:x}}}]&&[{ranges}]]"
            pattern = _widened(pattern, rf"\p{{{name}}}", young)
    return f"(?U){pattern}"


def _widened(pattern: str, name: str, more: str) -> str:
    """``pattern`` with ``more`` beside the class ``name``, inside and outside of brackets."""
    out, depth, at = [], 0, 0
    while at < len(pattern):
        if pattern.startswith(name, at):
            out.append(name + more if depth else f"[{name}{more}]")
            at += len(name)
            continue
        step = 2 if pattern[at] == "\\" else 1
        depth += {"[": 1, "]": -1}.get(pattern[at : at + step], 0)
        out.append(pattern[at : at + step])
        at += step
    return "".join(out)


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of consecutive code points."""
    start = last = None
    for code in map(ord, text):
        if start is not None and code != last + 1:
            yield start, last
            start = None
        start, last = code if start is None else start, code
    if start is not None:
        yield start, last


def _decoded(path: str, batches: Iterator[pa.RecordBatch]):
    ranks = read_ranks(path)
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    tokens = {rank: token for token, rank in ranks.items()}
    for rank, token in tokens.items():
        sizes[rank] = len(token)
    begins = _bounds(sizes)[:-1]
    raw = np.frombuffer(b"".join(tokens[r] for r in sorted(tokens)), np.uint8)
    for batch in batches:
        out = []
        for value in batch.column(batch.num_columns - 1).to_pylist():
            ids = np.frombuffer(value or b"", "<u4")
            out.append(raw[_ragged(begins[ids], sizes[ids])].tobytes())
        columns = batch.columns
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"]
        )


def decode(encoded: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with ``name``: the bytes of its ids, the tokens' binary pieces one after the
    other. NULL ids give no bytes; ids outside the ranks fail."""
    ready(encoded.sparkSession)
    kept = [c for c in encoded.columns if c not in (ids, name)]
    plain = encoded.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)],
        F.col(f"`{ids}`").alias("ids"),
    )
    schema = T.StructType([*plain.schema.fields, T.StructField("decoded", T.BinaryType())])
    out = plain.mapInArrow(lambda b: _decoded(path, b), schema)
    named = [F.col(f"c{i}").alias(c) for i, c in enumerate(kept)]
    return out.select(*named, F.col("ids").alias(ids), F.col("decoded").alias(name))


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    name: str = "ids",
    decoded: str | None = None,
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """The rows of ``docs`` without ``text``, with ``name``: the ids of the whole text as
    little-endian unsigned 32-bit numbers (binary). A column ``name`` of ``docs`` is replaced.

    ``decoded`` names a further column with the bytes that :func:`decode` makes of the ids, for
    round trips; they are taken from the ids in the same Python task. A task remembers
    ``most_words`` distinct words; fewer cost time, not results.
    """
    spark = docs.sparkSession
    ready(spark)
    ranks, split = rank_map(path), F.lit(java_pattern(spark, pattern))
    kept = [c for c in docs.columns if c not in (text, name, decoded)]
    plain = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)],
        F.regexp_extract_all(F.col(f"`{text}`"), split, F.lit(0)).alias("words"),
    )
    fields = plain.schema.fields[:-1]
    batches = plain.mapInArrow(
        lambda b: _split(path, most_words, b),
        "kept binary, sizes binary, numbers binary, known binary, fresh boolean,"
        " words array<array<tinyint>>",
    )
    # a row holds all words of its batch: no word is folded twice in a task
    folded = batches.withColumn("words", F.transform("words", lambda w: merged(w, ranks)))
    fields.append(T.StructField("ids", T.BinaryType()))
    if decoded is None:
        out = folded.mapInArrow(_join, T.StructType(fields))
    else:
        fields.append(T.StructField("decoded", T.BinaryType()))
        out = folded.mapInArrow(lambda b: _decoded(path, _join(b)), T.StructType(fields))
    named = [F.col(f"c{i}").alias(c) for i, c in enumerate(kept)]
    made = {"ids": name, "decoded": decoded}
    return out.select(*named, *[F.col(c).alias(n) for c, n in made.items() if n])
