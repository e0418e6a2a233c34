"""Phrase collocations by Toivonen's sampling: exact counts of every frequent phrase.

1. A sample of the documents proposes phrases: those that reach a lowered bound in it.
2. One pass over all documents counts the proposed phrases and their negative border, that is
   every phrase that was not proposed though its parts were (for words: every word).
3. A border phrase that turns out frequent is a failure: longer phrases around it were not
   counted. It joins the proposed ones, and a further pass counts the phrases whose parts are
   proposed now and were not before. Such a pass takes each phrase that it counts as a part, as
   if it were frequent, so that longer phrases around it are counted with it. This ends when a
   pass leaves no failure, so the result does not depend on the sample.

Counts are taken for the batches of each task and added up by Spark. Which phrases are proposed
is told by bit tables of a fixed size; a phrase that shares its bit with a proposed one is
counted without need, which changes no result.

Texts: A-Z become lower case; ``[.,;:!?\\n\\v\\f\\r]`` end a piece, spaces and tabs a word. Null
and empty texts have no words, a null language is ``und``, repeated rows count each time, an
empty table gives no rows, and columns other than text and language are not read. The longest
text is bound by a task's memory, as one cell of its batch is.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmart.llm.common import materialize, ready

#: Bits of each table that tells the proposed phrases of one length (a prime; 4 MB).
BITS = 33_554_393
#: Factors that make a phrase's bit from the bit of all but its last word and that word.
FIRST, LAST = 1_000_003, 7_919
#: One document in so many is in the sample.
SAMPLE = 4
#: Parts of a language that are ranked apart before the language is.
SLICES = 256
#: About so many bytes of text are counted together.
BATCH_BYTES = 6 << 20
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_COUNTS = "lang string, size int, phrase string, a long"


def _marked(table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (table[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


def _counted(
    longest: int,
    now: dict[int, np.ndarray] | None,
    before: dict[int, np.ndarray] | None,
    batch_bytes: int,
    batches: Iterator[pa.RecordBatch],
) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases whose two parts are marked in ``now`` but not both in ``before``;
    all phrases without ``now``, and without ``before`` also single words and, as size 0, the
    number of words. With ``before`` a phrase that is counted here passes for marked."""
    texts, held = defaultdict(list), 0
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang, text in zip(langs, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            texts[lang].append((text or b"").lower().translate(_ENDS))
            held += len(texts[lang][-1])
            if held > batch_bytes:
                for name, some in texts.items():
                    yield from _phrases(name, _words(some), longest, now, before)
                texts, held = defaultdict(list), 0
    for name, some in texts.items():
        yield from _phrases(name, _words(some), longest, now, before)


def _words(texts: list[bytes]) -> pa.Array:
    """All words, with a line feed where a piece or a text ends; empty words lie between."""
    whole = b" \n ".join(texts).replace(b"\n", b" \n ")
    return pc.split_pattern(pa.array([whole], pa.large_binary()), b" ").flatten()


def _phrases(lang, found, longest, now, before):
    coded = found.dictionary_encode()
    words = coded.dictionary.cast(pa.binary())
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    plain = words.to_pylist()
    code = code[np.array([w != b"" for w in plain], bool)[code]]
    seed = zlib.crc32(lang.encode() + b"\n")
    crc = np.array([zlib.crc32(w, seed) for w in plain], np.int64)
    inside = np.array([w not in (b"\n", b"") for w in plain], bool)
    if not inside.any():
        return
    text = words.cast(pa.string())
    valid = inside[code]
    if before is None:
        counts = np.bincount(code, minlength=len(plain))[inside]
        yield _rows(lang, 1, text.filter(pa.array(inside)), counts)
        yield _rows(lang, 0, pa.array([""]), np.array([valid.sum()]))
    bit, key, assumed = crc[code] % BITS, code, None
    for size in range(2, longest + 1):
        # bit, key and valid speak of the phrase of size - 1 words that starts at each place
        if len(key) < 2:
            return
        ends = code[size - 1 :]
        starts = valid[:-1] & valid[1:]
        asked = starts
        if now is not None:
            part = _marked(now[size - 1], bit)
            if assumed is not None:
                part = part | assumed
            asked = asked & part[:-1] & part[1:]
        if before is not None:
            part = _marked(before[size - 1], bit)
            asked = asked & ~(part[:-1] & part[1:])
        places = np.flatnonzero(asked)
        both = key[:-1] * len(plain) + ends
        if len(places):
            _, first, counts = np.unique(both[places], return_index=True, return_counts=True)
            at = places[first]
            parts = [text.take(pa.array(code[at + k])) for k in range(size)]
            yield _rows(lang, size, pc.binary_join_element_wise(*parts, " "), counts)
        if size < longest:
            assumed = None if before is None else asked
            bit = (bit[:-1] * FIRST + crc[ends] * LAST) % BITS
            # phrases of this size as numbers again, small enough for another factor
            key, valid = np.unique(both, return_inverse=True)[1], starts


def _rows(lang: str, size: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int64))),
            pa.array(np.full(n, size, np.int32)),
            phrases,
            pa.array(counts.astype(np.int64)),
        ],
        names=["lang", "size", "phrase", "a"],
    )


def _bit() -> Column:
    """The bit of a row's phrase, as :func:`_phrases` computes it."""

    def crc(word: Column) -> Column:
        return F.crc32(F.concat(F.col("lang"), F.lit("\n"), word).cast("binary"))

    words = F.split("phrase", " ")
    return F.aggregate(
        F.slice(words, F.lit(2), F.size(words)),
        F.pmod(crc(F.get(words, F.lit(0))), F.lit(BITS)),
        lambda bit, word: F.pmod(bit * FIRST + crc(word) * LAST, F.lit(BITS)),
    )


def _tables(proposed: DataFrame, longest: int, old: dict[int, np.ndarray] | None):
    """Bit tables of the proposed phrases of each size below ``longest``, added to ``old``. The
    driver gets at most ``BITS / 64`` rows for each size, however many phrases there are."""
    bits = proposed.where(F.col("size").between(1, longest - 1)).select("size", _bit().alias("bit"))
    cells = bits.groupBy("size", F.shiftright("bit", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("marks")
    )
    found = cells.toArrow()
    size, cell, marks = (found.column(c).to_numpy() for c in ("size", "cell", "marks"))
    tables = {}
    for k in range(1, longest):
        table = np.zeros(BITS // 64 + 1, "<i8") if old is None else old[k].view("<i8").copy()
        here = size == k
        table[cell[here]] |= marks[here]
        tables[k] = table.view(np.uint8)
    return tables


def frequent_phrases(
    docs: DataFrame,
    least: int = 10,
    longest: int = 3,
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE,
    batch_bytes: int = BATCH_BYTES,
) -> tuple[DataFrame, int]:
    """``(lang, size, phrase, a)`` of every phrase of up to ``longest`` words that occurs ``least``
    times or more in its language, and of size 0 the number of words; and the passes taken."""
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        F.col(f"`{text}`").alias("text"),
    )

    def counted(rows: DataFrame, size: int, bound: int, now=None, before=None) -> DataFrame:
        parts = rows.mapInArrow(lambda b: _counted(size, now, before, batch_bytes, b), _COUNTS)
        summed = parts.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a"))
        enough = (F.col("a") >= bound) | (F.col("size") == 0)
        return materialize(summed.where(enough), "phrases")

    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    lowered = max(2, (4 * least) // (5 * sample))
    now, before = _tables(counted(some, longest - 1, lowered), longest, None), None
    found = []
    while True:
        found.append(counted(rows, longest, least, now, before))
        # failures: frequent phrases of this pass that were not proposed
        wider = _tables(found[-1], longest, now)
        closed = all((wider[k] == now[k]).all() for k in wider)
        if closed or before is not None:
            # an expansion pass has counted around all that it found, see step 3
            return reduce(DataFrame.unionByName, found), len(found)
        before, now = now, wider


def scored(frequent: DataFrame, longest: int = 3) -> DataFrame:
    """The phrases of two words or more with the counts ``l`` and ``r`` of the parts of their
    worst cut, and its score ``floor(1000000 * a * a / (l * r))``; of equal scores the first cut
    counts. Numbers are decimals of 38 digits, exact for counts below 10^15."""
    phrases = frequent.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = phrases.select(
        "lang", "size", "phrase", "a", "words",
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"),
    )

    def joined(words: Column) -> Column:
        return F.array_join(words, " ")

    parts = cuts.select(
        "lang", "size", "phrase", "a", "k",
        joined(F.slice("words", F.lit(1), F.col("k"))).alias("left"),
        joined(F.slice("words", F.col("k") + 1, F.col("size"))).alias("right"),
    )
    known = frequent.where(f"size between 1 and {longest - 1}")
    left = known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    score = F.expr(
        "CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))"
        " div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))"
    )
    cut = parts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    worst = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return (
        cut.groupBy("lang", "size", "phrase", "a").agg(worst.alias("w"))
        .select("lang", "size", "phrase", "a", "w.l", "w.r", "w.score")
    )


def uncovered(phrases: DataFrame, longest: int = 3, share: int = 50) -> DataFrame:
    """Without the phrases that lie inside a longer one which holds ``share`` percent of their
    occurrences or more."""
    words = F.split("phrase", " ")
    inner = phrases.where("size > 2").select(
        "lang",
        F.col("a").alias("outer_a"),
        F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"),
        "size",
        words.alias("words"),
    )
    spots = inner.select(
        "lang", "outer_a", "length", "words",
        F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("at"),
    )
    covered = spots.groupBy(
        "lang", F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("phrase")
    ).agg(F.max("outer_a").alias("outer_a"))
    joined = phrases.join(covered, ["lang", "phrase"], "left")
    inside = F.coalesce(F.col("outer_a") * 100 >= F.col("a") * share, F.lit(False))
    return joined.where(~inside).drop("outer_a")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and phrase."""
    frequent, _ = frequent_phrases(docs, least, longest)
    kept = uncovered(scored(frequent, longest), longest)
    # a language's first rows are among the first of its slices, so no task ranks a language
    # that holds most of the phrases: the last step gets at most SLICES * top rows of each
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = kept.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    inside = F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))
    first = sliced.withColumn("rank", inside).where(F.col("rank") <= top).drop("rank", "_slice")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = first.withColumn("rank", place).where(F.col("rank") <= top)
    # one row for each language
    words = frequent.where("size = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
