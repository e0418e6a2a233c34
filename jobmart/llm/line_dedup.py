"""Removal of units of text that stand earlier in the corpus.

Units are paragraphs cut again at sentence ends, so a passage that was set into a line is
found as well as a line. A unit is normalised (case, signs and white space do not count) and
hashed to 128 bits, the digests of the whole corpus are grouped, and of each digest the unit
with the smallest (doc_id, text hash, place) stays. Units under ``MIN_WORDS`` words are never
removed alone: short sentences repeat by chance. With ``passages`` whole lines, whole paragraphs
and runs of units are hashed too, and the minimum holds for these, so what is made of short
sentences is found as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmart.llm.common import materialize, ready

MIN_WORDS = 8
UNIT = re.compile(r"[^\n.!?]+[.!?]*|[.!?]+").finditer
WORD = re.compile(r"\w+").findall
UNITS = "doc_id long, text_id long, at int, until int, digest binary"


def text_units(text: str, least: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the units with enough words; ends take in the white space up to
    the next unit of the line, so removal leaves no gap behind."""
    for m in UNIT(text):
        words = WORD(m.group().lower())
        if len(words) >= least:
            yield m.start(), m.end(), _digest(words)


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()


def text_passages(text: str, least: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the units with enough words, of lines and paragraphs (lines up to
    a blank one) with enough words, and for each shorter unit of the shortest runs of units,
    over line ends too, that start or end with it and have enough words.

    Of a repeated passage that has enough words every unit lies in a run that is inside the
    passage. Of spans with the same words the widest is given.
    """
    words, pieces, wide = [], [], []  # wide: lines and paragraphs
    begin = place = 0
    paragraph = None
    for line in [*text.split("\n"), ""]:
        if line.isspace() or not line:
            wide += [paragraph] if paragraph else []
            paragraph = None
        else:
            first = len(words)
            for m in UNIT(line):
                if found := WORD(m.group().lower()):
                    at = len(words)
                    words += found
                    pieces.append((at, len(words), begin + m.start(), begin + m.end()))
            whole = (first, len(words), begin, begin + len(line))
            wide.append(whole)
            paragraph = (*paragraph[:1], whole[1], paragraph[2], whole[3]) if paragraph else whole
        begin += len(line) + 1
    spans = {}

    def add(a: int, b: int, start: int, end: int) -> None:
        old = spans.get((a, b), (start, end))
        spans[a, b] = min(old[0], start), max(old[1], end)

    for a, b, start, end in wide:
        if b - a >= least:
            add(a, b, start, end)
    ahead = 0
    for i, (a, b, start, end) in enumerate(pieces):
        if b - a >= least:
            add(a, b, start, end)
            continue
        ahead = max(ahead, i)
        while ahead < len(pieces) and pieces[ahead][1] - a < least:
            ahead += 1
        if ahead < len(pieces):
            add(a, pieces[ahead][1], start, pieces[ahead][3])
        while place < i and b - pieces[place + 1][0] >= least:
            place += 1
        if b - pieces[place][0] >= least:
            add(pieces[place][0], b, pieces[place][2], end)
    for (a, b), (start, end) in spans.items():
        yield start, end, _digest(words[a:b])


def units(docs: DataFrame, least: int = MIN_WORDS, passages: bool = False) -> DataFrame:
    """One row per unit. Documents are known by doc_id and a hash of their text."""
    of_text = text_passages if passages else text_units
    ready(docs.sparkSession)
    rows = docs.where(F.col("text") != "").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (doc_id, text_id, a, b, d)
                for doc_id, text_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)),
                                                 strict=True)
                for a, b, d in of_text(text, least)
            ]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "text_id", "at", "until", "digest"],
            )

    return rows.mapInArrow(run, UNITS)


def repeats(docs: DataFrame, least: int = MIN_WORDS, passages: bool = False) -> DataFrame:
    """Spans to remove: doc_id, text_id, at, until. Every unit but the earliest of its digest
    and those that overlap it.

    The earliest of a digest comes from an aggregate that is partial on the map side, and only
    digests that occur more than once meet the units again, in a join whose hot keys adaptive
    execution splits.
    """
    rank = F.struct("doc_id", "text_id", "at", "until")
    # Digests that stay after the count are few; the units are read once more from the texts.
    found = units(docs, least, passages)
    earliest = (
        found.groupBy("digest")
        .agg(F.min(rank).alias("first"), F.count("*").alias("times"))
        .where("times > 1")
        .select("digest", "first")
    )
    earliest = materialize(earliest, "repeated-units")
    inside = (
        F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
        & (F.col("text_id") == F.col("first.text_id"))
        & (F.col("at") < F.col("first.until"))
    )
    return (
        found.join(earliest, "digest")
        .where(~inside)
        .select("doc_id", "text_id", "at", "until")
    )


def _apart(spans: DataFrame) -> DataFrame:
    """Spans that overlap made one; those that only touch stay two."""
    one = spans.groupBy("doc_id", "text_id", "at").agg(F.max("until").alias("until"))
    order = Window.partitionBy("doc_id", "text_id").orderBy("at")
    reached = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    one = one.withColumn("new", F.when(F.col("at") < reached, 0).otherwise(1))
    return (
        one.withColumn("part", F.sum("new").over(order))
        .groupBy("doc_id", "text_id", "part")
        .agg(F.min("at").alias("at"), F.max("until").alias("until"))
    )


def cleaned(docs: DataFrame, least: int = MIN_WORDS, passages: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``kept_text`` and ``spans``, the removed [at, until) in code
    points of the original text, in order. ``passages`` looks for ``text_passages`` instead of
    ``text_units``.

    A null text stays null, an empty one empty; a null doc_id ranks first. Rows that repeat a
    doc_id and its text are one document: all of them get the same result, and they do not
    take units from one another. Other columns stay as they are, but must not be named like
    the two that are added.
    """
    none = F.array().cast("array<struct<at:int,until:int>>")
    gone = (
        _apart(repeats(docs, least, passages))
        .groupBy("doc_id", "text_id")
        .agg(F.array_sort(F.collect_set(F.struct("at", "until"))).alias("spans"))
    )
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id"), "spans")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (
        F.xxhash64("text") == F.col("_text_id")
    )
    return (
        docs.join(gone, same, "left")
        .drop("_id", "_text_id")
        .withColumn("spans", F.coalesce("spans", none))
        .withColumn("kept_text", _cut(F.col("text"), F.col("spans")))
    )


def _cut(text, spans):
    """The text between the spans: pieces from the end of one to the start of the next."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["until"]))
    ends = F.concat(F.transform(spans, lambda s: s["at"]), F.array(F.length(text)))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, ""))
