"""Repeated lines and passages that are made of short sentences."""

import re

import pytest

from jobmart.llm import line_dedup
from jobmart.llm.queries import QUERIES

PASSAGE = " ".join(f"Part {i} holds four small words{i}." for i in range(10))  # 6 words each
LINE = "See v4.0 now. Or ask us! Then wait. Read on."


def cleaned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["kept_text"] for r in line_dedup.cleaned(docs, passages=True).collect()}


def test_short_sentences_go_when_the_line_or_passage_repeats(spark):
    texts = [
        f"Own start.\n{LINE}\nOwn end.",
        f"Other start.\n{LINE}\nOther end.",
        f"Tail. {PASSAGE} Then one.",
        f"Head. {PASSAGE} Then two.",
        "One two three\nfour five six\nseven eight nine",
        "One two three four\nfive six seven eight nine",
        "Yes. Yes. Yes.",
        "Yes. No.",
        " ".join(["Echo."] * 20),
    ]
    got = cleaned(spark, texts)
    assert got[0] == texts[0] and got[1] == "Other start.\n\nOther end."
    assert got[2] == texts[2] and got[3] == "Head. Then two."
    assert got[4] == texts[4] and got[5] == ""  # one paragraph, wrapped in another way
    assert got[6] == texts[6] and got[7] == texts[7]  # under eight words
    assert got[8] == " ".join(["Echo."] * 8)  # the first run stays whole


@pytest.fixture(scope="module")
def by_query(spark, data):
    return {r["doc_id"]: r for r in QUERIES["op6_line_dedup"](spark, data).collect()}


def test_no_repeated_line_stays(spark, data, by_query):
    """Brute force over lines of the given table: one with eight words or more that stands in
    an earlier document lies in the removed spans."""
    seen, repeated = set(), 0
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    for r in docs:
        spans = [tuple(map(int, s.split("-"))) for s in by_query[r["doc_id"]]["spans"].split(",") if s]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        gone = {i for a, b in spans for i in range(a, b)}
        at, here = 0, set()
        for line in r["text"].split("\n"):
            words = tuple(re.findall(r"\w+", line.lower()))
            if len(words) >= 8 and words in seen:
                assert gone.issuperset(range(at, at + len(line)))
                repeated += 1
            here.add(words)
            at += len(line) + 1
        seen |= here
    assert repeated


def test_removed_words_stand_elsewhere(spark, data, by_query):
    """Every removed unit of eight words or more is kept in some text or in an earlier one."""
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    before = set()
    for r in docs:
        spans = [tuple(map(int, s.split("-"))) for s in by_query[r["doc_id"]]["spans"].split(",") if s]
        units = list(line_dedup.text_units(r["text"]))
        for a, b, digest in units:
            stays = not any(x <= a and b <= y for x, y in spans)
            assert stays or digest in before
            if stays:
                before.add(digest)
