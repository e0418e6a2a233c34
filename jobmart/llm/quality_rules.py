"""Quality rules per document, and verdicts on hosts from the rate of their failures.

Each document is measured on its whole text and tried against fixed rules. Failures are
counted per host, rates are drawn towards all hosts' mean by a beta prior whose strength is
estimated from the spread of the rates, and a host whose rate lies above ``HOST_RATE`` beyond
``HOST_MARGIN`` posterior deviations is rejected with all its documents. So a host seen twice
is not condemned by two bad pages, and a host with a million bad pages is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmart.llm.common import materialize, ready

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
HOST_RATE, HOST_MARGIN = 0.5, 2.0
#: Bounds of the prior's strength, in documents.
PRIOR_LEAST, PRIOR_MOST = 1.0, 1000.0
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
]


def repeated(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered = end = 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + size - max(i, end)
            end = i + size
    return covered


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()  # bytes split at ASCII white space only
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated(words),
    )


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, the columns ``keep`` and the measures of each text; a null text has none."""
    ready(docs.sparkSession)
    names = ["doc_id", *keep]
    rows = docs.select(*names, F.coalesce("text", F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))]
                + [pa.array([x[i] for x in found], pa.int64()) for i in range(len(MEASURES))],
                names=[*names, *MEASURES],
            )

    schema = ", ".join(
        [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names]
        + [f"{n} long" for n in MEASURES]
    )
    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    few = F.col("n_words") < 10
    return few | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def own_failed() -> Column:
    """Base rules, and: over a symbol in ten words, over half of the lines repeated, words of
    over 30 characters on average."""
    return (
        base_failed()
        | (10 * F.col("n_symbols") > F.col("n_words"))
        | (2 * F.col("n_dup_lines") > F.col("n_lines"))
        | (F.col("word_chars") > 30 * F.col("n_words"))
    )


def host_verdicts(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row per known host: documents, failures, shrunk rate, its deviation, rejected."""
    hosts = (
        measured.where(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count("*").alias("n"), F.sum(own_failed().cast("long")).alias("failed"))
    )
    hosts = materialize(hosts, "hosts")
    rate = F.col("failed") / F.col("n")
    total = hosts.agg(
        F.sum("failed").alias("failed"), F.sum("n").alias("n"), F.count("*").alias("hosts")
    ).first()
    if not total["n"]:
        mean, strength = 0.5, PRIOR_LEAST
    else:
        mean = total["failed"] / total["n"]
        # Spread of the rates beyond what so few documents would give by chance.
        spread = hosts.agg(
            F.avg((rate - mean) ** 2 - mean * (1 - mean) / F.col("n")).alias("between")
        ).first()["between"]
        strength = mean * (1 - mean) / spread - 1 if spread and spread > 0 else PRIOR_MOST
    strength = min(max(strength, PRIOR_LEAST), PRIOR_MOST)
    a, b = mean * strength, (1 - mean) * strength
    shrunk = (F.col("failed") + a) / (F.col("n") + a + b)
    return hosts.select(
        F.col(host), "n", "failed", shrunk.alias("rate"),
        F.sqrt(shrunk * (1 - shrunk) / (F.col("n") + a + b + 1)).alias("deviation"),
    ).withColumn("rejected", F.col("rate") - HOST_MARGIN * F.col("deviation") > HOST_RATE)


def judged(docs: DataFrame, host: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Measures of every document with ``base_failed`` and ``kept``.

    Kept are documents that pass all rules and whose host is not rejected. A document without
    a host is judged by itself; an empty table gives no rows; repeated rows are judged alike.
    """
    measured = materialize(measures(docs, *dict.fromkeys([host, *keep])), "measures")
    verdicts = host_verdicts(measured, host).where("rejected")
    rejected = materialize(verdicts.select(F.col(host).alias("_host")), "rejected")
    return (
        measured.join(rejected, F.col(host) == F.col("_host"), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~own_failed() & F.col("_host").isNull())
        .drop("_host")
    )
