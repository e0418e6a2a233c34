"""A quality score learned from trusted positives and unlabelled text.

Texts are measured by ratios (signs, capitals, repeats, word lengths) and each measure is cut
at fixed bounds, so a document is a short row of bits. Equal rows are counted once, so every
unlabelled document takes part in every step and a step reads only the distinct rows. The
classifier is linear in the bits and minimises the non-negative unbiased risk
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))`` with logistic loss
and a small quadratic penalty. While the part under the maximum is positive the risk is convex
and Newton steps are taken; where it turns negative, the step goes up that part's gradient, as
far as it takes to bring the part back to 0. Steps that do not lower the non-negative risk are
taken back and shortened, and the weights of the lowest risk are the result.

The class prior is estimated from positives and unlabelled texts alone. A text set that leaves
negatives out holds ``prior`` times the share of unlabelled texts that it holds of positives, and
no set holds less. The sets tried are the texts above a bound of a score that tells positives
from unlabelled texts, learned on one half of the patterns and counted on the other, both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmart.llm.common import materialize, ready
from jobmart.llm.quality_rules import measure

RATIO_CUTS = (0.002, 0.02, 0.1, 0.3, 0.6)
LENGTH_CUTS = (1, 5, 10, 20, 50, 200, 1000)
WORD_CUTS = (2, 3, 4, 5, 6, 8, 12, 30)
STEPS, PENALTY = 40, 2e-4
#: A step is shortened by halves to this part before the search ends.
SHORTEST = 1 / 64
#: Score ranges whose upper ends are tried for the class prior, and the chance that the
#: estimate's margin is passed.
SCORE_RANGES, DOUBT = 1000, 0.1
#: Class priors outside these bounds cannot be told from all or none.
PRIOR_BOUNDS = (0.02, 0.98)
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b"!?;:"


def traits(text: bytes) -> list[bool]:
    """The bits of one text; all ratios of an empty text are 0."""
    n, chars, symbols, lines, dup_lines, repeats = measure(text)
    words = text.split()
    least = max(n, 1)
    some = max(len(text), 1)

    def share(of: bytes) -> float:
        return (len(text) - len(text.translate(None, of))) / some

    short = sum(len(w) == 1 for w in words)
    longest = max(map(len, words), default=0)
    ratios = [
        symbols / least, dup_lines / max(lines, 1), repeats / least, 1 - len(set(words)) / least,
        share(UPPER), share(DIGITS), share(MARKS) * 5, share(b"|"), share(b".,") * 5,
        short / least, 1 - lines / max(text.count(b"\n") + 1, 1),
        text.count(b"  ") / least, (len(text) - len(text.strip())) / some,
    ]
    out = [r > c for r in ratios for c in RATIO_CUTS]
    out += [n >= c for c in LENGTH_CUTS] + [chars / least >= c for c in WORD_CUTS]
    return [*out, n / max(lines, 1) >= 3, n / max(lines, 1) >= 10, longest > 40, longest > 200]


WIDTH = len(traits(b"")) + 1


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the bits ``x`` of each whole text. ``held_out`` depends on doc_id
    alone and is no input of the score; a null doc_id is in the learning part."""
    ready(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
        .alias("held_out"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(traits(t)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bits, pa.binary())],
                names=["doc_id", "held_out", "x"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, x binary")


def unpacked(x: pa.Array) -> np.ndarray:
    """One row of 0/1 per text, with a constant first."""
    data = np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1)
    bits = np.unpackbits(data, axis=1, count=WIDTH - 1)
    return np.hstack([np.ones((len(x), 1)), bits])


def log1pexp(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sums(rows: DataFrame, weights: np.ndarray) -> dict[str, np.ndarray | float]:
    """Means over the counted rows (x, unlabelled, positive), for unlabelled texts (``u``) and
    positives (``p``): the loss as negatives, its gradient and Hessian, the loss of positives as
    positives and the mean of their bits."""
    upper = np.triu_indices(WIDTH)
    per_class = 2 + 2 * WIDTH + 1 + len(upper[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * per_class)
        for batch in batches:
            x = unpacked(batch.column(0))
            z = x @ weights
            up = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            for kind in (0, 1):
                count = batch.column(kind + 1).to_numpy(zero_copy_only=False).astype(float)
                some = count > 0
                if not some.any():
                    continue
                xs, n, zs, us = x[some], count[some], z[some], up[some]
                h = (xs * (n * us * (1 - us))[:, None]).T @ xs
                total[kind * per_class : (kind + 1) * per_class] += np.concatenate(
                    [[n.sum(), n @ log1pexp(zs), n @ log1pexp(-zs)], n @ xs, (n * us) @ xs, h[upper]]
                )
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "v"]
        )

    parts = rows.select("x", "unlabelled", "positive").mapInArrow(run, "at int, v double")
    out = np.zeros(2 * per_class)
    for row in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():  # a fixed number
        out[row["at"]] = row["v"]
    found: dict[str, np.ndarray | float] = {}
    for kind, v in zip("up", out.reshape(2, per_class), strict=True):
        n = found[f"{kind}_n"] = v[0]
        v = v / max(n, 1)
        found[f"{kind}_as_negative"], found[f"{kind}_as_positive"] = v[1], v[2]
        found[f"{kind}_mean"], found[f"{kind}_up"] = v[3 : 3 + WIDTH], v[3 + WIDTH : 3 + 2 * WIDTH]
        h = np.zeros((WIDTH, WIDTH))
        h[upper] = v[3 + 2 * WIDTH :]
        found[f"{kind}_hessian"] = h + np.triu(h, 1).T
    return found


def _ridge() -> np.ndarray:
    ridge = np.full(WIDTH, PENALTY)
    ridge[0] = 1e-9
    return ridge


def negative_part(s: dict, prior: float) -> float:
    return s["u_as_negative"] - prior * s["p_as_negative"]


def risk(s: dict, prior: float, weights: np.ndarray) -> float:
    """The non-negative risk with its penalty, from the sums at ``weights``."""
    least = max(0.0, negative_part(s, prior))
    return prior * s["p_as_positive"] + least + 0.5 * float(_ridge() @ weights**2)


def _step(s: dict, prior: float, weights: np.ndarray) -> np.ndarray:
    """The step to take from ``weights``, before it is shortened."""
    ridge = _ridge()
    curve = s["u_hessian"] + np.diag(ridge)
    negative = negative_part(s, prior)
    if negative >= 0:
        # The loss of z less that of -z is -z, so positives enter by their mean alone.
        step = -np.linalg.solve(curve, s["u_up"] - prior * s["p_mean"] + ridge * weights)
    else:
        slope = s["u_up"] - prior * s["p_up"]
        step = np.linalg.solve(curve, slope)
        step *= -negative / max(slope @ step, 1e-12)
    return step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))


def _descend(rows: DataFrame, start: np.ndarray, objective, direction) -> np.ndarray:
    """The weights of the lowest ``objective`` met; steps that do not lower it are halved. A step
    that the direction's other branch may still use (it crossed into it) goes on from there once."""
    best, sums = start, _sums(rows, start)
    if not sums["u_n"] or not sums["p_n"]:
        return start
    lowest, scale = objective(sums, best), 1.0
    at, crossed = best, False
    for _ in range(STEPS):
        move = direction(sums, at)
        if np.abs(move).max() * scale < 1e-4 or scale < SHORTEST:
            break
        tried = at + scale * move
        new = _sums(rows, tried)
        value = objective(new, tried)
        if value < lowest - 1e-9:
            best, best_sums, lowest = tried, new, value
            at, sums, crossed, scale = tried, new, False, min(1.0, 2 * scale)
            continue
        if at is best:
            best_sums = sums
        if not crossed:
            at, sums, crossed = tried, new, True
        else:
            at, sums, crossed, scale = best, best_sums, False, scale / 2
    return best


def fit(rows: DataFrame, prior: float) -> np.ndarray:
    """Weights from counted rows (x, unlabelled, positive): the constant first. Without positives
    or unlabelled rows they give the prior to every text."""
    start = np.zeros(WIDTH)
    start[0] = np.log(prior / (1 - prior))
    return _descend(
        rows, start, lambda s, w: risk(s, prior, w), lambda s, w: _step(s, prior, w)
    )


def class_prior(rows: DataFrame) -> float:
    """The share of positives among unlabelled texts, from counted rows; 0.5 where nothing tells.

    Of all bounds of the score, the one with the least upper estimate of (share of unlabelled
    texts above) / (share of positives above) gives the prior.
    """
    half = F.pmod(F.xxhash64("x"), F.lit(2))
    ridge = _ridge()

    def objective(s: dict, w: np.ndarray) -> float:
        return s["p_as_positive"] + s["u_as_negative"] + 0.5 * float(ridge @ w**2)

    def direction(s: dict, w: np.ndarray) -> np.ndarray:
        slope = s["u_up"] + s["p_up"] - s["p_mean"] + ridge * w
        step = -np.linalg.solve(s["u_hessian"] + s["p_hessian"] + np.diag(ridge), slope)
        return step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))

    # Each half's texts are scored by what the other half taught.
    learned = [
        _descend(rows.where(half == 1 - k), np.zeros(WIDTH), objective, direction) for k in (0, 1)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, which = unpacked(batch.column(0)), batch.column(3).to_numpy()
            z = np.clip((x * np.stack(learned)[which]).sum(axis=1), -500, 500)
            at = np.minimum((SCORE_RANGES / (1 + np.exp(-z))).astype(np.int32), SCORE_RANGES - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), batch.column(1), batch.column(2)], names=["at", "u", "p"]
            )

    placed = rows.select("x", "unlabelled", "positive", half.alias("half"))
    counts = placed.mapInArrow(run, "at int, u long, p long").groupBy("at").sum("u", "p")
    held = np.zeros((2, SCORE_RANGES))
    for at, u, p in counts.collect():  # one row per range of scores
        held[:, at] = u, p
    n_unlabelled, n_positive = held.sum(axis=1)
    if not n_unlabelled or not n_positive:
        return 0.5
    above = held[:, ::-1].cumsum(axis=1)
    u, p = above[0] / n_unlabelled, above[1] / n_positive
    margin = np.sqrt(np.log(4 / DOUBT) / 2) * (n_unlabelled**-0.5 + n_positive**-0.5)
    u, p = u[p > 0], p[p > 0]
    best = int(np.argmin((u + margin) / p))
    return float(min(max(u[best] / p[best], PRIOR_BOUNDS[0]), PRIOR_BOUNDS[1]))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Labels count only where doc_id is outside the held-out part; a null label counts as none,
    repeated labels of a document count once, its best. Without positives every score is the
    prior. Rows that repeat get the same score, an empty table gives none.
    """
    rows = materialize(measured(docs), "traits")
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .groupBy(F.col("doc_id").cast("long").alias("_labelled"))
        .agg(F.max("quality").alias("quality"))
    )
    known = materialize(known, "labelled")
    learning = rows.where(~F.col("held_out")).join(
        known.where("quality = 1"), F.col("doc_id") == F.col("_labelled"), "left"
    )
    counted = learning.groupBy("x").agg(
        F.count("*").alias("unlabelled"), F.count("_labelled").alias("positive")
    )
    counted = materialize(counted, "patterns")
    weights = fit(counted, class_prior(counted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.clip(unpacked(batch.column(2)) @ weights, -500, 500)
            score = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(score),
                    pa.array((score >= threshold).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
