"""The classifier's risk and class prior against plain numpy on small counted tables."""

import numpy as np
import pytest

from jobmart.llm import pu_classifier as pu


def _rows(spark, prior, n=3000, seed=3):
    """Counted patterns of which a share ``prior`` is positive; every third positive is trusted."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < prior
    chance = np.where(good[:, None], 0.2, 0.7) * np.ones(pu.WIDTH - 1)
    bits = rng.random(chance.shape) < chance
    known = good & (rng.random(n) < 1 / 3)
    rows = [(np.packbits(b).tobytes(), 1, int(k)) for b, k in zip(bits, known)]
    frame = spark.createDataFrame(
        [(bytearray(x), u, p) for x, u, p in rows], "x binary, unlabelled long, positive long"
    )
    x = np.hstack([np.ones((n, 1)), bits])
    return frame, x, known, good


def _risk(x, known, prior, w):
    z = x @ w
    negative = pu.log1pexp(z).mean() - prior * pu.log1pexp(z[known]).mean()
    positive = prior * pu.log1pexp(-z[known]).mean()
    return positive + max(0, negative) + 0.5 * pu._ridge() @ w**2, negative


def test_risk_and_both_gradients(spark):
    frame, x, known, _ = _rows(spark, 0.6, n=400)
    w = np.random.default_rng(1).normal(size=pu.WIDTH) * 0.2
    s = pu._sums(frame, w)
    want, negative = _risk(x, known, 0.6, w)
    assert pu.risk(s, 0.6, w) == pytest.approx(want)
    assert pu.negative_part(s, 0.6) == pytest.approx(negative)
    slope = s["u_up"] - 0.6 * s["p_up"]
    for i in (0, 3, 40):
        e = np.zeros(pu.WIDTH)
        e[i] = 1e-5
        numeric = (_risk(x, known, 0.6, w + e)[1] - _risk(x, known, 0.6, w - e)[1]) / 2e-5
        assert slope[i] == pytest.approx(numeric, abs=1e-6)


def test_a_step_below_zero_brings_the_part_back(spark):
    frame, x, known, _ = _rows(spark, 0.6, n=400)
    w = np.where(np.arange(pu.WIDTH) == 0, 4.0, -0.2)
    prior = 0.95  # far too much: the part under the maximum is negative
    s = pu._sums(frame, w)
    before = pu.negative_part(s, prior)
    assert before < 0
    after = _risk(x, known, prior, w + pu._step(s, prior, w))[1]
    assert abs(after) < abs(before)


def test_fit_is_as_low_as_plain_descent(spark):
    frame, x, known, _ = _rows(spark, 0.6, n=1500)
    prior = 0.6
    found = pu.fit(frame.coalesce(2).cache(), prior)
    w = np.zeros(pu.WIDTH)
    w[0] = np.log(prior / (1 - prior))
    lowest = _risk(x, known, prior, w)[0]
    for _ in range(1500):
        up = 1 / (1 + np.exp(-x @ w))
        slope_negative = (up[:, None] * x).mean(axis=0) - prior * (up[known][:, None] * x[known]).mean(axis=0)
        if _risk(x, known, prior, w)[1] >= 0:
            slope = prior * ((up[known] - 1)[:, None] * x[known]).mean(axis=0) + slope_negative + pu._ridge() * w
        else:
            slope = -slope_negative
        w = w - 0.05 * slope
        lowest = min(lowest, _risk(x, known, prior, w)[0])
    assert _risk(x, known, prior, found)[0] <= lowest + 1e-3


@pytest.mark.parametrize("prior", [0.3, 0.8])
def test_prior_from_positives_and_unlabelled(spark, prior):
    frame, _, _, good = _rows(spark, prior)
    assert pu.class_prior(frame.coalesce(2).cache()) == pytest.approx(good.mean(), abs=0.06)


def test_prior_without_positives(spark):
    frame, _, _, _ = _rows(spark, 0.5, n=50)
    assert pu.class_prior(frame.selectExpr("x", "unlabelled", "0L AS positive")) == 0.5
