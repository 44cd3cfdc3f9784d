"""The distributed dispersion trend against a plain version of itself."""

import numpy as np
import pytest

from junctura.functions import nbglm
from junctura.operators import testing


def trend(means: np.ndarray, disp: np.ndarray, converged: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(l0, l1, raw with nan filled, fitted): dispersion = l0 / mean + l1, a Gamma regression with identity link."""
    good = converged & ~np.isnan(disp)
    if not good.any():
        raise ValueError("no dispersion converged")
    low, high = np.percentile(np.unique(disp[good]), [1, 99])
    filled = np.where(np.isnan(disp), low, disp)
    rows = good & (filled > low) & (filled < high) & (means > 0)
    if rows.sum() < 2:
        level = float(np.median(filled[good]))
        return 0.0, level, filled, np.full(len(filled), level)
    x, y = np.stack([1 / means[rows], np.ones(rows.sum())], 1), filled[rows]
    mu, beta = y.copy(), np.zeros(2)
    for _ in range(100):
        w = 1 / mu
        new = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]
        mu = np.maximum(x @ new, 1e-8)
        if np.allclose(new, beta, rtol=1e-8, atol=1e-12):
            beta = new
            break
        beta = new
    with np.errstate(divide="ignore"):
        fitted = np.where(means > 0, beta[0] / np.where(means > 0, means, 1) + beta[1], np.nan)
    return float(beta[0]), float(beta[1]), filled, fitted


def prior_variance(raw: np.ndarray, fitted: np.ndarray, samples: int, columns: int, least: float = 0.1) -> float:
    ok = (raw > 0) & (fitted > 0)
    if not ok.any():
        return least
    gap = np.log(raw[ok]) - np.log(fitted[ok])
    mad = 1.4826 * np.median(np.abs(gap - np.median(gap)))
    return max(mad * mad - nbglm.trigamma((samples - columns) / 2), least)


@pytest.mark.parametrize("n", [1, 2, 3, 400])
def test_trend(spark, n):
    rng = np.random.default_rng(n)
    means = rng.gamma(2, 50, n)
    disp = (3 / means + 0.05) * rng.gamma(5, 0.2, n)
    disp[rng.random(n) < 0.1] = np.nan
    disp[0] = 0.2
    ok = ~np.isnan(disp) & (rng.random(n) < 0.9)
    ok[0] = True
    rows = [(float(m), None if np.isnan(d) else float(d), bool(o)) for m, d, o in zip(means, disp, ok)]
    l0, l1, low, prior = testing.trend(spark.createDataFrame(rows, "mean double, disp double, ok boolean").repartition(3), 24)
    want0, want1, filled, fitted = trend(means, disp, ok)
    assert np.allclose([l0, l1], [want0, want1], rtol=1e-6)
    assert np.isclose(low, np.percentile(np.unique(disp[ok & ~np.isnan(disp)]), 1))
    assert np.isclose(prior, prior_variance(filled, fitted, 24, 4), rtol=1e-6)


def test_trend_of_nothing(spark):
    assert testing.trend(spark.createDataFrame([(1.0, None, False)], "mean double, disp double, ok boolean"), 24) == (0.0, 0.0, 0.0, 0.1)


def test_quantiles(spark):
    values = np.random.default_rng(5).integers(0, 500, 30_000).astype(float)
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    shares = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    assert testing.quantiles(frame, "v", shares) == np.percentile(values, [100 * s for s in shares]).tolist()
