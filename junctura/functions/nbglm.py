"""Negative-binomial regression in numpy: fit, dispersion, trend, shrinkage, likelihood ratio.

Log link, an offset for each sample, variance mu + alpha mu^2.
"""

from __future__ import annotations

import math

import numpy as np

LOW, HIGH = 0.0, 10.0


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def chi2_1_survival(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def deviance(y: np.ndarray, mu: np.ndarray, alpha: float) -> float:
    with np.errstate(divide="ignore", invalid="ignore"):
        first = np.where(y > 0, y * np.log(y / mu), 0.0)
    return float(2 * np.sum(first - (y + 1 / alpha) * np.log((1 + alpha * y) / (1 + alpha * mu))))


def fit(y: np.ndarray, x: np.ndarray, offset: np.ndarray, alpha: float, rounds: int = 100, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, means, deviance) by iteratively reweighted least squares."""
    mu = (y + y.mean()) / 2
    mu = np.maximum(mu, 1e-8)
    eta, last = np.log(mu), np.inf
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        w = mu / (1 + alpha * mu)
        z = eta - offset + (y - mu) / mu
        root = np.sqrt(w)
        beta = np.linalg.lstsq(x * root[:, None], z * root, rcond=None)[0]
        eta = np.clip(x @ beta + offset, -30, 30)
        mu = np.exp(eta)
        now = deviance(y, mu, alpha)
        if abs(now - last) <= tol * max(1.0, abs(now)):
            break
        last = now
    return beta, mu, now


def profile(d: float, y: np.ndarray, mu: np.ndarray, x: np.ndarray) -> float:
    """Cox-Reid adjusted log-likelihood of a dispersion, the means held fixed."""
    n = 1 / d
    like = np.sum(_lgamma(y + n) - _lgamma(y + 1)) - len(y) * math.lgamma(n) + np.sum(n * np.log(n / (n + mu)) + y * np.log(mu / (n + mu)))
    w = mu / (1 + mu * d)
    sign, logdet = np.linalg.slogdet((x * w[:, None]).T @ x)
    return float(like - 0.5 * logdet) if sign > 0 else -np.inf


SMALLER = (3 - math.sqrt(5)) / 2  # the smaller part of a golden section
Point = tuple[float, float]  # place, value


def to_vertex(best: Point, second: Point, third: Point) -> float | None:
    """The way from the best point to the vertex of the parabola through three; none if they lie on a line."""
    (x, fx), (w, fw), (v, fv) = best, second, third
    near, far = (x - w) * (fx - fv), (x - v) * (fx - fw)
    return None if near == far else ((x - w) * near - (x - v) * far) / (2 * (far - near))


def bounded_max(f, low: float = LOW, high: float = HIGH, xatol: float = 1e-5, rounds: int = 500) -> tuple[float, bool]:
    """Brent's search for a maximum of ``f`` inside (low, high); (place, converged).

    The three best points are kept.  A step goes to the vertex of their parabola if that
    lies between the bounds and is less than half of the step before the last; otherwise
    it is a golden section of the wider side."""
    start = low + SMALLER * (high - low)
    held: list[Point] = [(start, f(start))]  # the best first; a later one of equals before
    step = earlier = 0.0
    for _ in range(rounds):
        x, middle = held[0][0], (low + high) / 2
        tol = math.sqrt(2.2e-16) * abs(x) + xatol / 3
        if abs(x - middle) + (high - low) / 2 <= 2 * tol:
            return x, True
        way = to_vertex(*held) if len(held) == 3 and abs(earlier) > tol else None
        if way is not None and low - x < way < high - x and abs(way) < abs(earlier) / 2:
            step, earlier = way, step
            if min(x + step - low, high - x - step) < 2 * tol:
                step = math.copysign(tol, middle - x)
        else:
            earlier = (low if x >= middle else high) - x
            step = SMALLER * earlier
        at = x + math.copysign(max(abs(step), tol), step)
        new = (at, f(at))
        better = new[1] >= held[0][1]
        # the worse of the two points is a bound from now on
        bound = x if better else at
        low, high = (bound, high) if (at >= x) == better else (low, bound)
        held.insert(next((i for i, p in enumerate(held) if new[1] >= p[1]), len(held)), new)
        del held[3:]
    return held[0][0], False


def design(in_a: np.ndarray, null: bool = False) -> np.ndarray:
    """Rows: events then gene expression over the samples; columns: one, splicing in A, expression in A, is gene."""
    n = len(in_a)
    one, gene = np.ones(2 * n), np.repeat([0.0, 1.0], n)
    splice, expression = np.concatenate([in_a, np.zeros(n)]), np.concatenate([in_a, in_a])
    return np.stack([one, expression, gene] if null else [one, splice, expression, gene], 1).astype(float)


def raw_dispersion(y: np.ndarray, sf: np.ndarray, x: np.ndarray, min_count: float, max_zero: float = 0.6, start: float = 0.1) -> tuple[float, bool]:
    """(dispersion, converged); nan for rows with too few reads or too many zeros."""
    if (y / sf).sum() < min_count or (y == 0).mean() > max_zero:
        return math.nan, False
    return _alternate(y, sf, x, start, lambda d, mu: profile(d, y, mu, x))


def adjusted_dispersion(y: np.ndarray, sf: np.ndarray, x: np.ndarray, start: float, trend: float, prior: float) -> tuple[float, bool]:
    """The dispersion under a log-normal prior around the trend; ``prior`` is squared once more in it."""
    if not (start > 0 and trend > 0):
        return math.nan, False
    return _alternate(y, sf, x, start, lambda d, mu: profile(d, y, mu, x) - (math.log(d) - math.log(trend)) ** 2 / (2 * prior * prior))


def _alternate(y, sf, x, start, objective) -> tuple[float, bool]:
    d, offset, ok = start, np.log(sf), False
    try:
        for _ in range(10):
            _, mu, _ = fit(y, x, offset, d)
            new, ok = bounded_max(lambda v: objective(v, mu))  # noqa: B023
            done = abs(math.log(new) - math.log(d)) < 1e-4
            d = new
            if done:
                break
    except (np.linalg.LinAlgError, ValueError):
        return math.nan, False
    return d, ok


def ratio_test(y: np.ndarray, sf: np.ndarray, in_a: np.ndarray, disp: float, max_zero: float) -> float:
    """p of the splicing column; nan for rows without a dispersion or with too many zeros in the event half."""
    n = len(in_a)
    if not disp > 0 or (y[:n] == 0).sum() > max_zero * n:
        return math.nan
    try:
        offset = np.log(sf)
        full, null = (fit(y, design(in_a, k), offset, disp)[2] for k in (False, True))
    except np.linalg.LinAlgError:
        return math.nan
    return chi2_1_survival(null - full)
