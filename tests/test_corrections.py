"""Adjusted p-values against plain versions."""

import random
from itertools import combinations

import numpy as np
import pytest

from junctura.functions import multiple_testing


def plain(p, method):
    """Each adjusted value from its definition; ranks of equal p are their last or, for Holm, their first one."""
    m, out = len(p), []
    last = lambda x: sum(y <= x for y in p)
    first = lambda x: sum(y < x for y in p) + 1
    bh = lambda x: min(y * m / last(y) for y in p if y >= x)
    for x in p:
        if method == "bonferroni":
            v = x * m
        elif method == "holm":
            v = max(y * (m - first(y) + 1) for y in p if y <= x)
        elif method == "hochberg":
            v = min(y * (m - last(y) + 1) for y in p if y >= x)
        elif method == "bh":
            v = bh(x)
        elif method == "by":
            v = bh(x) * sum(1 / k for k in range(1, m + 1))
        else:
            left = m - sum(bh(y) <= 0.1 / 1.1 for y in p)
            v = bh(x) * ((left or m) / m) * 1.1
        out.append(min(v, 1.0))
    return out


@pytest.mark.parametrize("per_range", [200_000, 7])
@pytest.mark.parametrize("method", ["bonferroni", "holm", "hochberg", "bh", "by", "tsbh"])
def test_against_plain_version(spark, monkeypatch, method, per_range):
    monkeypatch.setattr(multiple_testing, "PER_RANGE", per_range)
    rng = random.Random(3)
    p = [rng.choice([None, 0.0, 1.0, 0.5, rng.random(), rng.random() / 1000]) for _ in range(90)]
    rows = [(i, i % 2, x) for i, x in enumerate(p)]
    frame = spark.createDataFrame(rows, "i int, family int, p double").repartition(3)
    got = {r.i: r.p_adj for r in multiple_testing.adjust(frame, "p", method).collect()}
    have = [i for i, x in enumerate(p) if x is not None]
    assert np.allclose([got[i] for i in have], plain([p[i] for i in have], method)) and all(got[i] is None for i in range(90) if p[i] is None)
    if per_range == 7:
        got = {r.i: r.p_adj for r in multiple_testing.adjust(frame, "p", method, ["family"]).collect()}
        for family in (0, 1):
            own = [i for i in have if i % 2 == family]
            assert np.allclose([got[i] for i in own], plain([p[i] for i in own], method))


def test_hommel(spark):
    """By its closed test: p is rejected at a level where the Simes test of every set that holds it is."""
    rng = random.Random(4)
    for turn in range(60):
        q = np.sort([rng.choice([0.0, 1.0, 0.02, rng.random(), rng.random() / 30]) for _ in range(rng.randint(1, 8))])
        want = [max((n * np.sort(q[list(s)]) / np.arange(1, n + 1)).min() for n in range(1, len(q) + 1) for s in combinations(range(len(q)), n) if i in s) for i in range(len(q))]
        assert np.allclose(multiple_testing.hommel(q), want)
    s = np.sort(np.random.default_rng(1).random(300) ** 3)
    want = [min(k * s[300 - k + j] / (j + 1) for j in range(k)) for k in range(1, 301)]
    assert np.allclose(multiple_testing.simes(s), want)
    got = [r.p_adj for r in multiple_testing.adjust(spark.createDataFrame(list(enumerate([0.004, 0.03, None, 0.011, 0.2])), "i int, p double"), "p", "hommel").orderBy("i").collect()]
    assert np.allclose([x for x in got if x is not None], [0.016, 0.06, 0.033, 0.2]) and got[2] is None


def test_harmonic(spark):
    for m in (1, 2, 999, 1000, 1001, 50_000):
        got = spark.range(1).select(multiple_testing.harmonic(multiple_testing.F.lit(m))).first()[0]
        assert abs(got - sum(1 / k for k in range(1, m + 1))) < 1e-12


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        multiple_testing.adjust(spark.createDataFrame([(0.5,)], "p double"), "p", "none")
