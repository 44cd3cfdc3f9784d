"""Risk-controlled thresholds against a plain version, and their guarantee on simulated labels."""

from math import comb

import duck
import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.llm import quality, queries, storage

GRIDS = list(quality.GRIDS.values())


def plain(tune, tune_good, hold, hold_good, alpha, level):
    """The cutoff (or None) of each rule of one stratum: values are rows of five numbers."""
    steps = []
    for r, grid in enumerate(GRIDS):
        for c in grid:
            over = tune[:, r] > c
            if (over & ~tune_good).sum():
                steps.append((int((over & tune_good).sum()), -int((over & ~tune_good).sum()), r, c))
    steps.sort()
    n, lost, best, taken = int(hold_good.sum()), np.zeros(len(hold), bool), 0, 0
    for i, (_, _, r, c) in enumerate(steps, 1):
        lost |= hold[:, r] > c
        k = int((lost & hold_good).sum())
        tail = sum(comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1)) if k < n * alpha else 1.0
        if tail > level:
            break
        if (net := int((lost & ~hold_good).sum()) - k) > best:
            best, taken = net, i
    return [min((c for _, _, r, c in steps[:taken] if r == rule), default=None) for rule in range(len(GRIDS))]


def sample(rng, n, overlap):
    """Values and labels; ``overlap`` is the share of good rows that look like bad ones."""
    good = rng.random(n) < 0.8
    like_bad = ~good | (rng.random(n) < overlap)
    high = rng.random((n, 5)) * np.array([0.4, 0.4, 1, 1, 0.5])
    values = np.where(like_bad[:, None] & (rng.random((n, 5)) < 0.5), high, high * 0.02)
    return values, good


def test_thresholds_against_plain_version(spark):
    rng, rows, want = np.random.default_rng(8), [], {}
    for stratum, n, overlap in (("few", 40, 0), ("some", 400, 0.01), ("many", 3000, 0.03), ("hard", 2000, 0.3)):
        values, good = sample(rng, n, overlap)
        tuning = rng.random(n) < 0.5
        rows += [(stratum, v.tolist(), bool(g), bool(t)) for v, g, t in zip(values, good, tuning)]
        want[stratum] = plain(values[tuning], good[tuning], values[~tuning], good[~tuning], 0.05, 0.05 / 4)
    frame = spark.createDataFrame(rows, "stratum string, values array<double>, good boolean, tuning boolean").repartition(3)
    got = {r.stratum: [r[g] for g in quality.GRIDS] for r in quality.thresholds(frame, 0.05, 0.05).collect()}
    assert got == want
    assert any(want["many"]) and not any(want["few"])


def test_false_rejections_are_bounded():
    """Over 400 simulated label sets, the true false-rejection rate exceeds alpha less often than delta."""
    rng, broken, used = np.random.default_rng(3), 0, 0
    fresh, fresh_good = sample(rng, 40_000, 0.06)
    fresh = fresh[fresh_good]
    for _ in range(400):
        values, good = sample(rng, 600, 0.06)
        half = rng.random(600) < 0.5
        cut = plain(values[half], good[half], values[~half], good[~half], 0.05, 0.05)
        used += any(c is not None for c in cut)
        lost = np.zeros(len(fresh), bool)
        for r, c in enumerate(cut):
            if c is not None:
                lost |= fresh[:, r] > c
        broken += lost.mean() > 0.05
    assert used > 100 and broken <= 0.05 * 400


def test_each_large_stratum_has_a_cutoff(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    some = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text", "lang").repartition(8)
    featured = storage.table(quality.with_features(some).drop("text", "lang"), "t")
    rows = storage.table(quality.labelled(featured, labels), "t")
    large = {r.stratum for r in rows.where("good").groupBy("stratum").count().where("count >= 400").collect()}
    cut = {r.stratum: r for r in quality.thresholds(rows, 0.05, 0.05).collect()}
    assert len(large) >= 3 and all(any(cut[s][g] is not None for g in quality.GRIDS) for s in large)
    judged = quality.judge(featured, labels).join(labels, "doc_id").where("NOT base_failed")
    got = {(r.quality, r.kept): r.n for r in judged.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert got.get((0, True), 0) < 0.05 * got[0, False] and got.get((1, False), 0) < 0.05 * got[1, True]


@pytest.mark.parametrize("name", ["op5_license_scan", "op6_quality_rules", "op9_ngram_join"])
def test_sql(spark, sf, name):
    got = [tuple(r[c] for c in sorted(r.asDict())) for r in queries.QUERIES[name](spark, sf).collect()]
    found = duck.connect(sf).sql(queries.ORACLES[name])
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    assert sorted(map(repr, got)) == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())
