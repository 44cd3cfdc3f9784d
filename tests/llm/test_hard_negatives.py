"""op12 against a plain search over all pairs, and against SQL."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.llm import hard_negatives, queries
from tests.duck import connect, rows

INF = float("inf")
KIND = "vec_id long, embedding array<float>, label int, q string, list int"


def plain(data, every=100, n_positives=5, n_negatives=10):
    kept = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in e], label) for i, e, label in data if label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (anchor, x, label) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), i, other == label) for b, (i, y, other) in enumerate(kept) if a != b]
        for s, i, _ in sorted((r for r in scored if r[2]), key=order)[:n_positives]:
            found = sorted((r for r in scored if not r[2] and 30 * s <= 100 * r[0] <= 90 * s), key=order)[:n_negatives]
            out += [(anchor, i, k, r[1], s, r[0]) for k, r in enumerate(found, 1)]
    return sorted(out, key=repr)


def mined(spark, data, **kw):
    df = spark.createDataFrame([(*r, "q", 1) for r in data], KIND)
    return sorted((tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % kw.pop("every", 100) == 0, **kw).collect()), key=repr)


def test_query_equals_its_sql(spark, sf):
    got = queries.QUERIES["op12_hard_negatives"](spark, sf).toPandas()
    assert len(got) and rows(got) == rows(connect(sf).sql(queries.ORACLES["op12_hard_negatives"]).df())


@pytest.mark.parametrize("parts", [5, 16_384])
def test_clusters_copies_and_ties(spark, monkeypatch, parts):
    monkeypatch.setattr(hard_negatives, "PART_ROWS", parts)
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.2, (6, 8))
    data = [(i, (centres[i % 6] + rng.normal(0, 0.03, 8)).round(2).tolist(), i % 4) for i in range(240)]
    data += [(1000 + i, data[0][1], 0) for i in range(130)] + [(2000 + i, data[0][1], 1 + i % 2) for i in range(60)]  # copies: as many as all others
    data += [data[20], data[20], (100, data[3][1], 3), (None, data[7][1], 3), (None, data[7][1], 2)]
    random.Random(1).shuffle(data)
    want = plain(data, 20)
    assert len(want) > 200 and mined(spark, data, every=20) == want


def test_edges(spark):
    data = [(0, [0.5, 0.25], 1), (1, [0.5, 0.2], 1), (2, [0.4, 0.1], 2), (3, None, 2), (4, [0.1, None], 2), (5, [float("nan"), 1.0], 2), (6, [INF, 1.0], 2), (7, [0.3, 0.1], None),
            (8, [], 2), (9, [0.3], 2), (100, [0.0, 0.0], 2), (200, [-0.5, -0.5], 1), (300, [0.2, 0.3], 5)]
    want = plain(data)
    assert want and mined(spark, data) == want
    assert mined(spark, []) == []
    assert mined(spark, [(0, None, 1)]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    with pytest.raises(ValueError):
        mined(spark, [(0, [3e30], 1), (1, [3e30], 1)])
    big = [(0, [3e5, 1e5], 1), (1, [2.5e5, 2e5], 1), (2, [1.5e5, 1e5], 2), (3, [1.49e5, 1e5], 2)]  # beyond what a double holds exactly
    assert mined(spark, big) == plain(big)


def test_lists_are_left_out(spark, monkeypatch):
    """Well separated clusters: a search does not visit them all."""
    monkeypatch.setattr(hard_negatives, "MAX_LISTS", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (40, 16))
    data = [(i, (centres[i % 40] + rng.normal(0, 0.005, 16)).tolist(), i % 2) for i in range(1600)]
    df = spark.createDataFrame([(*r, "", 0) for r in data], KIND)
    table = hard_negatives.storage.table(hard_negatives.vectors(df, "vec_id", F.col("label"), "embedding", 256), "t")
    index = hard_negatives.build(table, 11)
    q = np.floor(256 * np.float64(np.float32([data[0][1]]))).astype(np.int64)
    search = hard_negatives.Search(index, q, np.array([0]), np.array([[-(2**53)]]), np.array([[2**53]]), 6, True)
    best = search.run()[0][0]
    assert search.n_visits < 10
    scores = sorted((int(np.floor(256 * np.float64(np.float32(e))) @ q[0]) for i, e, label in data if label == 0), reverse=True)[:6]
    assert best[0].tolist() == scores and all(i % 40 == 0 for i in best[1].tolist())
