"""op13: the identity, features word by word, folds, held-out accuracy, odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from junctura.llm import queries
from junctura.llm import quality_classifier as qc


def slow_features(text):
    """Words, repeats and ratios of one text, plainly."""
    t = text or ""
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", t)]
    lines = [x for x in t.split("\n") if x]
    three = list(zip(words, words[1:], words[2:]))
    size = max(1, len(t.encode()))
    extra = lambda x: len(x) - len(set(x))
    return words, {
        "words": np.log1p(len(words)), "word_length": sum(len(w.encode()) for w in words) / max(1, len(words)), "upper": len(re.findall("[A-Z]", t)) / size, "digit": len(re.findall("[0-9]", t)) / size,
        "symbol": len(re.findall(r"[#*$%&|<>]", t)) / size, "bang": len(re.findall("[!?]", t)) / size, "end": len(re.findall("[.,;:]", t)) / size, "line": t.count("\n") / max(1, len(words)),
        "wide": sum(ord(c) > 127 for c in t) / size, "line_repeats": extra(lines) / max(1, len(lines)), "word_repeats": extra(words) / max(1, len(words)), "window_repeats": extra(three) / max(1, len(words)),
    }


TEXTS = ["", None, "Word", "the the THE cat\nsat\n\nsat\n", "ends with line\n", "\n\n", "a b c a b c a b c", "é ü É 12 x#y !? .,;:", "tail ", " (x)[y] \x00", "no end" * 2000, "one\ntwo", "two\none"]


@pytest.mark.parametrize("rows", [TEXTS, TEXTS[::-1], TEXTS[:1], TEXTS[2:3]])
def test_features(rows):
    x = qc.features(pa.array(rows, pa.string()), pa.array([None, 5] * len(rows), pa.int64()).slice(0, len(rows)))
    for i, t in enumerate(rows):
        words, want = slow_features(t)
        got = dict(zip(qc.STATISTICS, x.statistics[i]))
        for k, v in want.items():
            assert got[k] == pytest.approx(v), (t, k)
        assert got["stated_length"] == (-1 if i % 2 == 0 else pytest.approx(np.log1p(5)))
        n = Counter(words)
        norm = np.sqrt(sum(np.log1p(c) ** 2 for c in n.values()))
        weights = x.weight[x.first[i] : x.first[i + 1]]
        if len(weights) == len(n):  # no two words share a bucket
            assert sorted(weights) == pytest.approx(sorted(np.log1p(c) / norm for c in n.values()), rel=1e-5)
        assert len(weights) <= len(n) and (len(n) == 0) == (len(weights) == 0)


def test_equal_words_have_equal_buckets_anywhere():
    a = qc.features(pa.array(["quality", "x" * 1000 + " QUALITY"]), pa.array([None, None], pa.int64()))
    assert a.bucket[0] in a.bucket[a.first[1] :]


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = qc.Machine.blank([np.zeros(1)] * 2)
    m.w, m.v, m.bias = rng.normal(size=len(m.w)), rng.normal(size=m.v.shape), 0.3
    f, x = np.array([3, 9, 40, 41, 7]), rng.normal(size=5)
    got = m.margins(np.array([0, 4, 5]), f, x)[0]
    pairs = sum(m.v[f[i]] @ m.v[f[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert got == pytest.approx([0.3 + m.w[f[:4]] @ x[:4] + pairs, 0.3 + m.w[7] * x[4]])


def test_interactions_are_learned():
    """The label is whether two words occur together or both not: no sum of weights tells it."""
    rng = np.random.default_rng(1)
    rows = [(a, b) for a in (0, 1) for b in (0, 1)] * 150
    texts = [" ".join(rng.permutation([("red" if a else "blue"), ("round" if b else "square")])) for a, b in rows]
    y = np.array([float(a == b) for a, b in rows])
    x = qc.features(pa.array(texts), pa.nulls(len(texts), pa.int64()))
    m = qc.fit(x, y)
    assert ((m.score(x) >= 0.5) == y).mean() == 1


def test_held_out_accuracy_and_folds(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_factorisation_machine"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(got) == docs and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    test = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    good = [p for p, q in test if q == 1]
    assert np.mean([p == q for p, q in test]) > 0.95 and np.mean(good) > 0.98


def test_labels_of_the_fold_and_other_columns_do_not_matter(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    a = qc.classify(docs, labels).collect()
    turned = labels.withColumn("quality", F.when(qc.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None)).withColumn("score", F.lit(0)).withColumn("fold", F.lit(3))
    b = qc.classify(other.repartition(5), turned).collect()
    assert {(r["doc_id"], round(r["score"], 9)) for r in a} == {(r["doc_id"], round(r["score"], 9)) for r in b}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "some text", 9), (3, "same words", None), (3, "same words", None), (4, "word " * 300_000, 1_500_000)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 0), (None, 1), (4, 1), (4, None), (77, 1), (2, 5)], "doc_id long, quality int")
    got = qc.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    same = [r["score"] for r in got if r["doc_id"] == 3]
    assert same[0] == same[1] and next(r for r in got if r["doc_id"] is None)["held_out"] is False
    assert {r["score"] for r in qc.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert qc.classify(docs.limit(0), labels).collect() == []
    assert qc.classify(docs.drop("n_chars"), labels).count() == 6
