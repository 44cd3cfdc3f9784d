"""A factorisation machine that scores the quality of texts.

    score(x) = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The features of a text are its words, hashed, statistics of its structure and its
metadata (the stated length), the latter two as bins.  All pairs of features interact
by vectors of low rank; by

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

a text is scored in time linear in its features.  The machine is fitted on at most
``FIT_ROWS`` labelled documents, the first by a hash of their ids, whatever the size of
the table; the documents of the held-out fold give no label to it.  Every document is
scored over its whole text, in slices of bounded bytes, with numpy on the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.word_encoding import slices

FIT_ROWS = 8192  # labelled documents that the machine is fitted on, at most
BUCKETS = 4096
RANK = 8
BINS = 8
EPOCHS, BATCH, RATE = 15, 128, 0.1
DECAY = 1e-4
SLICE_BYTES = 4 << 20

# The bytes of each kind; bytes above 127 belong to words.
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&|<>", "bang": b"!?", "end": b".,;:", "line": b"\n", "space": b" \t\x0b\x0c\r"}
STATISTICS = ["words", "word_length", "upper", "digit", "symbol", "bang", "end", "other", "line", "wide", "line_repeats", "word_repeats", "window_repeats", "stated_length"]


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of each byte (0: other, 9: above 127), whether it belongs to words, and its lower case."""
    kind, word, lower = np.zeros(256, np.uint8), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    for k, chars in enumerate(KINDS.values(), 1):
        kind[list(chars)] = k
    kind[128:] = 9
    word[128:] = True
    for name in ("upper", "lower", "digit"):
        word[list(KINDS[name])] = True
    lower[list(KINDS["upper"])] += 32
    return kind, word, lower


@lru_cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    up, down = (np.full(n + 1, x, np.uint64) for x in (base, pow(base, -1, 2**64)))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return up, down


def _hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each range of bytes, the same wherever it stands."""
    size = 1 << max(16, int(len(raw)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
        h = (total[stop] - total[start]) * down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _repeats(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many values of each row are equal to another of the row, but for one of them each."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    same = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    return np.bincount(r[1:][same], minlength=n)


@dataclass
class Features:
    """Of a slice of texts: statistics, and the weighted word buckets of each, row by row."""

    statistics: np.ndarray
    first: np.ndarray
    bucket: np.ndarray
    weight: np.ndarray


def features(texts: pa.Array, stated: pa.Array) -> Features:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    cut = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cut[0] : cut[-1]]
    cut = cut - cut[0]
    kind, word, lower = _tables()
    size = np.diff(cut)
    kinds = kind[raw]

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[cut])

    count = {name: per_row(kinds == k) for k, name in enumerate(KINDS, 1)}
    count["wide"] = per_row(raw >= 0xC0)
    # a text's end ends its last word and line
    inside = word[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    starts = cut[:-1][size > 0]
    begins[starts] = inside[starts]
    ends[cut[1:][size > 0] - 1] = inside[cut[1:][size > 0] - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(cut, start, "right") - 1
    words = np.bincount(row, minlength=n)
    h = _hashes(lower[raw], start, stop)
    with np.errstate(over="ignore"):
        three = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)
    within = row[:-2] == row[2:]
    new = np.flatnonzero(raw == 10)
    line_start, line_row = np.concatenate([cut[:-1], new + 1]), np.concatenate([np.arange(n), np.searchsorted(cut, new, "right") - 1])
    order = np.lexsort((line_start, line_row))  # a line after the last \n of a text begins where the next text does
    line_start, line_row = line_start[order], line_row[order]
    line_stop = np.concatenate([line_start[1:] - 1, [len(raw)]])
    last = np.concatenate([line_row[1:] != line_row[:-1], [True]])
    line_stop[last] = cut[1:][line_row[last]]
    full = line_stop > line_start
    of = lambda a, b: a / np.maximum(b, 1)
    used = per_row(inside)
    stated = pc.fill_null(stated.cast(pa.float64()), -1.0).to_numpy(zero_copy_only=False)
    statistics = np.column_stack([
        np.log1p(words), of(used, words), *(of(count[k], size) for k in ("upper", "digit", "symbol", "bang", "end")),
        of(size - sum(count[k] for k in KINDS) - per_row(raw >= 128), size), of(count["line"], words), of(count["wide"], size),
        of(_repeats(line_row[full], _hashes(raw, line_start[full], line_stop[full]), n), np.bincount(line_row[full], minlength=n)),
        of(_repeats(row, h, n), words), of(_repeats(row[:-2][within], three[within], n), words), np.where(stated >= 0, np.log1p(np.maximum(stated, 0)), -1.0),
    ])
    key, times = np.unique(row * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    first = np.searchsorted(key, np.arange(n + 1) * BUCKETS)
    weight = np.log1p(times)
    norm = np.sqrt(np.diff(np.concatenate([[0.0], np.cumsum(weight**2)])[first]))
    return Features(statistics, first, (key % BUCKETS).astype(np.int32), (weight / np.repeat(np.maximum(norm, 1e-12), np.diff(first))).astype(np.float32))


@dataclass
class Machine:
    """Bins of the statistics, and the weights of all features: word buckets first, then the bins."""

    edges: list[np.ndarray]
    bias: float
    w: np.ndarray
    v: np.ndarray

    @classmethod
    def blank(cls, edges: list[np.ndarray], seed: int = 7) -> "Machine":
        n = BUCKETS + len(edges) * (BINS + 2)
        return cls(edges, 0.0, np.zeros(n), np.random.default_rng(seed).normal(0, 0.05, (n, RANK)))

    def rows(self, x: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first entry of each row, feature, value); every row has a bin of each statistic."""
        n, k = x.statistics.shape
        bins = np.column_stack([BUCKETS + j * (BINS + 2) + np.searchsorted(e, x.statistics[:, j]) for j, e in enumerate(self.edges)])
        n_words = np.diff(x.first)
        first = x.first + np.arange(n + 1) * k
        feature, value = np.empty(first[-1], np.int64), np.empty(first[-1])
        at = np.arange(len(x.bucket)) + np.repeat(np.arange(n) * k, n_words)
        feature[at], value[at] = x.bucket, x.weight
        at = (first[1:, None] - k + np.arange(k)).ravel()
        feature[at], value[at] = bins.ravel(), 1.0
        return first, feature, value

    def margins(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums before the sigmoid, and the row's sums of v x, by the sum-of-squares identity."""
        at = first[:-1]
        vx = self.v[feature] * value[:, None]
        total = np.add.reduceat(vx, at)
        return self.bias + np.add.reduceat(self.w[feature] * value, at) + 0.5 * (total**2 - np.add.reduceat(vx**2, at)).sum(1), total

    def score(self, x: Features) -> np.ndarray:
        if not len(x.statistics):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.rows(x))[0], -500, 500)))


def bin_edges(values: np.ndarray) -> np.ndarray:
    """BINS + 1 limits at most: zero, and quantiles of the values above it."""
    above = values[values > 0]
    return np.unique(np.concatenate([[0.0], np.quantile(above, np.linspace(0, 1, BINS + 1)[1:-1])])) if len(above) else np.zeros(1)


def fit(x: Features, y: np.ndarray) -> Machine:
    """Weights by adaptive gradient steps on the logistic loss; without rows the score is 0.5."""
    machine = Machine.blank([bin_edges(x.statistics[:, j]) for j in range(len(STATISTICS))])
    if not len(y):
        machine.v[:] = 0
        return machine
    first, feature, value = machine.rows(x)
    rate = np.clip(y.mean(), 0.01, 0.99)
    machine.bias = float(np.log(rate / (1 - rate)))
    g_w, g_v, g_b = np.full(len(machine.w), 1e-6), np.full(machine.v.shape, 1e-6), 1e-6
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            size = first[rows + 1] - first[rows]
            cut = np.concatenate([[0], np.cumsum(size)])
            entry = np.repeat(first[rows] - cut[:-1], size) + np.arange(cut[-1])
            f, val = feature[entry], value[entry]
            margin, total = machine.margins(cut, f, val)
            error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y[rows]) / len(rows)
            e = np.repeat(error, size) * val
            used, place = np.unique(f, return_inverse=True)
            d_w = np.bincount(place, e, len(used)) + DECAY * machine.w[used]
            inner = np.repeat(total, size, 0) - machine.v[f] * val[:, None]
            d_v = np.column_stack([np.bincount(place, e * inner[:, j], len(used)) for j in range(RANK)]) + DECAY * machine.v[used]
            g_w[used] += d_w**2
            g_v[used] += d_v**2
            g_b += error.sum() ** 2
            machine.w[used] -= RATE * d_w / np.sqrt(g_w[used])
            machine.v[used] -= 0.3 * RATE * d_v / np.sqrt(g_v[used])
            machine.bias -= RATE * error.sum() / np.sqrt(g_b)
    return machine


def held_out(doc_id: str) -> Column:
    """The fold whose labels are not learned; a null id is in none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _texts(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", stated.alias("stated"))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine fitted on the labelled documents outside the held-out fold, at most FIT_ROWS of them.

    Labels other than 0 and 1 are none; of several labels of an id the least counts; of several rows of an id one."""
    label = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = label.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    rows = _texts(docs).join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", "stated")).alias("t")).select("doc_id", "quality", "t.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in slices(b.column("text"), SLICE_BYTES):
                x = features(texts, b.column("stated").slice(at, len(texts)))
                cut = pa.array(x.first, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(at, len(texts)) for c in ("doc_id", "quality")), pa.array(list(x.statistics), pa.list_(pa.float64())), pa.ListArray.from_arrays(cut, pa.array(x.bucket)), pa.ListArray.from_arrays(cut, pa.array(x.weight))],
                    ["doc_id", "quality", "statistics", "bucket", "weight"],
                )

    # FIT_ROWS rows of at most BUCKETS entries
    t = rows.withColumn("quality", F.col("quality").cast("int")).mapInArrow(run, "doc_id long, quality int, statistics array<double>, bucket array<int>, weight array<float>").toArrow().combine_chunks().sort_by("doc_id")
    flat = lambda c: t.column(c).combine_chunks()
    statistics = flat("statistics").flatten().to_numpy().reshape(len(t), len(STATISTICS))
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(flat("bucket")).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return fit(Features(statistics, first, flat("bucket").flatten().to_numpy(), flat("weight").flatten().to_numpy()), t.column("quality").to_numpy().astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text, n_chars if there is one).

    Null and empty texts have no words and are scored by their statistics; equal texts with equal stated
    lengths get equal scores; null and repeated ids give a row each; a null id is not held out; very long
    texts are scored whole; without labels the score is 0.5; an empty table gives an empty one.  Language,
    source, id and labels are no inputs of a score; other columns are not read."""
    machine = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in slices(b.column("text"), SLICE_BYTES):
                score = machine.score(features(texts, b.column("stated").slice(at, len(texts))))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), b.column("fold").slice(at, len(texts)), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return _texts(docs).withColumn("fold", held_out("doc_id")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
