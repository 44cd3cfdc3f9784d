"""Similarity join on word n-grams: MinHash values compared step by step, pruned by
their posterior, and the survivors verified exactly.

1. Texts with the same set of n-grams form one node, so copies are joined once.
2. Nodes that agree in a band of the signature are candidates.  A bucket of more
   than ``TILE`` nodes is dealt out as pairs of tiles; no pair of nodes is a row.
3. Within a tile pair, signatures are compared ``STEP`` values at a time.  Under a
   uniform prior, m matches of n give P(J >= t) = P(Bin(n + 1, t) <= m); a pair is
   dropped when that falls below ``TOLERANCE``.  A pair belongs to the first band in
   which it agrees, so it is looked at in one bucket only.
4. The n-gram sets of nodes with surviving pairs meet in the same tile pairs, where
   the exact coefficient decides; degrees and a spanning forest leave the task.

With 20 bands of 3 values a pair at the threshold 0.8 is missed with probability
6e-7, and the posterior drops it with about as many 1e-8 as there are steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm import storage
from junctura.llm.word_encoding import slices

WORDS, THRESHOLD = 5, 0.8
BANDS, WIDTH, VALUES, STEP = 20, 3, 64, 8
TOLERANCE = 1e-8
TILE = 512
PAIRS_AT_ONCE = 1 << 17
MAX_IDS = 1_000_000  # narrow rows that may be broadcast: about 50 MB as a hash table of one long key
SALTS = 64
MANY = 1_000_000  # rows of one node from which they stay where they are in joins
_rng = np.random.default_rng(20240229)
MULT = _rng.integers(1 << 62, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
MASK = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
PLACE = _rng.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ngram_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct n-gram hashes; fewer than n words are one n-gram, none give none.

    Words are separated by ASCII white space and compared without case."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    at = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    words = pc.dictionary_encode(split.flatten())
    table = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in words.dictionary), np.uint64, len(words.dictionary))
    h = table[words.indices.to_numpy()] if len(table) else np.zeros(0, np.uint64)
    # split_whitespace gives empty words at the ends of a text: they are no words
    empty = np.uint64(xxhash.xxh64_intdigest(b""))
    if len(h) and (h == empty).any():
        keep = h != empty
        at = np.concatenate([[0], np.cumsum(keep)])[at]
        h = h[keep]
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        grams += h[k : k + len(grams)] * PLACE[k]
    grams = _mix(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(_mix((h[a:b] * PLACE[32 : 32 + b - a]).sum(keepdims=True, dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The lowest 32-bit value of each hash function over each set, its low 16 bits; zeros for an empty set."""
    out = np.zeros((len(sets), VALUES), np.uint16)
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    group = np.cumsum(size[full]) // (1 << 15)
    for g in np.unique(group):
        rows = full[group == g]
        joined = np.concatenate([sets[r] for r in rows])
        start = np.cumsum(size[rows]) - size[rows]
        for k in range(VALUES):
            out[rows, k] = np.minimum.reduceat(((joined ^ MASK[k]) * MULT[k]) >> np.uint64(32), start).astype(np.uint16)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), node (null without words), grams and sig of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in slices(batch.column("text"), 4 << 20):
                sets = ngram_sets(rows)
                node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sig = [s.tobytes() for s in signatures(sets)]
                part = batch.slice(first, len(rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(node, pa.binary()), pa.array(list(map(len, sets)), pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "h", "node", "grams", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, node binary, grams long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def band_keys(nodes: DataFrame) -> DataFrame:
    """key, band and node: each of ``nodes`` (node, sig) once for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("sig"))[:, : BANDS * WIDTH].reshape(-1, BANDS, WIDTH).astype(np.uint64)
            key = np.full(v.shape[:2], 0, np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for k in range(WIDTH):
                key = _mix(key + (v[:, :, k] + np.uint64(1)) * PLACE[k])
            rows = pa.array(np.repeat(np.arange(len(v)), BANDS))
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(v))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(band), batch.column("node").take(rows)], ["key", "band", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, band int, node binary").withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS)))


def in_shared_buckets(nodes: DataFrame) -> DataFrame:
    """The rows of :func:`band_keys` whose bucket has more than one node, with the number ``k`` of its nodes.

    Signatures stay behind, and a bucket's nodes are counted and met in SALTS parts, so
    a bucket with very many is no one task's."""
    bands = band_keys(nodes)
    count = bands.withColumn("bit", F.expr("shiftleft(1L, salt)")).groupBy("key").agg(F.count("*").alias("k"), F.bit_or("bit").alias("bits")).where("k > 1")
    parts = F.expr(f"filter(sequence(0, {SALTS - 1}), i -> (shiftrightunsigned(bits, i) & 1L) = 1L)")
    return bands.join(count.select("key", "k", F.explode(parts).alias("salt")), ["key", "salt"]).select("key", "band", "node", "k")


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ...: the fewest matches with which a pair stays."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survivors(sig: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows that are not pruned and first agree in their bucket's band."""
    same = np.zeros(len(i), np.int32)
    for k, m in enumerate(least):
        cols = slice(k * STEP, (k + 1) * STEP)
        same = same + (sig[i, cols] == sig[j, cols]).sum(1, dtype=np.int32)
        keep = same >= m
        i, j, same = i[keep], j[keep], same[keep]
    agree = (sig[i, : BANDS * WIDTH] == sig[j, : BANDS * WIDTH]).reshape(-1, BANDS, WIDTH).all(2)
    keep = agree.argmax(1) == band[i]
    return i[keep], j[keep]


def group_pairs(start: int, side: np.ndarray, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one group, at most about PAIRS_AT_ONCE at a time."""
    if cross:
        left, right = start + np.flatnonzero(side == 0), start + np.flatnonzero(side == 1)
        step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
        for a in range(0, len(left), step):
            some = left[a : a + step]
            yield np.repeat(some, len(right)), np.tile(right, len(some))
        return
    n = len(side)
    step = max(1, PAIRS_AT_ONCE // max(1, n))
    for a in range(0, n - 1, step):
        rows = np.arange(a, min(a + step, n - 1))
        count = n - 1 - rows
        i = np.repeat(rows, count)
        j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + i + 1
        yield start + i, start + j


def _groups(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Call ``work`` with tables of whole groups (rows sorted by key, t1, t2) and the groups' borders."""
    rest: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        border = _borders(table)
        last = int(border[-2])
        if last:
            yield from work(table.slice(0, last).combine_chunks(), border[:-1])
        rest = table.slice(last)
    if rest is not None and len(rest):
        yield from work(rest.combine_chunks(), np.array([0, len(rest)]))


def _borders(table: pa.Table) -> np.ndarray:
    key, t1, t2 = (table.column(c).to_numpy() for c in ("key", "t1", "t2"))
    new = (key[1:] != key[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(table)]])


def _pairs(table: pa.Table, border: np.ndarray, least: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving row pairs of a table of whole groups; a group's pairs are never split from each other by another's."""
    sig, band, side = _matrix(table.column("sig").combine_chunks()), table.column("band").to_numpy(), table.column("side").to_numpy()
    cross = table.column("t1").to_numpy()[border[:-1]] != table.column("t2").to_numpy()[border[:-1]]
    held: list[tuple] = []
    total = 0
    for start, stop, x in zip(border[:-1].tolist(), border[1:].tolist(), cross.tolist()):
        if stop - start == 2 and not x:
            held.append((np.array([start]), np.array([start + 1])))
            total += 1
        else:
            for pair in group_pairs(start, side[start:stop], x):
                held.append(pair)
                total += len(pair[0])
                if total >= PAIRS_AT_ONCE:
                    yield survivors(sig, band, *(np.concatenate(p) for p in zip(*held)), least)
                    held, total = [], 0
    if held:
        yield survivors(sig, band, *(np.concatenate(p) for p in zip(*held)), least)


def candidates(tiled: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """The rows (key, t1, t2, band, side, node) that have a surviving pair in their tile pair."""
    least = least_matches(threshold, tolerance)

    def work(table: pa.Table, border: np.ndarray) -> Iterator[pa.RecordBatch]:
        used = np.zeros(len(table), bool)
        for i, j in _pairs(table, border, least):
            used[i] = used[j] = True
        yield from table.select(["key", "t1", "t2", "band", "side", "node"]).filter(pa.array(used)).to_batches()

    return tiled.mapInArrow(lambda b: _groups(b, work), "key long, t1 int, t2 int, band int, side int, node binary")


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many hashes each pair of sets shares."""
    if len(i) <= 3 * len(sets):
        return np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())), np.int64, len(i))
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    row, col = row[keep], number[code[keep]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(shared.sum()), 4096):
        own = (col >= a) & (col < a + 4096)
        block = np.zeros((len(sets), 4096), np.float32)
        block[row[own], col[own] - a] = 1
        both += block @ block.T
    return both[i, j].astype(np.int64)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest: (smallest row, row) of each row's component in the given pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, low)
        np.minimum.at(now, j, low)
        now = now[now]
        if (now == label).all():
            return [(int(a), b) for b, a in enumerate(label.tolist()) if a != b]
        label = now


def verified(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """From tile pairs with n-gram sets: (node, degree) and (node, other) rows of the exact links."""
    least = least_matches(threshold, tolerance)

    def work(table: pa.Table, border: np.ndarray) -> Iterator[pa.RecordBatch]:
        node = table.column("node").to_pylist()
        raw = table.column("grams").combine_chunks()
        degree = np.zeros(len(node), np.int64)
        edges: list[tuple[int, int]] = []
        group = np.repeat(np.arange(len(border) - 1), np.diff(border))
        found = list(_pairs(table, border, least))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(group[i], kind="stable")
        i, j = i[order], j[order]
        own, first = np.unique(group[i], return_index=True)
        for g, a, b in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(i)]):
            start, stop = int(border[g]), int(border[g + 1])
            sets = [np.frombuffer(raw[k].as_buffer(), np.uint64) for k in range(start, stop)]
            x, y = i[a:b] - start, j[a:b] - start
            size = np.array([len(s) for s in sets])
            common = _common(sets, x, y)
            link = common >= threshold * (size[x] + size[y] - common) - 1e-9
            x, y = x[link], y[link]
            np.add.at(degree, start + x, 1)
            np.add.at(degree, start + y, 1)
            edges += [(start + u, start + v) for u, v in _forest(stop - start, x, y)]
        rows = np.flatnonzero(degree).tolist()
        u = [node[k] for k in rows] + [node[a] for a, _ in edges]
        v = [None] * len(rows) + [node[b] for _, b in edges]
        d = [int(degree[k]) for k in rows] + [0] * len(edges)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(d, pa.int64())], ["node", "other", "degree"])

    return rows.mapInArrow(lambda b: _groups(b, work), "node binary, other binary, degree long")


def gram_rows(docs: DataFrame) -> DataFrame:
    """node and its n-gram set, for each row of ``docs`` that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in slices(batch.column("text"), 4 << 20):
                raw = [s.tobytes() for s in ngram_sets(rows) if len(s)]
                node = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(raw, pa.binary())], ["node", "grams"])

    return docs.select("text").mapInArrow(run, "node binary, grams binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the connected components: hooking to the smallest neighbour, then pointer jumping.

    Each round writes its labels to the shared folder and drops those before, so neither
    lineage nor disk grows."""
    both = storage.table(edges.unionAll(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = storage.table(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("low"))
        hooked = storage.table(labels.select("node", "label").join(near, "node").select("node", F.least("label", "low").alias("label"), F.col("label").alias("old")), "labels")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        now = storage.table(hooked.join(jump, "label").select("node", F.col("next").alias("label"), "old"), "labels")
        storage.drop(labels, hooked)
        if now.where("label <> old").isEmpty():
            storage.drop(both)
            return now
        labels = now


def _tiles(rows: DataFrame, tile: int) -> DataFrame:
    """Deal the rows of each key (with its number ``k``) out to pairs of tiles t1 <= t2."""
    n = F.ceil(F.col("k") / tile).cast("int")
    own = F.pmod(F.hash("node"), F.col("tiles"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    out = rows.withColumn("tiles", n).withColumn("own", own).withColumn("v", other)
    low, high = F.least("own", "v").alias("t1"), F.greatest("own", "v").alias("t2")
    side = F.when(F.col("own") <= F.col("v"), 0).otherwise(1).alias("side")
    return out.select("key", low, high, "band", side, "node", "sig")


def links(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, h, node; nodes: node, class_id, n_links, n_copies, label of the component), two tables."""
    rows = storage.table(signed(docs), "signatures")
    some = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"))
    nodes = storage.table(some, "nodes")
    narrow = nodes.select("node", "sig")
    tiled = _tiles(in_shared_buckets(narrow).join(narrow, "node"), tile)
    by = ["key", "t1", "t2"]
    dealt = lambda df: df.repartition(*by).sortWithinPartitions(*by)
    need = storage.table(candidates(dealt(tiled), threshold, tolerance), "candidates")
    chosen = storage.table(nodes.join(need.select("node").distinct(), "node", "left_semi").select("doc").distinct(), "chosen")
    few = storage.checked_broadcast(chosen.where("doc IS NOT NULL").withColumnRenamed("doc", "doc_id"), MAX_IDS)  # else texts are shuffled to meet them
    wanted = docs.select("doc_id", "text").join(few, "doc_id", "left_semi")
    if not chosen.where("doc IS NULL").isEmpty():
        wanted = wanted.unionByName(docs.select("doc_id", "text").where("doc_id IS NULL"))
    grams = gram_rows(wanted).groupBy("node").agg(F.first("grams").alias("grams"))
    full = need.join(grams, "node").join(narrow, "node").select(*by, "band", "side", "node", "sig", "grams")
    exact = storage.table(verified(dealt(full), threshold, tolerance), "verified")
    storage.drop(need, chosen)
    degree = exact.groupBy("node").agg(F.sum("degree").alias("n_links"))
    label = components(exact.where("other IS NOT NULL").select("node", "other"))
    named = nodes.select("node", "doc", "n_copies").join(label.select("node", "label"), "node", "left").join(degree, "node", "left")
    named = storage.table(named.select("node", "doc", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies", F.coalesce("label", "node").alias("label")), "named")
    storage.drop(nodes, exact, label)
    lowest = named.groupBy("label").agg(F.min("doc").alias("class_id"), F.count("*").alias("of_class"))
    out = storage.join_heavy(named.drop("doc"), lowest, ["label"], F.col("of_class") >= MANY)
    return rows.select("doc_id", "h", "node"), out.select("node", "class_id", "n_links", "n_copies", "label")


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest id of the row's connected component, ``n_links`` the
    number of different texts (by n-gram set) with a coefficient of at least
    ``threshold``, ``n_copies`` the rows with the same n-gram set, itself included.  A
    null or empty text, or one without words, has no links and its own id as class.
    Rows without an id and repeated rows are joined like others; a component of rows
    without ids alone has a null class.  Texts are read whole; an empty table gives no
    rows; other columns of ``docs`` are not read, whatever their names."""
    rows, nodes = links(docs, threshold)
    wordy = storage.join_heavy(rows.where("node IS NOT NULL"), nodes, ["node"], F.col("n_copies") >= MANY)
    none = rows.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return wordy.select("doc_id", "class_id", "n_links", "n_copies").unionByName(none)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of near copies: that with the smallest id, of those the one with the smallest hash of its text.

    Rows are told apart by id and text, so unrelated texts with one id all stay.  Rows
    without an id come last in their class.  Of rows that are equal in both, the first by
    all their columns stays.  Rows without words are in no class and all stay.  Other
    columns pass as they are, whatever their names and types."""
    given, docs = docs, storage.narrowed(docs, "doc_id", "text")
    back = lambda df: storage.widened(df, given.columns, "doc_id", "text")
    rows, nodes = links(docs, threshold)
    wordy = storage.join_heavy(rows.where("node IS NOT NULL"), nodes.select("node", "label", "n_copies"), ["node"], F.col("n_copies") >= MANY)
    known = storage.table(wordy.select("label", "doc_id", "h"), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"))).alias("first")
    heads = known.groupBy("label").agg(first, F.count("*").alias("of_class")).where("of_class > 1")
    several = storage.table(storage.join_heavy(known, heads, ["label"], F.col("of_class") >= MANY).select("doc_id", "h", (F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))).alias("stays")), "several")
    gone = several.where("NOT stays").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    twice = storage.table(several.where("stays").groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
    same = lambda right: (F.xxhash64(docs["text"]) == right["__h"]) & docs["doc_id"].eqNullSafe(right["__id"])
    gone = storage.table(gone.unionByName(twice), "gone")
    few = storage.checked_broadcast(gone, MAX_IDS)  # else texts are shuffled to meet them
    out = docs.join(few, same(few), "left_anti")
    if twice.isEmpty():
        return back(out)
    names = docs.columns
    repeated = docs.join(twice, same(twice), "left_semi")
    each = repeated.groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__h")).agg(F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("row"))
    return back(out.unionByName(each.select(*[F.col("row")[n].alias(n) for n in names])))
