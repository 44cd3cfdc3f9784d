"""Exact hard-negative mining with k-means inverted lists.

Vectors are integers; a score is their inner product.  Every list of the index has a
centroid c and the radius r of its members, so by Cauchy and Schwarz the scores of a
query q with them lie within q·c ± |q| r.  A search visits the lists by their upper
bounds, leaves out those whose interval misses the wanted scores, and is over with a
list once its upper bound is strictly below the k-th score found (a tie may still win
by its id).  The centroids only set how much is skipped, never what is found.

Of rows with equal vector and label only the first ``k`` by id can be among the first
``k`` of any search, so a list holds no more of them; Spark applies that limit before
its shuffle, whatever part of the table they are.  Lists are files in the shared folder,
in parts of bounded size; tasks hold blocks of anchors that lie together and read lists
as they visit them.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.llm import storage

SAMPLE = 16_384  # rows that the centroids are fitted on, the first by a hash
MAX_LISTS = 1024
ROUNDS = 8
PART_ROWS = 16_384
ANCHORS = 256  # searched together
MAX_TASKS = 20_000
CHUNK_ROWS = 4096
CACHE_BYTES = 64 << 20

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_cache: OrderedDict[str, list] = OrderedDict()


def vectors(df: DataFrame, vec_id: str, label: Column, embedding: str, scale: int) -> DataFrame:
    """uid, vec_id, label, q (floor of scale times each component) of the rows that take part."""
    x = F.col(embedding)
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    usable = ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = df.where(label.isNotNull() & x.isNotNull()).where(usable)
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("q"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(at)
    flat = column.values.to_numpy()[at[0] : at[-1]]
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = flat
    return out


def fit(sample: np.ndarray, k: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from the sample's first different rows."""
    first = np.sort(np.unique(sample, axis=0, return_index=True)[1])[:k]
    centroids = sample[first].astype(np.float64)
    for _ in range(ROUNDS if len(centroids) else 0):
        own = nearest(sample, centroids)[0]
        n = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
    return centroids


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance to it."""
    q = q.astype(np.float64)
    own = np.concatenate([np.argmin((centroids**2).sum(1) - 2 * q[i : i + CHUNK_ROWS] @ centroids.T, axis=1) for i in range(0, len(q), CHUNK_ROWS)] or [np.zeros(0, np.int64)])
    return own, np.sqrt(((q - centroids[own]) ** 2).sum(1))


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows of :func:`vectors` with the list of their nearest centroid and their distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, far = nearest(matrix(b.column("q"), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(far, pa.float64())], [*b.schema.names, "list", "far"])

    return rows.mapInArrow(run, "uid long, vec_id long, label long, q array<long>, list int, far double")


@dataclass(frozen=True)
class Index:
    """What every search needs of the lists; all of it is bounded by MAX_LISTS."""

    folder: str
    centroids: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    exact: type  # the number type in which all scores are exact

    def chunks(self, i: int) -> Iterator[tuple[np.ndarray, ...]]:
        """uid, vec_id, is-null, label and q of a list, in chunks."""
        for part in range(int(self.parts[i])):
            name = f"{self.folder}/{i}-{part}.npz"
            if name not in _cache:
                with storage.open_file(name) as f, np.load(io.BytesIO(f.read())) as z:
                    arrays = [z[x] for x in ("uid", "vec_id", "null", "label", "q")]
                _cache[name] = [*arrays[:4], arrays[4].astype(self.exact)]
                while len(_cache) > 1 and sum(x.nbytes for y in _cache.values() for x in y) > CACHE_BYTES:
                    _cache.popitem(last=False)
            _cache.move_to_end(name)
            arrays = _cache[name]
            for at in range(0, len(arrays[0]), CHUNK_ROWS):
                yield tuple(x[at : at + CHUNK_ROWS] for x in arrays)


def build(rows: DataFrame, keep: int) -> Index | None:
    """The index of all rows of a written table of :func:`vectors`; ``keep`` rows of equal vector and label are listed.  None for an empty table."""
    spark = rows.sparkSession
    top = F.array_max(F.transform("q", lambda v: F.abs(v.cast("double"))))
    n, width, largest = rows.agg(F.count("*"), F.max(F.size("q")), F.max(top)).first()
    if not n:
        return None
    width, bound = max(1, width), max(1, width) * (largest or 0.0) ** 2
    if bound >= 2**62:
        raise ValueError("the scores do not fit a long")
    sample = rows.select("q").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).toArrow().column("q")
    centroids = fit(matrix(sample, width), max(1, min(MAX_LISTS, round(n**0.5))))

    order = Window.partitionBy("q", "label").orderBy(F.col("vec_id").asc_nulls_last(), "uid")
    first = rows.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= keep).drop("copy")
    listed = storage.table(assigned(first, centroids), "negatives-rows")
    radius, parts = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in listed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # MAX_LISTS rows at most
        radius[r["list"]], parts[r["list"]] = r["far"], -(-r["n"] // PART_ROWS)
    folder = storage.new_folder(spark, "negatives-lists")
    small = np.int32 if largest is None or largest < 2**31 else np.int64

    def write(key: tuple, _: pa.Table, t: pa.Table) -> pa.Table:
        out, ids = io.BytesIO(), t.column("vec_id")
        np.savez(out, uid=t.column("uid").to_numpy(), vec_id=ids.fill_null(0).to_numpy(), null=ids.is_null().to_numpy(), label=t.column("label").to_numpy(), q=matrix(t.column("q"), width).astype(small))
        storage.put_bytes(f"{folder}/{key[0].as_py()}-{key[1].as_py()}.npz", out.getvalue())
        return pa.table({"n": pa.array([len(t)], pa.int64())})

    sizes = spark.createDataFrame([(i, int(p)) for i, p in enumerate(parts)], "list int, parts long")
    keys = sizes.select("list", F.explode(F.expr("sequence(0L, greatest(parts, 1L) - 1)")).alias("part"))
    dealt = listed.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))
    keys.groupBy("list", "part").cogroup(dealt.groupBy("list", "part")).applyInArrow(write, "n long").agg(F.sum("n")).collect()
    storage.drop(listed)
    return Index(folder, centroids, radius, parts, np.float64 if bound < 2**53 else np.int64)


class Search:
    """The best rows of a block of queries, each within one or more windows of scores."""

    def __init__(self, index: Index, q: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.index, self.q, self.label, self.k, self.same = index, q.astype(index.exact), label, k, same
        self.low, self.high = low.astype(index.exact), high.astype(index.exact)  # a window's bounds; raised to the k-th score
        self.best = [[None] * low.shape[1] for _ in range(len(q))]
        self.n_visits = 0

    def run(self) -> list[list]:
        """For each query and window (score, vec_id, is-null, uid) of at most k rows, the best first."""
        centre = self.q.astype(np.float64) @ self.index.centroids.T
        norm = np.sqrt((self.q.astype(np.float64) ** 2).sum(1))
        reach = norm[:, None] * self.index.radius
        slack = 1e-9 * (norm[:, None] * (np.sqrt((self.index.centroids**2).sum(1)) + self.index.radius)) + 1e-6  # more than the sums' rounding
        upper, lower = centre + reach + slack, centre - reach - slack
        upper[:, self.index.parts == 0] = -np.inf
        todo = upper > -np.inf
        if not todo.any():
            return self.best
        # each query begins with its own best list; then those of the block by their greatest bound
        own = upper.argmax(1)
        for i in np.unique(own):
            self._visit(int(i), (own == i) & self._open(upper[:, i], lower[:, i]))
        todo[np.arange(len(own)), own] = False
        for i in np.argsort(-upper.max(0), kind="stable"):
            self._visit(int(i), todo[:, i] & self._open(upper[:, i], lower[:, i]))
        return self.best

    def _open(self, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Queries for which a list may still hold a row: a bound equal to the k-th score is not below it."""
        return ((upper[:, None] >= self.low) & (lower[:, None] <= self.high)).any(1)

    def _visit(self, i: int, who: np.ndarray) -> None:
        rows = np.flatnonzero(who)
        if not len(rows):
            return
        self.n_visits += len(rows)
        for uid, vec_id, null, label, q in self.index.chunks(i):
            scores = self.q[rows] @ q.T
            fits = (self.label[rows, None] == label) == self.same
            for j in range(self.low.shape[1]):
                found = fits & (scores >= self.low[rows, j, None]) & (scores <= self.high[rows, j, None])
                for a in np.flatnonzero(found.any(1)):
                    x = np.flatnonzero(found[a])
                    new = scores[a, x], vec_id[x], null[x], uid[x]
                    old = self.best[rows[a]][j]
                    both = new if old is None else tuple(map(np.concatenate, zip(old, new)))
                    order = np.lexsort((both[3], both[1], both[2], -both[0]))[: self.k]
                    self.best[rows[a]][j] = both = tuple(y[order] for y in both)
                    if len(order) == self.k:
                        self.low[rows[a], j] = max(self.low[rows[a], j], both[0][-1])


def mine_block(index: Index, anchors: tuple[np.ndarray, ...], n_positives: int, n_negatives: int, window: tuple[int, int]) -> dict[str, list]:
    """The result rows of a block of anchors (uid, vec_id, label, q).  Equal vectors of one label are searched once."""
    uid, vec_id, label, q = anchors
    _, first, group = np.unique(np.column_stack([label, q]), axis=0, return_index=True, return_inverse=True)
    uq, ul, group = q[first], label[first], group.ravel()
    lowest, highest = (-(2**53), 2**53) if index.exact is np.float64 else (-(2**62), 2**62)
    whole = np.full((len(uq), 1), lowest), np.full((len(uq), 1), highest)
    near = [b[0] for b in Search(index, uq, ul, *whole, n_positives + 1, True).run()]  # the anchor itself may be among them
    low, high = np.full((len(uq), n_positives + 1), highest), np.full((len(uq), n_positives + 1), lowest)
    for i, b in enumerate(near):
        for j, p in enumerate(b[0].tolist() if b else []):
            low[i, j], high[i, j] = -((-window[0] * int(p)) // 100), window[1] * int(p) // 100
    far = Search(index, uq, ul, low, high, n_negatives, False).run()
    out = {c.split()[0]: [] for c in RESULT.split(", ")}
    for a, g in enumerate(group.tolist()):
        if near[g] is None:
            continue
        others = [j for j in range(len(near[g][0])) if near[g][3][j] != uid[a]][:n_positives]
        for j in others:
            score, ids, null, _ = far[g][j] or ([], [], [], [])
            for rank, (s, i, none) in enumerate(zip(score, ids, null), 1):
                positive = None if near[g][2][j] else int(near[g][1][j])
                for c, x in zip(out, (int(vec_id[a]), positive, rank, None if none else int(i), int(near[g][0][j]), int(s))):
                    out[c].append(x)
    return out


def mine(df: DataFrame, is_anchor: Column, label: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256, n_positives: int = 5, n_negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """For each anchor and each of its positives the best negatives whose score is within a window, in per cent of the positive's.

    A row without a label or vector, or with a null or non-finite component, takes no part.  Positives are
    the first ``n_positives`` other rows of the anchor's label; negatives have another label.  Order: the
    greater score, then the smaller id, null ids last.  Repeated rows and ids are rows of their own; equal
    rows give equal result rows.  Shorter vectors count as filled up with zeros; vectors whose scores may
    not fit a long are an error.  Other columns are not read.  ``label`` is an expression
    over ``df``, ``is_anchor`` one over ``vec_id`` and ``label`` of the rows that take part; an anchor has an id;
    an empty table gives an empty one."""
    label = F.col("label") if label is None else label
    spark = df.sparkSession
    rows = storage.table(vectors(df, vec_id, label, embedding, scale), "negatives-vectors")
    index = build(rows, max(n_positives + 1, n_negatives))
    if index is None:
        return spark.createDataFrame([], RESULT)
    schema = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in (c.split() for c in RESULT.split(", "))])
    width = index.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), ANCHORS):
                part = b.slice(at, ANCHORS)
                found = mine_block(index, (*(part.column(c).to_numpy() for c in ("uid", "vec_id", "label")), matrix(part.column("q"), width)), n_positives, n_negatives, window)
                yield pa.RecordBatch.from_pydict(found, schema)

    anchors = rows.where(is_anchor & F.col("vec_id").isNotNull())
    tasks = max(1, min(MAX_TASKS, -(-anchors.count() // ANCHORS)))
    # anchors of one list visit the same others; equal ones stand side by side
    return assigned(anchors, index.centroids).repartitionByRange(tasks, "list", F.xxhash64("q"), "uid").sortWithinPartitions("list", F.xxhash64("q")).mapInArrow(run, RESULT)
