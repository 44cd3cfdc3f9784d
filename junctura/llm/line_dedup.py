"""Reversible line dedup: exact reference counts, and cuckoo filters in front of them.

The exact tables say which documents hold a key (``refs``, signed: +1 inserted, -1
deleted) and, for each key, how many and which is the largest (``counts``).  A
shard's cuckoo filter holds the keys that ``counts`` has in enough documents;
lines are first tried against the filters, only those that may match meet the
exact table.  Deleting documents lowers the counts and takes fingerprints out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from junctura.llm import storage
from junctura.llm.word_encoding import slices

SPACE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIN_CHARS, MIN_DOCS = 40, 5
SLOTS, KICKS = 4, 500
PER_SHARD = 200_000  # hot keys of a filter: 1 MB
MANY = 1_000_000  # documents with one line from which their references stay where they are
MAGIC = b"CKF1"


def key_of(line: str) -> bytes | None:
    """The 128-bit hash of a line's key; None where the key is too short to count."""
    if len(line) < MIN_CHARS:
        return None
    key = line.strip(SPACE)
    if len(key) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(key.translate(LOWER).encode())


class CuckooFilter:
    """Approximate set of 64-bit hashes with deletion: 16-bit fingerprints, SLOTS to a bucket."""

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * SLOTS * 0.9 < max(capacity, 1):
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.size = 0
        self.turn = 0

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        a = hashes & mask
        return mark, a.astype(np.int64), self._other(a.astype(np.int64), mark)

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        mixed = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return at ^ (mixed & np.uint64(len(self.table) - 1)).astype(np.int64)

    def insert(self, hashes: np.ndarray) -> bool:
        """Add the hashes; False if one found no place (the caller rebuilds it larger)."""
        marks, first, second = self._places(hashes)
        for mark, a, b in zip(marks, first.tolist(), second.tolist()):
            for at in (a, b):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = mark
                    break
            else:
                at = a
                for _ in range(KICKS):
                    self.turn = (self.turn + 1) % SLOTS
                    mark, self.table[at, self.turn] = self.table[at, self.turn], mark
                    at = int(self._other(np.array([at]), np.array([mark]))[0])
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = mark
                        break
                else:
                    return False
            self.size += 1
        return True

    def delete(self, hashes: np.ndarray) -> None:
        """Take out hashes that were inserted."""
        for mark, *both in zip(*self._places(hashes)):
            for at in both:
                held = np.flatnonzero(self.table[at] == mark)
                if len(held):
                    self.table[at, held[0]] = 0
                    self.size -= 1
                    break

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hashes)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def to_bytes(self) -> bytes:
        return MAGIC + struct.pack("<QQ", len(self.table), self.size) + self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "CuckooFilter":
        if raw[:4] != MAGIC:
            raise ValueError("not a cuckoo filter")
        buckets, size = struct.unpack_from("<QQ", raw, 4)
        out = cls(1)
        out.table, out.size = np.frombuffer(raw, "<u2", buckets * SLOTS, 20).reshape(buckets, SLOTS).copy(), size
        return out

    @classmethod
    def of(cls, hashes: np.ndarray) -> "CuckooFilter":
        room = len(hashes)
        while True:
            out = cls(room)
            if out.insert(hashes):
                return out
            room = max(2 * room, SLOTS * 2 * len(out.table))


def keys(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id) of every key in every document, each once a row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in slices(batch.column("text"), 8 << 20):
                held, n = [], []
                for text in rows.to_pylist():
                    found = {k for line in (text or "").split("\n") if (k := key_of(line)) is not None}
                    held.extend(found)
                    n.append(len(found))
                h = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
                ids = batch.column("doc_id").slice(first, len(rows)).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), ids], ["h1", "h2", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "h1 long, h2 long, doc_id long")


class LineIndex:
    """The tables and filters of one corpus, below a shared folder.

    A row without an id counts as no document: it is never the one that keeps a
    line.  Rows that share an id are one document.  Insertions and deletions append the
    references of the documents they name and the new states of those documents' keys, and
    rewrite the filters of keys that become hot or cease to be; only where a key loses its
    last document is the next one looked up.  Readers take the last state of each key, and
    :meth:`compact` makes one table of the log.  There is a filter for each PER_SHARD hot
    keys, more as they grow, so none outgrows a task."""

    def __init__(self, spark: SparkSession, folder: str | None = None, shards: int | None = None, min_docs: int = MIN_DOCS):
        self.spark, self.folder = spark, folder or storage.new_folder(spark, "line-index")
        self.shards, self.min_docs, self.version = shards, min_docs, 0
        self.refs: DataFrame | None = None
        self.n_hot = 0
        self.filter_version: dict[int, int] = {}

    def insert(self, docs: DataFrame) -> None:
        """Add documents; those already there are not counted twice."""
        new = keys(docs).where("doc_id IS NOT NULL").distinct()
        if self.refs is not None:
            new = new.join(self._live(docs), ["h1", "h2", "doc_id"], "left_anti")
        self._apply(new.withColumn("sign", F.lit(1)))

    def delete(self, doc_ids: DataFrame) -> None:
        """Take out the documents whose ids are in the column ``doc_id``."""
        if self.refs is not None:
            self._apply(self._live(doc_ids).withColumn("sign", F.lit(-1)))

    def _live(self, of: DataFrame | None = None) -> DataFrame:
        """The references that hold, of all documents or of those whose ids are in ``of``."""
        refs = self.refs if of is None else self.refs.join(of.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
        if self.version == 1:
            return refs.select("h1", "h2", "doc_id")
        return refs.groupBy("h1", "h2", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def _table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def _apply(self, delta: DataFrame) -> None:
        """Append the references of a change and the new state of the keys that it names; nothing else is written."""
        first = self.refs is None
        self.version += 1
        delta = self._table(delta.select("h1", "h2", "doc_id", F.col("sign").cast("int").alias("sign")), f"refs/version={self.version}")
        self._refs_of_folder()
        last = F.max(F.when(F.col("sign") > 0, F.col("doc_id")))
        change = delta.groupBy("h1", "h2").agg(F.sum("sign").alias("more"), last.alias("new_last"), F.max(F.when(F.col("sign") < 0, F.col("doc_id"))).alias("lost"))
        if first:
            many = change.select("h1", "h2", F.col("more").alias("n_docs"), F.col("new_last").alias("last_doc"), F.lit(0).cast("long").alias("old_docs"))
        else:
            both = change.join(self.counts, ["h1", "h2"], "left")
            old = F.coalesce("n_docs", F.lit(0).cast("long"))
            both = both.select("h1", "h2", (old + F.col("more")).alias("n_docs"), F.greatest("last_doc", "new_last").alias("last_doc"), old.alias("old_docs"), F.coalesce(F.col("lost") >= F.col("last_doc"), F.lit(False)).alias("open"))
            if delta.where("sign < 0").isEmpty():
                many = both.drop("open")
            else:
                both = self._table(both, f"open-{self.version}")
                lost = both.where("open AND n_docs > 0").select("h1", "h2")
                found = self.refs.join(lost, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0")
                found = found.groupBy("h1", "h2").agg(F.max("doc_id").alias("found"))
                many = both.join(found, ["h1", "h2"], "left").select("h1", "h2", "n_docs", F.when(F.col("open"), F.col("found")).otherwise(F.col("last_doc")).alias("last_doc"), "old_docs")
        self._filters(self._table(many, f"counts/version={self.version}"))

    def _refs_of_folder(self) -> None:
        self.refs = self.spark.read.schema("h1 long, h2 long, doc_id long, sign int").parquet(f"{self.folder}/refs").drop("version")

    @property
    def counts(self) -> DataFrame:
        """h1, h2, n_docs, last_doc of all keys in any document: of each the state that was written last."""
        log = self.spark.read.schema("h1 long, h2 long, n_docs long, last_doc long, version int").parquet(f"{self.folder}/counts")
        if self.version > 1:
            log = log.groupBy("h1", "h2").agg(F.max(F.struct("version", "n_docs", "last_doc")).alias("s")).select("h1", "h2", "s.n_docs", "s.last_doc")
        return log.where("n_docs > 0").select("h1", "h2", "n_docs", "last_doc")

    def compact(self) -> None:
        """Write the references and states that hold as one version, so that the log of changes starts anew; worth it now and then."""
        live, states = self._live().withColumn("sign", F.lit(1)), self.counts.withColumn("old_docs", F.lit(0).cast("long"))
        old, self.folder = self.folder, storage.new_folder(self.spark, "line-index")
        self._table(live, "refs/version=1")
        changed = self._table(states, "counts/version=1")
        self._refs_of_folder()
        self.version, self.filter_version, self.n_hot = 1, {}, 0
        storage.remove(self.spark, old)
        self._filters(changed)

    def hot(self) -> DataFrame:
        """The keys found in enough documents: h1, h2, n_docs, last_doc."""
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    def _filters(self, changed: DataFrame) -> None:
        """Bring each shard's filter to the keys that are now hot, by insertions and deletions of those that ``changed`` (h1, h2, n_docs, old_docs).

        A filter that is full is made anew from the exact table, and all of them, in
        twice as many shards as are needed, where there are too few."""
        hot, was = F.col("n_docs") >= self.min_docs, F.col("old_docs") >= self.min_docs
        delta = changed.where(hot != was).select("h1", "h2", hot.alias("add"))
        self.n_hot += delta.agg(F.coalesce(F.sum(F.when(F.col("add"), 1).otherwise(-1)), F.lit(0))).first()[0]
        now = self.hot().select("h1", "h2")
        if self.shards is None or self.n_hot > 2 * PER_SHARD * self.shards:
            self.shards, self.filter_version = max(1, 2 * self.n_hot // PER_SHARD), {}
        if not self.filter_version:
            delta = now.withColumn("add", F.lit(True))
        folder, version, known = self.folder, self.version, dict(self.filter_version)

        def numbers(rows: pa.Table) -> np.ndarray:
            return rows.column("h2").to_numpy().astype(np.uint64)

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            add, gone = (numbers(rows.filter(pc.equal(rows.column("add"), x))) for x in (True, False))
            if shard not in known:
                out = CuckooFilter.of(add)
            else:
                # the version is named by the driver: a task that runs again applies a change once
                with storage.open_file(f"{folder}/filter-{shard:05d}.{known[shard]}") as f:
                    out = CuckooFilter.from_bytes(f.read())
                if out.size + len(add) - len(gone) > 0.9 * out.table.size:
                    out = None
                else:
                    out.delete(gone)
                    out = out if out.insert(add) else None
            if out is not None:
                storage.put_bytes(f"{folder}/filter-{shard:05d}.{version}", out.to_bytes())
            return pa.table({"shard": pa.array([shard], pa.int64()), "rebuild": [out is None]})

        def anew(key: tuple, rows: pa.Table) -> pa.Table:
            storage.put_bytes(f"{folder}/filter-{key[0].as_py():05d}.{version}", CuckooFilter.of(numbers(rows)).to_bytes())
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64())})

        shard = F.pmod(F.col("h1"), F.lit(self.shards)).alias("shard")
        changed = self._table(delta.groupBy(shard).applyInArrow(run, "shard long, rebuild boolean"), f"filters-{version}").collect()  # a row a shard
        rebuild = [r.shard for r in changed if r.rebuild]
        if rebuild:
            self._table(now.where(F.pmod("h1", F.lit(self.shards)).isin(rebuild)).groupBy(shard).applyInArrow(anew, "shard long"), f"filters-anew-{version}").count()
        for r in changed:
            self.filter_version[r.shard] = version

    def screened(self, refs: DataFrame) -> DataFrame:
        """The rows of ``refs`` (h1, h2, ...) that a filter may hold."""
        paths = {s: f"{self.folder}/filter-{s:05d}.{v}" for s, v in self.filter_version.items()}
        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, CuckooFilter] = {}
            for batch in batches:
                h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
                at, keep = np.mod(h1, shards), np.zeros(len(h1), bool)
                for s in np.unique(at).tolist():
                    if s in paths:
                        if s not in held:
                            if len(held) >= 64:
                                held.clear()
                            with storage.open_file(paths[s]) as f:
                                held[s] = CuckooFilter.from_bytes(f.read())
                        own = np.flatnonzero(at == s)
                        keep[own] = held[s].contains(h2[own].astype(np.uint64))
                yield batch.filter(pa.array(keep))

        return refs.mapInArrow(run, refs.schema)

    def drops(self) -> DataFrame:
        """doc_id and ``__drops``, the keys that each document of the index loses."""
        hot = self.hot().select("h1", "h2", "last_doc", "n_docs")
        lose = storage.join_heavy(self.screened(self._live()), hot, ["h1", "h2"], F.col("n_docs") >= MANY).where("doc_id <> last_doc")
        return lose.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("__drops"))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """``docs`` (the ones inserted) without the lines they lose; ``__lines`` and ``__dropped`` count them.

        A null text stays null and counts as one empty line.  ``n_chars``, if there, is
        counted anew.  A row without an id loses every hot line."""
        names = docs.columns
        joined = docs.join(self.drops(), "doc_id", "left").select(*names, "__drops")
        nameless = docs.where("doc_id IS NULL")
        if not nameless.isEmpty():
            # such rows are known by their text's hash; equal texts lose the same lines
            by_text = nameless.select(F.xxhash64("text").alias("doc_id"), "text").dropDuplicates(["doc_id"])
            lose = keys(by_text).join(self.hot().select("h1", "h2"), ["h1", "h2"]).groupBy(F.col("doc_id").alias("__text")).agg(F.collect_list(F.struct("h1", "h2")).alias("__drops"))
            own = nameless.join(lose, F.xxhash64("text") == F.col("__text"), "left").select(*names, "__drops")
            joined = joined.where("doc_id IS NOT NULL").unionByName(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, _ in slices(batch.column("text"), 8 << 20):
                    part = batch.slice(first, len(_))
                    texts, lines, dropped = [], [], []
                    for text, gone in zip(part.column("text").to_pylist(), part.column("__drops").to_pylist()):
                        all_lines = (text or "").split("\n")
                        lines.append(len(all_lines))
                        if gone:
                            lost = {struct.pack("<qq", g["h1"], g["h2"]) for g in gone}
                            kept = [x for x in all_lines if key_of(x) not in lost]
                            dropped.append(len(all_lines) - len(kept))
                            texts.append("\n".join(kept))
                        else:
                            dropped.append(0)
                            texts.append(text)
                    cols = {n: part.column(n) for n in names} | {"text": pa.array(texts, part.schema.field("text").type)}
                    if "n_chars" in names:
                        cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], part.schema.field("n_chars").type)
                    yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "__lines", "__dropped"])

        schema = T.StructType(docs.schema.fields + [T.StructField("__lines", T.LongType()), T.StructField("__dropped", T.LongType())])
        return joined.mapInArrow(run, schema)


def _index(docs: DataFrame) -> LineIndex:
    index = LineIndex(docs.sparkSession)
    index.insert(docs)
    return index


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row of ``docs`` (doc_id, text).

    A null or empty text is one empty line.  Rows that share an id are one document, a
    row without one loses every hot line.  Of equal lines in the document that keeps
    them all stay.  Texts are read whole; an empty table gives no rows; other columns
    are not read, whatever their names."""
    docs = docs.select("doc_id", "text")
    out = _index(docs).dedup(docs)
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def deduped(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines dropped, as :func:`line_dedup` counts them, and ``n_chars`` (if there) counted anew; other columns pass as they are, whatever their names and types."""
    own = ("doc_id", "text", "n_chars")
    held = storage.narrowed(docs, *own)
    return storage.widened(_index(held).dedup(held), docs.columns, *own)
