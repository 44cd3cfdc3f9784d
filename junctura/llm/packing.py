"""Bounded-space online packing of token sequences.

Every document is cut into full windows and one remainder.  A partition keeps at
most ``open_windows`` windows open: a remainder goes to the window where it fits
best; if none has room and no more may be opened, the fullest is emitted.  The
windows left at the end of the partitions are merged, ``merge`` partitions a task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm import storage, word_encoding

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Windows of ``size`` tokens, at most ``limit`` of them open (None: any number)."""

    def __init__(self, size: int, limit: int | None):
        self.size, self.limit = size, limit
        self.free: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list] = {}
        self.made = 0

    def window(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, length: int, piece) -> list | None:
        """Put the piece somewhere; the pieces of a window that had to be emitted."""
        out = None
        k = bisect.bisect_left(self.free, (length, -1))
        if k < len(self.free):
            room, w = self.free.pop(k)
        else:
            if self.limit is not None and len(self.free) >= self.limit:
                out = self.held.pop(self.free.pop(0)[1])
            room, w = self.size, self.window()
            self.held[w] = []
        self.held[w].append((w, self.size - room, piece))
        if room > length:
            bisect.insort(self.free, (room - length, w))
        else:
            full = self.held.pop(w)
            out = full if out is None else out + full
        return out

    def rest(self) -> Iterator[list]:
        yield from self.held.values()


def cut(docs: DataFrame, tokenizer: str, size: int, open_windows: int) -> DataFrame:
    """Encode, cut and pack within each partition; ``part`` is set in windows left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, enc = Packer(size, open_windows), word_encoding.encoder(tokenizer)
        rows: list[tuple] = []

        def emit(pieces: list, left: int | None = None) -> None:
            rows.extend((*piece, (part << 32) | w, at, left) for w, at, piece in pieces)

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"])

        for given in batches:
            for first, texts in word_encoding.slices(given.column("text")):
                ids, sizes = word_encoding.with_end(*enc.encode(texts))
                raw, to = memoryview(ids.astype("<u4").tobytes()), 0
                for doc, n in zip(given.column("doc_id").slice(first, len(texts)).to_pylist(), sizes.tolist()):
                    at = to
                    to += n
                    for start in range(0, n, size):
                        length = min(size, n - start)
                        piece = (doc, start, length, zlib.crc32(raw[4 * (at + start) : 4 * (at + start + length)]), n)
                        if length == size:
                            emit([(packer.window(), 0, piece)])
                        elif done := packer.place(length, piece):
                            emit(done)
                if len(rows) > 20_000:
                    yield batch()
        for left in packer.rest():
            emit(left, part)
        if rows:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, f"{PIECE}, part long")


def merge_left(left: DataFrame, size: int, parts: int) -> DataFrame:
    """Repack the pieces of open windows, those of ``parts`` partitions in one task, largest first.

    A task gets at most ``parts * open_windows * size`` tokens, whatever the input."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "start", "sequence_id", "offset"))])
        packer, base = Packer(size, None), (1 << 61) | (key[0].as_py() << 32)
        place = np.zeros((2, len(rows)), np.int64)
        for i, length in enumerate(rows.column("length").to_pylist()):
            for w, at, k in packer.place(length, i) or ():
                place[:, k] = base | w, at
        for window in packer.rest():
            for w, at, k in window:
                place[:, k] = base | w, at
        return rows.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array(place[0])).append_column("offset", pa.array(place[1]))

    return left.groupBy(F.floor(F.col("part") / parts).cast("long").alias("g")).applyInArrow(run, PIECE)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, open_windows: int = 64, merge: int = 16) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): where it came from and where it lies.

    Null texts are empty: they give the end id alone.  Null, repeated and very large
    ids are kept as they are, each row packed on its own.  Long texts are cut into
    full windows and one remainder.  An empty table gives no rows; other columns are
    not read, whatever their names.  Each sequence is gapless from offset 0 and holds
    ``size`` ids at most."""
    pieces = storage.table(cut(docs, tokenizer, size, open_windows), "packed")
    done = pieces.where("part IS NULL").drop("part")
    return done.unionByName(merge_left(pieces.where("part IS NOT NULL"), size, merge))


def padding(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """sequences, tokens and padding of a packing; a power of two needs no padding."""
    n = F.col("n")
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(size - n)
    return used.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padding"))
