"""Token ids as one wavelet matrix per shard.

A shard file holds consecutive documents' ids as a Huffman-shaped wavelet
matrix: bit-planes in compressed blocks, a rank directory, and the symbols that
end on each level.  Access, counting and occurrence lookup read only the blocks
they touch; :func:`decode` restores all ids.

Layout, little-endian: ``MAGIC``, uint32 length of the header, header (JSON,
zstd), body.  The header names each section's place in the body.
"""

from __future__ import annotations

import heapq
import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm import storage, word_encoding

MAGIC = b"WVMX1\0\0\0"
BLOCK_BITS = 1 << 16
SHARD_TOKENS = 8 << 20


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code length of each symbol; one symbol alone gets length 1."""
    if len(counts) == 1:
        return np.ones(1, np.int64)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, node = {}, len(counts)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = node
        heapq.heappush(heap, (a + b, node))
        node += 1
    depth = np.zeros(node, np.int64)
    for i in range(node - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return depth[: len(counts)]


def assign_codes(lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Codes whose leaves close each level's order, and the leaves of each level in that order.

    Bit ``l`` of a code is what level ``l`` stores.  After a level, nodes stand in
    the order zeros then ones; the last ones become the leaves, so elements that
    are finished form the tail and the others keep their positions.
    """
    codes, leaves, nodes = np.zeros(len(lengths), np.uint64), [], [0]
    for level in range(int(lengths.max())):
        nodes = nodes + [p | (1 << level) for p in nodes]
        ending = np.flatnonzero(lengths == level + 1)
        keep = len(nodes) - len(ending)
        codes[ending] = np.array(nodes[keep:], np.uint64) if len(ending) else codes[ending]
        leaves.append(ending)
        nodes = nodes[:keep]
    return codes, leaves


def encode_shard(ids: np.ndarray, doc_ids: np.ndarray, null_id: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bytes of a shard file for the documents' ids, one after another."""
    pack = zstandard.ZstdCompressor(level=1)
    body, at, where = [], 0, {}

    def add(name: str, raw: bytes) -> None:
        nonlocal at
        where[name] = [at, len(raw)]
        body.append(raw)
        at += len(raw)

    add("doc_ids", pack.compress(np.ascontiguousarray(doc_ids, "<i8").tobytes()))
    add("null_id", pack.compress(np.packbits(null_id).tobytes()))
    add("sizes", pack.compress(np.ascontiguousarray(sizes, "<i8").tobytes()))
    levels: list[list[int]] = []
    if len(ids):
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        lengths = code_lengths(counts[symbols])
        codes, leaves = assign_codes(lengths)
        if int(lengths.max()) > 62:
            raise ValueError("a code is longer than 62 bits")
        kind = np.uint32 if int(lengths.max()) <= 32 else np.uint64
        of = np.zeros(len(counts), kind)
        of[symbols] = codes.astype(kind)
        now = of[ids]
        add("symbols", pack.compress(symbols.astype("<u4").tobytes()))
        add("counts", pack.compress(counts[symbols].astype("<i8").tobytes()))
        for level, ending in enumerate(leaves):
            bits = (now & kind(1 << level)) != 0
            one = np.flatnonzero(bits)
            packed = np.packbits(bits)
            blocks, starts, size = [], [0], BLOCK_BITS // 8
            for i in range(0, len(packed), size):
                raw = packed[i : i + size].tobytes()
                small = pack.compress(raw)
                blocks.append(b"\1" + small if len(small) < len(raw) else b"\0" + raw)
                starts.append(starts[-1] + len(blocks[-1]))
            before = np.searchsorted(one, np.arange(0, len(bits), BLOCK_BITS))
            add(f"ranks{level}", pack.compress(np.concatenate([before, [len(one)]]).astype("<i8").tobytes()))
            add(f"blocks{level}", pack.compress(np.array(starts, "<i8").tobytes()))
            add(f"plane{level}", b"".join(blocks))
            done = int(counts[symbols[ending]].sum())
            levels.append([len(bits), len(bits) - len(one), done])
            now = np.concatenate([now.take(np.flatnonzero(~bits)), now.take(one)])
            now = now[: len(now) - done]
    head = pack.compress(json.dumps({"n": len(ids), "docs": len(sizes), "levels": levels, "where": where}).encode())
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])


class Shard:
    """Random access to one shard file; blocks are read when needed."""

    def __init__(self, file, cached_blocks: int = 256):
        self.file, self.unpack = file, zstandard.ZstdDecompressor()
        head = file.read(len(MAGIC) + 4)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack("<I", head[len(MAGIC) :])[0]
        self.head = json.loads(self.unpack.decompress(file.read(size)))
        self.start = len(head) + size
        self.n, self.levels = self.head["n"], self.head["levels"]
        self.doc_ids = np.frombuffer(self._section("doc_ids"), "<i8")
        self.null_id = np.unpackbits(np.frombuffer(self._section("null_id"), np.uint8), count=self.head["docs"]).astype(bool)
        self.sizes = np.frombuffer(self._section("sizes"), "<i8")
        self.symbols = np.frombuffer(self._section("symbols"), "<u4") if self.n else np.zeros(0, "<u4")
        self.counts = np.frombuffer(self._section("counts"), "<i8") if self.n else np.zeros(0, "<i8")
        self.lengths = code_lengths(self.counts) if self.n else np.zeros(0, np.int64)
        self.codes, self.leaves = assign_codes(self.lengths) if self.n else (np.zeros(0, np.uint64), [])
        self.ranks = [np.frombuffer(self._section(f"ranks{i}"), "<i8") for i in range(len(self.levels))]
        self.starts = [np.frombuffer(self._section(f"blocks{i}"), "<i8") for i in range(len(self.levels))]
        self._block = lru_cache(cached_blocks)(self._read_block)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(self.start + at)
        return self.file.read(size)

    def _section(self, name: str) -> bytes:
        return self.unpack.decompress(self._read(*self.head["where"][name]))

    def _bits_of(self, raw: bytes) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.unpack.decompress(raw[1:]) if raw[0] else raw[1:], np.uint8))

    def _read_block(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        at, to = self.starts[level][block : block + 2]
        bits = self._bits_of(self._read(self.head["where"][f"plane{level}"][0] + int(at), int(to - at)))
        return bits, np.concatenate([[0], np.cumsum(bits)])

    def _rank1(self, level: int, i: int) -> int:
        """Ones of the level before position ``i``."""
        if i >= self.levels[level][0]:
            return int(self.ranks[level][-1])
        return int(self.ranks[level][i // BLOCK_BITS] + self._block(level, i // BLOCK_BITS)[1][i % BLOCK_BITS])

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the level's ``k``-th bit (from 0) of the given value."""
        ranks = self.ranks[level]
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * BLOCK_BITS, self.levels[level][0]) - ranks
        block = int(np.searchsorted(ranks, k, "right")) - 1
        at = np.flatnonzero(self._block(level, block)[0] == bit)[k - int(ranks[block])]
        return block * BLOCK_BITS + int(at)

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        for level, (size, zeros, done) in enumerate(self.levels):
            bit = int(self._block(level, i // BLOCK_BITS)[0][i % BLOCK_BITS])
            one = self._rank1(level, i)
            i = zeros + one if bit else i - one
            if i >= size - done:
                runs = np.cumsum(self.counts[self.leaves[level]])
                return int(self.symbols[self.leaves[level][np.searchsorted(runs, i - (size - done), "right")]])
        raise ValueError("broken shard")

    def _symbol(self, token: int) -> int | None:
        k = int(np.searchsorted(self.symbols, token))
        return k if k < len(self.symbols) and self.symbols[k] == token else None

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands before position ``i``."""
        return self.count(token, 0, i)

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often ``token`` stands in [start, stop)."""
        a, b = self._range(token, max(start, 0), self.n if stop is None else min(stop, self.n))
        return max(0, b - a)

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        k = self._symbol(token)
        if k is None or a >= b:
            return 0, 0
        for level in range(int(self.lengths[k])):
            x, y, zeros = self._rank1(level, a), self._rank1(level, b), self.levels[level][1]
            a, b = (zeros + x, zeros + y) if int(self.codes[k]) >> level & 1 else (a - x, b - y)
        return a, b

    def occurrences(self, token: int, start: int = 0, stop: int | None = None) -> Iterator[int]:
        """The positions of ``token`` in [start, stop), ascending."""
        k = self._symbol(token)
        a, b = self._range(token, max(start, 0), self.n if stop is None else min(stop, self.n))
        for i in range(a, b):
            for level in reversed(range(int(self.lengths[k]))):
                bit = int(self.codes[k]) >> level & 1
                i = self._select(level, bit, i - self.levels[level][1] if bit else i)
            yield i

    def decode(self) -> np.ndarray:
        """All ids, in order."""
        now = np.zeros(0, np.uint32)
        for level in reversed(range(len(self.levels))):
            size, zeros, done = self.levels[level]
            ends = self.leaves[level]
            if done:
                now = np.concatenate([now, np.repeat(self.symbols[ends].astype(np.uint32), self.counts[ends])])
            at = self.head["where"][f"plane{level}"]
            raw, starts = self._read(*at), self.starts[level]
            bits = np.concatenate([self._bits_of(raw[a:b]) for a, b in zip(starts, starts[1:])])[:size].view(bool)
            before = np.empty_like(now)
            before[np.flatnonzero(~bits)] = now[:zeros]
            before[np.flatnonzero(bits)] = now[zeros:]
            now = before
        return now


def write_shards(docs: DataFrame, folder: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id order as shard files; lazily, the manifest.

    Manifest: part, shard, path, docs, tokens, before (ids of the part's earlier
    shards).  Null texts are empty; null ids come first; rows that share an id
    stand in the order of their texts' hashes.  A shard closes before the document
    that would exceed ``shard_tokens``.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    docs = docs.select("doc_id", "text")
    sorted_docs = (docs.repartitionByRange(partitions, *order[:2]) if partitions else docs.repartitionByRange(*order[:2])).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, tokens, shard, before
            ids, doc_ids, null_id, sizes = (np.concatenate(x) for x in zip(*held))
            path = f"{folder}/part-{part:06d}-{shard:06d}.wvm"
            storage.put_bytes(path, encode_shard(ids, doc_ids, null_id, sizes))
            row = pd.DataFrame({"part": [part], "shard": [shard], "path": [path], "docs": [len(sizes)], "tokens": [len(ids)], "before": [before]})
            held, tokens, shard, before = [], 0, shard + 1, before + len(ids)
            return pa.RecordBatch.from_pandas(row, preserve_index=False)

        enc = word_encoding.encoder(tokenizer)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text")
            for first, rows in word_encoding.slices(texts):
                ids, sizes = word_encoding.with_end(*enc.encode(rows))
                keys = doc_ids.slice(first, len(rows))
                null_id = keys.is_null().to_numpy(zero_copy_only=False)
                keys = keys.fill_null(0).to_numpy()
                at, row, to = 0, 0, np.cumsum(sizes)
                while row < len(sizes):
                    fit = int(np.searchsorted(to, at + shard_tokens - tokens, "right"))
                    if fit <= row:
                        if held:
                            yield flush()
                            continue
                        fit = row + 1
                    end = int(to[fit - 1])
                    held.append((ids[at:end], keys[row:fit], null_id[row:fit], sizes[row:fit]))
                    tokens, at, row = tokens + end - at, end, fit
        if held:
            yield flush()

    return sorted_docs.mapInArrow(run, "part long, shard long, path string, docs long, tokens long, before long")


def read_shards(manifest: DataFrame, first_id: dict[int, int]) -> DataFrame:
    """Per document of the manifest's files: doc_id, start, n_tokens, ids_crc32, shard.

    ``first_id`` has the number of ids before each part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                with storage.open_file(row.path) as f:
                    shard = Shard(f)
                    raw = memoryview(shard.decode().astype("<u4").tobytes())
                to = np.cumsum(shard.sizes)
                start = to - shard.sizes
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), to.tolist())]
                ids = pd.array(shard.doc_ids, dtype="Int64")
                ids[shard.null_id] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": start + row.before + first_id[row.part], "n_tokens": shard.sizes, "ids_crc32": crc, "shard": row.path.rsplit("/", 1)[-1]})

    return manifest.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def wavelet_tokens(docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode, write as wavelet shards, and read every document's ids back from the files.

    Only one count for each partition comes to the driver."""
    spark = docs.sparkSession
    manifest = storage.table(write_shards(docs, storage.new_folder(spark, "wavelet"), tokenizer, shard_tokens), "wavelet-manifest")
    sums = {r.part: r.tokens for r in manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect()}
    first_id, total = {}, 0
    for part in sorted(sums):
        first_id[part], total = total, total + sums[part]
    files = max(1, len(sums))
    return read_shards(manifest.repartition(files), first_id)


def find_token(manifest: DataFrame, token: int) -> DataFrame:
    """path, position and doc_id of every occurrence of an id, from the index alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with storage.open_file(path) as f:
                    shard = Shard(f)
                    at = np.fromiter(shard.occurrences(token), np.int64)
                doc = np.searchsorted(np.cumsum(shard.sizes), at, "right")
                ids = pd.array(shard.doc_ids[doc], dtype="Int64")
                ids[shard.null_id[doc]] = pd.NA
                yield pd.DataFrame({"path": path, "position": at, "doc_id": ids})

    return manifest.mapInPandas(run, "path string, position long, doc_id long")
