"""ISO base media containers in a binary column.

:func:`build` stores a payload as raw 8 by 8 grey frames of 64 bytes; :func:`walk`
and :func:`tracks` read any container's nested boxes and sample tables without
looking into the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from junctura.llm import storage
from junctura.llm.word_encoding import slices

FRAME = 64
RATE = 25
CHUNK = 256  # frames
KEY_EVERY = 32  # frames
MAX_PATH = 16  # deeper boxes have their outermost names and their own in the path
CONTAINERS = frozenset(b"moov trak mdia minf stbl dinf edts udta mvex moof traf".split())


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I", len(body) + 8) + kind + body
    return struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def build(payload: bytes) -> bytes:
    """A container with the payload (a positive multiple of FRAME bytes) as one raw video track."""
    n = len(payload) // FRAME
    if not n or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of the frame size")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = struct.pack(">6xH16xHHIIIH32sHh", 1, 8, 8, 0x480000, 0x480000, 0, 1, b"\0" * 32, 40, -1)  # depth 40: 8-bit grey
    chunks = -(-n // CHUNK)
    stsc = [(1, min(CHUNK, n), 1)]
    if n > CHUNK and n % CHUNK:
        stsc.append((chunks, n % CHUNK, 1))
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    ftyp = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  isom")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (CHUNK * FRAME)
        wide = first + len(payload) >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(13)), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), matrix, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    first = len(ftyp) + len(moov(1 << 33 if len(payload) > 1 << 31 else 0)) + head
    return b"".join([ftyp, moov(first), box(b"mdat", payload)])


def walk(data: bytes) -> Iterator[tuple[tuple, int, int]]:
    """(path, start, stop) of the content of each box, containers before what they hold.

    Boxes may nest as deep as they like.  Raises ValueError at a box that runs over its
    container."""
    open_boxes = [((), 0, len(data))]
    while open_boxes:
        path, at, stop = open_boxes.pop()
        if at + 8 > stop:
            continue
        size, kind, head = struct.unpack_from(">I", data, at)[0], bytes(data[at + 4 : at + 8]), 8
        if size == 1:
            if at + 16 > stop:
                raise ValueError(f"box {kind!r} at {at} is cut")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = stop - at
        if size < head or at + size > stop:
            raise ValueError(f"box {kind!r} at {at} runs over its container")
        open_boxes.append((path, at + size, stop))
        inner = (*path[:MAX_PATH], kind)
        yield inner, at + head, at + size
        if kind in CONTAINERS:
            open_boxes.append((inner, at + head, at + size))


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 1
    duration: int = 0
    offsets: np.ndarray | None = None
    sizes: np.ndarray | None = None
    keys: np.ndarray | None = None  # sample indices from 0

    def key_ranges(self) -> list[tuple[int, int]]:
        """[start, stop) bytes of each keyframe."""
        return [(int(self.offsets[k]), int(self.offsets[k] + self.sizes[k])) for k in self.keys]


def _table(data: bytes, at: int, stop: int, columns: int, kind: str = ">u4") -> np.ndarray:
    n = struct.unpack_from(">I", data, at + 4)[0]
    width = np.dtype(kind).itemsize * columns
    if at + 8 + n * width > stop:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, n * columns, at + 8).astype(np.int64).reshape(n, columns)


class Broken(ValueError):
    """A container whose tables cannot be read, and why."""


def tracks(data: bytes) -> list[Track]:
    """The tracks of a container, their sample tables decoded.

    Raises :class:`Broken` where boxes or tables contradict each other or the file's
    length, and where samples are in movie fragments; memory is bounded by the file."""
    try:
        return _tracks(data)
    except (ValueError, IndexError, OverflowError, struct.error) as e:
        raise Broken(str(e) or type(e).__name__) from e


def _tracks(data: bytes) -> list[Track]:
    out: list[Track] = []
    raw: list[dict] = []
    for path, a, b in walk(data):
        kind = path[-1]
        if kind == b"moof":
            raise ValueError("movie fragments (moof) are not supported")
        if path == (b"moov", b"trak"):
            out.append(Track())
            raw.append({})
        if not out or path[:2] != (b"moov", b"trak"):
            continue
        track, tables = out[-1], raw[-1]
        if kind == b"mdhd":
            wide = data[a] == 1
            track.timescale, track.duration = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
        elif kind == b"hdlr":
            track.handler = data[a + 8 : a + 12].decode("latin-1")
        elif kind == b"stsd":
            track.codec = data[a + 12 : a + 16].decode("latin-1").strip()
            if track.handler == "vide":
                track.width, track.height = struct.unpack_from(">HH", data, a + 40)
        elif kind in (b"stsc", b"stts"):
            tables[kind] = _table(data, a, b, 3 if kind == b"stsc" else 2)
        elif kind in (b"stco", b"co64"):
            tables[b"stco"] = _table(data, a, b, 1, ">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind == b"stss":
            tables[kind] = _table(data, a, b, 1)[:, 0]
        elif kind == b"stsz":
            one, n = struct.unpack_from(">II", data, a + 4)
            if (n * one > len(data)) if one else (a + 12 + 4 * n > b):
                raise ValueError("a table of sizes tells of more than the file holds")
            tables[kind] = np.full(n, one, np.int64) if one else np.frombuffer(data, ">u4", n, a + 12).astype(np.int64)
        elif kind == b"stz2":
            bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
            if bits not in (4, 8, 16) or a + 12 + (n * bits + 7) // 8 > b:
                raise ValueError("a table of compact sizes is broken")
            if bits == 4:
                pairs = np.frombuffer(data, "u1", (n + 1) // 2, a + 12)
                tables[b"stsz"] = np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n].astype(np.int64)
            else:
                tables[b"stsz"] = np.frombuffer(data, f">u{bits // 8}", n, a + 12).astype(np.int64)
    for track, tables in zip(out, raw):
        sizes, chunks = tables.get(b"stsz", np.zeros(0, np.int64)), tables.get(b"stco", np.zeros(0, np.int64))
        stsc = tables.get(b"stsc", np.zeros((0, 3), np.int64))
        runs = np.diff([*stsc[:, 0].tolist(), len(chunks) + 1])
        if len(stsc) and (stsc[0, 0] != 1 or (runs < 0).any()):
            raise ValueError("the runs of chunks are out of order")
        per = np.repeat(stsc[:, 1], runs) if len(stsc) else np.zeros(0, np.int64)
        if per.sum() != len(sizes):
            raise ValueError("chunks and samples do not agree")
        chunk = np.repeat(np.arange(len(per)), per)
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(per) - per
        track.sizes = sizes
        track.offsets = chunks[chunk] + before - before[first[chunk]] if len(sizes) else sizes
        track.keys = tables[b"stss"] - 1 if b"stss" in tables else np.arange(len(sizes))
        if len(track.keys) and not 0 <= track.keys.min() <= track.keys.max() < len(sizes):
            raise ValueError("a keyframe is none of the samples")
        if not track.timescale:
            raise ValueError("a time scale is zero")
        if b"stts" in tables and not track.duration:
            track.duration = int((tables[b"stts"][:, 0] * tables[b"stts"][:, 1]).sum())
    return out


def payload(data: bytes, track: Track) -> bytes:
    """The samples' bytes, in order; runs of adjacent samples are read as one.

    Raises :class:`Broken` where they are not in the file, or more than the file."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    if track.offsets.min() < 0 or ends.max() > len(data) or track.sizes.sum() > len(data):
        raise Broken("samples lie outside of the file")
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    return b"".join(data[a:b] for a, b in zip(track.offsets[[0, *cut]].tolist(), ends[[*(cut - 1), -1]].tolist()))


def describe(track: Track) -> str:
    """codec, size, seconds, samples and keyframe byte ranges (count and checksum)."""
    ranges = np.stack([track.offsets[track.keys], track.offsets[track.keys] + track.sizes[track.keys]], 1).astype("<i8")
    return f"{track.codec} {track.width}x{track.height} {track.duration / track.timescale:.2f}s {len(track.sizes)} samples {len(ranges)} keyframes {zlib.crc32(ranges.tobytes()):08x}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the column ``media``: each text (null: empty) as a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in slices(batch.column("text"), 8 << 20):
                raw = [(t or "").encode() for t in rows.to_pylist()]
                media = [build(x + bytes(max(FRAME, -(-len(x) // FRAME) * FRAME) - len(x))) for x in raw]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(rows)), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Digests and features of each container in ``media``; of more than one track joined by ", ", in their order.

    The payload is that of all tracks, ``seconds`` the longest, ``keyframes`` the byte
    range [start, stop) of every keyframe with its track's number.  A null or broken
    container, or one with fragments, gives nulls and the reason in ``error``; no bytes
    stop the job.  Columns beside doc_id, n_bytes and media are not read."""

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None, None, None, None, None, None, "no container"
        sha = hashlib.sha256(data).hexdigest()
        try:
            found = tracks(data)
            if not found:
                raise Broken("no track")
            body = b"".join(payload(data, t) for t in found)
        except Broken as e:
            return None, None, None, len(data), sha, None, None, None, None, str(e)
        feature, seconds = ", ".join(map(describe, found)), max(t.duration / t.timescale for t in found)
        keys = [{"track": k, "start": a, "stop": b} for k, t in enumerate(found) for a, b in t.key_ranges()]
        return len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-FRAME:]), len(data), sha, feature, ", ".join(t.codec for t in found), seconds, keys, None

    ranges = pa.list_(pa.struct([("track", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), ranges, pa.string()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "seconds", "keyframes", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(one(x.as_py()) for x in batch.column("media")))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, keyframes array<struct<track: int, start: long, stop: long>>, error string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text of ``docs`` (doc_id, text) in a media column, and read features back from it.

    Null texts are empty: a payload of one frame.  Each row, repeated or not, has its own
    container; equal texts have equal bytes.  Long texts are stored whole.  An empty table
    gives no rows; other columns of ``docs`` are not read, whatever their names."""
    return features(storage.table(store(docs), "media"))
