"""Alignments from SAM text, BAM files and Parquet."""

from __future__ import annotations

import gzip
import os
import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sample string, contig string, pos int, flag int, cigar string, nm int, xs string, xm int, xg int"
OPS = "MIDNSHP=X"


def sample_of(path: str) -> str:
    name = os.path.basename(path)
    for end in (".gz", ".bam", ".sam", ".cram", ".parquet"):
        name = name.removesuffix(end)
    return name


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text; the sample is the file's name."""
    parts = F.split("value", "\t")
    tag = lambda name, kind: F.when(F.regexp_extract("value", rf"\t{name}:{kind}:([^\t]*)", 1) != "", F.regexp_extract("value", rf"\t{name}:{kind}:([^\t]*)", 1))
    sample = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), r"(\.gz|\.sam)+$", "")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(parts) >= 11))
    return rows.select(sample.alias("sample"), parts[2].alias("contig"), (parts[3].cast("int") - 1).alias("pos"), parts[1].cast("int").alias("flag"), parts[5].alias("cigar"), tag("NM", "i").cast("int").alias("nm"), tag("XS", "A").alias("xs"), tag("XM", "i").cast("int").alias("xm"), tag("XG", "i").cast("int").alias("xg"))


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """contig, length of a SAM header."""
    head = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    return head.select(F.regexp_extract("value", r"\tSN:([^\t]*)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("int").alias("length"))


def header(path: str) -> list[tuple[str, int]]:
    """(contig, length) in the order of a file's header; none for a text without one."""
    if path.endswith(".bam"):
        with _open(path) as f:
            return bam_header(Bgzf(f))
    out = []
    with _open(path) as raw, gzip.open(raw) if path.endswith(".gz") else raw as f:
        for line in f:
            if not line.startswith(b"@"):
                break
            if line.startswith(b"@SQ"):
                fields = dict(x.split(":", 1) for x in line.decode().rstrip("\r\n").split("\t")[1:])
                out.append((fields["SN"], int(fields["LN"])))
    return out


class Bgzf:
    """The bytes of a BGZF file from one of its blocks on, a block at a time.

    ``within``: how many of the bytes read and held so far come from blocks that start
    before ``stop``."""

    def __init__(self, file, start: int = 0, stop: int | None = None):
        self.file, self.at, self.stop = file, start, stop
        self.held, self.taken, self.within = b"", 0, 0
        file.seek(start)

    def more(self) -> bool:
        """Hold one more block; False at the end of the file."""
        head = self.file.read(12)
        if len(head) < 12:
            return False
        extra = self.file.read(struct.unpack_from("<H", head, 10)[0])
        size = _block_size(extra)
        if head[:4] != MAGIC or size is None:
            raise ValueError("not a BGZF file")
        raw = self.file.read(size - 12 - len(extra))
        data = zlib.decompress(raw[:-8], -15)
        self.held += data
        if self.stop is None or self.at < self.stop:
            self.within += len(data)
        self.at += size
        return True

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        self.taken += len(out)
        return out


MAGIC = b"\x1f\x8b\x08\x04"


def _block_size(extra: bytes) -> int | None:
    at = 0
    while at + 4 <= len(extra):
        length = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"BC":
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + length
    return None


def next_block(file, start: int, stop: int) -> int | None:
    """The first block that starts in [start, stop): one that is followed by another or by the end."""
    file.seek(start)
    raw = file.read(min(stop - start, 1 << 16) + 2 * (1 << 16) + 32)
    at = raw.find(MAGIC)
    while 0 <= at and start + at < stop:
        size = _block_size(raw[at + 12 : at + 12 + struct.unpack_from("<H", raw, at + 10)[0]]) if at + 12 <= len(raw) else None
        if size is not None and (raw[at + size : at + size + 4] == MAGIC or at + size >= len(raw)):
            return start + at
        at = raw.find(MAGIC, at + 1)
    return None


def bam_header(stream: Bgzf) -> list[tuple[str, int]]:
    """(contig, length) in the file's order."""
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.read(struct.unpack("<i", stream.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        name = stream.read(struct.unpack("<i", stream.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", stream.read(4))[0]))
    return out


def _plausible(raw: bytes, at: int, contigs: list[tuple[str, int]]) -> int | None:
    """The end of the record at ``at`` if it can be one."""
    if at + 36 > len(raw):
        return None
    size, ref, pos, name, _, _, n_ops, _, length, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", raw, at)
    fixed = 32 + name + 4 * n_ops + (max(length, 0) + 1) // 2 + max(length, 0)
    inside = lambda r, p: -1 <= r < len(contigs) and -1 <= p and (r < 0 or p <= contigs[r][1])
    if length < 0 or name < 1 or not fixed <= size < 1 << 26 or not inside(ref, pos) or not inside(mate, mate_pos):
        return None
    end = at + 36 + name
    if end <= len(raw) and (raw[end - 1] != 0 or any(not 33 <= c <= 126 for c in raw[at + 36 : end - 1])):
        return None
    return at + 4 + size


def first_record(stream: Bgzf, contigs: list[tuple[str, int]], chain: int = 4) -> bool:
    """Move to the first record that starts in the blocks of the split: one from which ``chain`` records follow."""
    while len(stream.held) < 1 << 18 and stream.more():
        pass
    for at in range(stream.within):
        end, n = _plausible(stream.held, at, contigs), 1
        while end is not None and n < chain and end + 36 <= len(stream.held):
            end, n = _plausible(stream.held, end, contigs), n + 1
        if end is not None and (n == chain or end + 36 > len(stream.held)):
            stream.read(at)
            return True
    return False


def _tags(raw: bytes, at: int) -> dict[str, object]:
    sizes = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    out: dict[str, object] = {}
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode("latin-1"), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            at = end + 1
        elif kind == "B":
            at += 5 + sizes[chr(raw[at])] * struct.unpack_from("<i", raw, at + 1)[0]
        else:
            if kind == "A":
                out[name] = chr(raw[at])
            else:
                out[name] = struct.unpack_from("<" + {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}[kind], raw, at)[0]
            at += sizes[kind]
    return out


def bam_records(stream: Bgzf, sample: str, contigs: list[tuple[str, int]]) -> Iterator[tuple]:
    """The records that start in the stream's own blocks."""
    while stream.held or stream.more():
        if stream.stop is not None and stream.taken >= stream.within:
            return
        head = stream.read(4)
        if len(head) < 4:
            return
        raw = stream.read(struct.unpack("<i", head)[0])
        ref, pos, name, _, _, n_ops, flag, length = struct.unpack_from("<iiBBHHHi", raw)
        at = 32 + name
        ops = struct.unpack_from(f"<{n_ops}I", raw, at)
        tags = _tags(raw, at + 4 * n_ops + (length + 1) // 2 + length)
        number = lambda t: None if isinstance(tags.get(t), str) else tags.get(t)  # noqa: B023, E731
        cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops) or "*"
        yield sample, contigs[ref][0] if ref >= 0 else "*", pos, flag, cigar, number("NM"), tags["XS"] if isinstance(tags.get("XS"), str) else None, number("XM"), number("XG")


def _open(path: str):
    if path.startswith("file:") or "://" not in path:
        return open(path.removeprefix("file://").removeprefix("file:"), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class _Split(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class BamReader(DataSourceReader):
    """Reads whole files by byte splits, or, with an index, the chunks of a region.

    The region is the option ``region`` (contig, or contig:start-stop, 0-based, half-open).
    It is no pushed-down filter: Spark keeps what a Python source was pushed for all later
    queries on the same DataFrame, which would then lose rows."""

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.size = int(options.get("splitBytes", 128 << 20))
        self.contig: str | None = None
        self.start, self.stop = 0, 1 << 40
        if region := options.get("region"):
            name, _, place = region.rpartition(":") if re.search(r":\d+-\d+$", region) else (region, "", "")
            self.contig = name
            if place:
                self.start, self.stop = map(int, place.split("-"))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            index = read_index(path) if self.contig is not None else None
            if index is not None:
                with _open(path) as f:
                    number = contig_number(bam_header(Bgzf(f)), self.contig)
                run: list[tuple[int, int]] = []
                for chunk in index.find(number, max(self.start, 0), self.stop) if number is not None else []:
                    if run and (chunk[1] >> 16) - (run[0][0] >> 16) > self.size:
                        out.append(_Region(path, run))
                        run = []
                    run.append(chunk)
                out.append(_Region(path, run))
                continue
            with _open(path) as f:
                f.seek(0, 2)
                end = f.tell()
            out += [_Split(path, a, min(a + self.size, end)) for a in range(0, end, self.size)]
        return out

    def read(self, split: InputPartition) -> Iterator[tuple]:
        if isinstance(split, _Region):
            yield from self._chunks(split)
            return
        with _open(split.path) as f:
            head = Bgzf(f, 0, split.stop)
            contigs = bam_header(head)
            if split.start == 0:
                stream = head
            else:
                block = next_block(f, split.start, split.stop)
                if block is None:
                    return
                stream = Bgzf(f, block, split.stop)
                if not first_record(stream, contigs):
                    return
            yield from self._wanted(bam_records(stream, sample_of(split.path), contigs), contigs)

    def _chunks(self, split: "_Region") -> Iterator[tuple]:
        if not split.chunks:
            return
        with _open(split.path) as f:
            contigs = bam_header(Bgzf(f))
            for first, last in split.chunks:
                yield from self._wanted(bam_records(BgzfChunk(f, first, last), sample_of(split.path), contigs), contigs)

    def _wanted(self, rows: Iterator[tuple], contigs: list[tuple[str, int]]) -> Iterator[tuple]:
        """The rows of the region."""
        if self.contig is None:
            yield from rows
            return
        if contig_number(contigs, self.contig) is None:
            return
        for r in rows:
            if r[1] == self.contig and r[2] < self.stop and r[2] + max(1, reference_length(r[4])) > self.start:
                yield r


class BamSource(DataSource):
    """``spark.read.format("bam").option("splitBytes", n).load("a.bam,b.bam")``.

    Files are split by bytes without an index: a split starts at the first block in
    it, and there at the first place from which several records follow.  The reads
    of a region come through the file's BAI or CSI index if it has one."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, paths: list[str], split_bytes: int = 128 << 20, region: str | None = None) -> DataFrame:
    """The alignments of BAM files; of a region (contig, or contig:start-stop) those that overlap it, through the files' indexes where there are any."""
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam").option("splitBytes", split_bytes)
    return (reader.option("region", region) if region else reader).load(",".join(paths))


# --- reads of a region by the file's index ---------------------------------------------


def region_bins(start: int, stop: int, shift: int = 14, depth: int = 5) -> list[tuple[int, int]]:
    """(first, last) number of the bins of each level that overlap [start, stop)."""
    out, first = [], 0
    for level in range(depth + 1):
        at = shift + 3 * (depth - level)
        out.append((first + (start >> at), first + ((stop - 1) >> at)))
        first += 8**level
    return out


class BamIndex:
    """The bins of a BAI or CSI file: for each contig its bins' chunks (virtual offsets), and below what offset no read of a place lies."""

    def __init__(self, raw: bytes):
        self.shift, self.depth, at = 14, 5, 8
        plain = raw[:4] == b"BAI\1"
        if not plain:
            if raw[:4] != b"CSI\1":
                raise ValueError("neither a BAI nor a CSI index")
            self.shift, self.depth, extra = struct.unpack_from("<iii", raw, 4)
            at = 16 + extra + 4
        n_contigs = struct.unpack_from("<i", raw, at - 4)[0]
        self.chunks: list[dict[int, list[tuple[int, int]]]] = []
        self.lowest: list[list[int] | dict[int, int]] = []
        for _ in range(n_contigs):
            bins: dict[int, list[tuple[int, int]]] = {}
            low: dict[int, int] = {}
            n_bins = struct.unpack_from("<i", raw, at)[0]
            at += 4
            for _ in range(n_bins):
                number = struct.unpack_from("<I", raw, at)[0]
                at += 4
                if not plain:
                    low[number] = struct.unpack_from("<Q", raw, at)[0]
                    at += 8
                n = struct.unpack_from("<i", raw, at)[0]
                pairs = struct.unpack_from(f"<{2 * n}Q", raw, at + 4)
                at += 4 + 16 * n
                bins[number] = list(zip(pairs[::2], pairs[1::2]))
            if plain:
                n = struct.unpack_from("<i", raw, at)[0]
                self.lowest.append(list(struct.unpack_from(f"<{n}Q", raw, at + 4)))
                at += 4 + 8 * n
            else:
                self.lowest.append(low)
            self.chunks.append(bins)

    def find(self, contig: int, start: int, stop: int) -> list[tuple[int, int]]:
        """Chunks of the file, in order and not overlapping, that hold all reads of a contig that overlap [start, stop)."""
        stop = min(stop, 1 << (self.shift + 3 * self.depth))
        if contig >= len(self.chunks) or start >= stop:
            return []
        levels = region_bins(start, stop, self.shift, self.depth)
        low, lowest = 0, self.lowest[contig]
        if isinstance(lowest, list):
            if lowest:
                low = lowest[min(start >> 14, len(lowest) - 1)]
        else:  # of the smallest bin with an offset that begins at or before the start and holds it
            low = next((lowest[first] for first, _ in reversed(levels) if first in lowest), 0)
        found = sorted(c for number, cs in self.chunks[contig].items() if any(a <= number <= b for a, b in levels) for c in cs if c[1] > low)
        out: list[tuple[int, int]] = []
        for a, b in found:
            a = max(a, low)
            if out and a >> 16 <= out[-1][1] >> 16:  # in a block that is read anyway
                out[-1] = out[-1][0], max(b, out[-1][1])
            else:
                out.append((a, b))
        return out


def read_index(path: str) -> BamIndex | None:
    """The index beside a file: name.bam.bai, name.bai, name.bam.csi or name.csi."""
    base = path.removesuffix(".bam")
    for name in (f"{path}.bai", f"{base}.bai", f"{path}.csi", f"{base}.csi"):
        try:
            with _open(name) as f:
                raw = f.read()
        except (FileNotFoundError, OSError):
            continue
        return BamIndex(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
    return None


class BgzfChunk(Bgzf):
    """The bytes between two virtual offsets (block << 16 | place within); no block after the last is read."""

    def __init__(self, file, first: int, last: int):
        super().__init__(file, first >> 16)
        self.end, self.left_out = last, first & 0xFFFF

    def more(self) -> bool:
        here, before = self.at, len(self.held)
        if here > self.end >> 16 or here == self.end >> 16 and not self.end & 0xFFFF or not super().more():
            return False
        block = self.held[before:]
        if here == self.end >> 16:
            block = block[: self.end & 0xFFFF]
        self.held = self.held[:before] + block[self.left_out :]
        self.left_out = 0
        return True


def reference_length(cigar: str) -> int:
    return sum(int(n) for n, op in re.findall(r"(\d+)([MDN=X])", cigar))


class _Region(InputPartition):
    def __init__(self, path: str, chunks: list[tuple[int, int]]):
        self.path, self.chunks = path, chunks


# Fixed value: a contig whose reads are left out.
LEFT_OUT = "MT"


def contig_number(contigs: list[tuple[str, int]], name: str) -> int | None:
    """The place of a contig in the header; none for one that is not there or is left out."""
    names = [c for c, _ in contigs]
    return names.index(name) if name in names and name != LEFT_OUT else None
