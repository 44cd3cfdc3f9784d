"""Alignment of two tokenizers' tokens by distinct segments.

A text with a space in front is split before its runs of white space.  Whether the
tokens of either vocabulary can reach across such a place is looked up in the
vocabularies themselves: a white-space character takes part only where no entry has it
after another character, so the segments' tokens, put together, are the text's tokens,
and every border of segments is a border of both token sequences.

1. Documents become codes of segments within blocks of bounded size.
2. The blocks' segments meet by their text; every distinct one is tokenized and aligned
   once.
3. Counts of linked id pairs are sums over distinct segments, weighted by how often
   each occurs; the counts of a segment's links are joined back to it.
4. The segments' alignments go back to their blocks, where the documents are composed.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm import storage

MARK = "▁"
BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 50_000
LIST_ROWS = 20_000  # segments in a row of a block's list
BATCH = 8192
BROADCAST_PAIRS = 50_000

# Characters that every library takes for white space.
CERTAIN_SPACE = "\t\n\v\f\r "

_zstd = pa.Codec("zstd", compression_level=1)
_pairs: dict[tuple[str, str], "TokenPair"] = {}


def token_pair(a: str, b: str) -> "TokenPair":
    """This worker's two tokenizers."""
    if (a, b) not in _pairs:
        _pairs[a, b] = TokenPair(a, b)
    return _pairs[a, b]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Aligned:
    """Alignments of a list of segments, flat, with offsets."""

    groups: list[str]
    n_a: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    n_links: np.ndarray


class TokenPair:
    """A byte-level BPE of the tokenizers library (A) and a merge-type model of sentencepiece (B)."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        alphabet = byte_alphabet()
        size = max(self.a.get_vocab(with_added_tokens=False).values()) + 1
        self.a_bytes = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        if sum(map(self.b.is_byte, range(len(self.b_bytes)))) != 256 or self.b.encode("") or self.b.encode(" x")[0] == self.b.encode("x")[0]:
            raise ValueError(f"{b}: only models with bytes for unknown characters, a dummy prefix and no change of spaces are supported")
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.mark = self.b.piece_to_id(MARK)
        self.split = "".join(c for c in CERTAIN_SPACE if self._bordered(c))
        if " " not in self.split:
            raise ValueError(f"{a}, {b}: entries reach across spaces")
        other = "".join(re.escape(chr(c)) for c in range(0x3001) if chr(c).isspace() and chr(c) not in self.split)
        self.segment = re.compile(rf"\s*\S+(?:[{other}]\s*\S*)*|\s+")

    def _bordered(self, space: str) -> bool:
        """No entry of either vocabulary has this character after one that is no white space."""
        inner = [p.decode("utf-8", "replace") for p in self.a_bytes] + [self.b_bytes[i].decode("utf-8", "replace") for i in range(len(self.b_bytes)) if not self.b.is_byte(i)]
        if any(re.search(rf"\S{re.escape(space)}", p) for p in inner if space in p):
            return False
        # the model puts a mark in front of a segment that does not begin with a space; it has to stay alone
        return space == " " or not any(" " + space in p for p in inner[len(self.a_bytes) :])

    def segments(self, text: str | None) -> list[str]:
        """The segments of a text with a space in front; none for texts whose bytes the pieces cannot give back."""
        return [] if not text or MARK in text else self.segment.findall(f" {text}")

    def ids(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each segment in both vocabularies, as they are within any text."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for i, s in enumerate(segments):
            if s == " ":
                b[i] = [self.mark]
            elif s[0] != " ":
                b[i] = b[i][1:]
        return a, b

    def align(self, segments: list[str]) -> Aligned:
        """Both token sequences cut each segment's bytes; links are the pieces of the finer cut, groups end at common ends."""
        a, b = self.ids(segments)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a, b = (np.fromiter((i for x in y for i in x), np.int64) for y in (a, b))
        whole = "".join(segments).encode()
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            raise ValueError("the tokens do not give back their segments")
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.union1d(end_a, end_b)
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(end_a, common) + 1, np.searchsorted(end_b, common) + 1
        last = end_a[np.cumsum(n_a) - 1]
        n_groups = np.diff(np.searchsorted(common, last, "right"), prepend=0)
        n_links = np.diff(np.searchsorted(ends, last, "right"), prepend=0)
        text_a, text_b = a.astype(str).tolist(), b.astype(str).tolist()
        cut_a, cut_b = [0, *group_a.tolist()], [0, *group_b.tolist()]
        each = [f"{','.join(text_a[p:q])}|{','.join(text_b[r:s])}" for p, q, r, s in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
        at = [0, *np.cumsum(n_groups).tolist()]
        return Aligned([";".join(each[p:q]) for p, q in zip(at, at[1:])], n_a, a[link_a], b[link_b], n_links)


CODED = "block long, doc_id long, codes binary, first_code int, segments array<string>, counts array<long>"
ALIGNED = "sid long, block long, code int, n long, n_a long, groups string, a array<int>, b array<int>"
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
RESULT = f"doc_id long, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string"


def _packed(codes: np.ndarray) -> bytes:
    """Codes byte plane by byte plane, compressed: most are small."""
    return len(codes).to_bytes(4, "little") + _zstd.compress(codes.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(_zstd.decompress(raw[4:], 4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32).ravel()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def coded(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Blocks of documents: a row a document with its segments' codes, and rows with the block's segments in the order of their codes."""
    schema = _schema(CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(a, b)
        block, known, seen, size, rows = TaskContext.get().partitionId() << 32, {}, [], 0, 0

        def lists() -> Iterator[pa.RecordBatch]:
            names, counts = list(known), np.bincount(np.concatenate([*seen, np.zeros(0, np.int32)]), minlength=1)
            for at in range(0, len(names), LIST_ROWS):
                part = slice(at, at + LIST_ROWS)
                yield pa.RecordBatch.from_pylist([{"block": block, "first_code": at, "segments": names[part], "counts": counts[part]}], schema)

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            start, found = 0, []
            for i in range(len(texts)):
                segments = pair.segments(texts[i].as_py())
                codes = np.fromiter((known.setdefault(s, len(known)) for s in segments), np.int32, len(segments))
                seen.append(codes)
                found.append(_packed(codes))
                size, rows = size + sum(map(len, segments)), rows + 1
                full = size >= BLOCK_BYTES or rows >= BLOCK_ROWS
                if full or i + 1 == len(texts):
                    n = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, block)), ids.slice(start, n), pa.array(found, pa.binary()), *(pa.nulls(n, f.type) for f in list(schema)[3:])], schema=schema
                    )
                    start, found = i + 1, []
                if full:
                    yield from lists()
                    block, known, seen, size, rows = block + 1, {}, [], 0, 0
        yield from lists()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CODED)


def aligned(blocks: DataFrame, a: str, b: str) -> DataFrame:
    """The distinct segments of all blocks with their alignment (``block`` is null), and where each occurs.

    Segments come sorted, so equal ones stand together; ``n`` is how often one occurs in all documents."""
    schema = _schema(ALIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(a, b)
        sid, held, last = (TaskContext.get().partitionId() << 40) - 1, None, None

        def rows(names: list[str], first: int, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(names), BATCH):
                x = pair.align(names[at : at + BATCH])
                k = len(x.groups)
                cut = pa.array(np.concatenate([[0], np.cumsum(x.n_links)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first + at, first + at + k)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array(n[at : at + k]), pa.array(x.n_a), pa.array(x.groups),
                     *(pa.ListArray.from_arrays(cut, pa.array(y.astype(np.int32))) for y in (x.link_a, x.link_b))], schema=schema
                )

        for batch in batches:
            if not len(batch):
                continue
            names, n = batch.column("segment"), batch.column("n").to_numpy()
            new = np.ones(len(names), bool)
            new[1:] = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)
            new[0] = names[0].as_py() != last
            sids = sid + np.cumsum(new)
            empty = [pa.nulls(len(names), f.type) for f in list(schema)[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(sids), batch.column("block"), batch.column("code"), *empty], schema=schema)
            # the last one may go on in the next batch: it is held back with its count so far
            total = np.bincount(sids - sid, n, int(sids[-1] - sid) + 1).astype(np.int64)
            fresh = names.filter(pa.array(new)).to_pylist()
            if held is None:
                todo, count, first = fresh, total[1:], sid + 1
            else:
                todo, count, first = [held[0], *fresh], np.concatenate([[held[1] + total[0]], total[1:]]), sid
            yield from rows(todo[:-1], first, count[:-1])
            held, sid, last = (todo[-1], int(count[-1])), int(sids[-1]), todo[-1]
        if held is not None:
            yield from rows([held[0]], sid, np.array([held[1]]))

    lists = blocks.where("segments IS NOT NULL").select("block", "first_code", F.posexplode(F.arrays_zip("segments", "counts")).alias("i", "s"))
    each = lists.select(F.col("s.segments").alias("segment"), "block", (F.col("first_code") + F.col("i")).alias("code"), F.col("s.counts").alias("n"))
    return each.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, ALIGNED)


def pair_counts(segments: DataFrame) -> DataFrame:
    """a, b, count (links of all documents that hold the pair), n_segments (distinct ones, with repeats, that have it), best (no a has a higher count with b)."""
    links = segments.select("n", F.explode(F.arrays_zip("a", "b")).alias("l"))
    counts = links.groupBy(F.col("l.a").alias("a"), F.col("l.b").alias("b")).agg(F.sum("n").alias("count"), F.count("*").alias("n_segments"))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("a", "b", "count", "n_segments", (F.col("count") == F.col("top")).cast("long").alias("best"))


def segment_sums(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """sid, n_best, count_sum of each distinct segment.

    Pairs with more than 1 / BROADCAST_PAIRS of all links are at most BROADCAST_PAIRS; their links stay where they are, those of the others meet them by a shuffle."""
    links = segments.select("sid", F.explode(F.arrays_zip("a", "b")).alias("l")).select("sid", F.col("l.a").alias("a"), F.col("l.b").alias("b"))
    total = pairs.agg(F.sum("n_segments")).first()[0] or 0
    found = storage.join_heavy(links, pairs, ["a", "b"], F.col("n_segments") > total // BROADCAST_PAIRS, BROADCAST_PAIRS)
    return found.groupBy("sid").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))


def _compose(key: tuple, docs: pa.Table, segments: pa.Table) -> pa.Table:
    """The documents of a block from its segments' alignments.

    A group of p and q tokens has p + q - 1 links, so the other numbers follow from the text of the groups."""
    place = np.empty(len(segments), np.int64)
    place[segments.column("code").to_numpy()] = np.arange(len(segments))
    text = segments.column("groups").combine_chunks()
    count = lambda mark: pc.count_substring(text, mark).to_numpy(zero_copy_only=False).astype(np.int64)
    n_groups, n_a = count("|"), segments.column("n_a").to_numpy()
    n_links = count(",") + n_groups
    values = [v[place] for v in (n_a, n_links + n_groups - n_a, n_groups, n_links, segments.column("n_best").to_numpy(), segments.column("count_sum").to_numpy())]
    groups = np.array(text.to_pylist(), object)[place]
    codes = [_unpacked(x) for x in docs.column("codes").to_pylist()]
    sums = [pa.array([int(v[c].sum()) for c in codes], pa.int64()) for v in values]
    digest = [hashlib.sha256(";".join(groups[c].tolist()).encode()).hexdigest() if len(c) else "" for c in codes]
    return pa.table([docs.column("doc_id"), *sums, pa.array(digest, pa.string())], schema=_schema(RESULT))


@dataclass
class Alignment:
    """Written tables: ``blocks`` of coded documents, ``found`` segments and their places, ``pairs`` of linked ids with their counts."""

    blocks: DataFrame
    found: DataFrame
    pairs: DataFrame

    def segments(self) -> DataFrame:
        """The distinct segments: sid, n (in all documents), groups, and the ids a and b of their links."""
        return self.found.where("block IS NULL").select("sid", "n", "n_a", "groups", "a", "b")

    def documents(self, last: bool = False) -> DataFrame:
        """A row a document.  ``last``: nothing else will be read, so tables go as soon as they are."""
        spark, segments = self.found.sparkSession, self.segments()
        wide = segments.select("sid", "n_a", "groups").join(segment_sums(segments, self.pairs), "sid")
        placed = storage.table(self.found.where("block IS NOT NULL").select("sid", "block", "code").join(wide, "sid").drop("sid"), "alignment-placed")
        if last:
            storage.drop(self.found, self.pairs)
        del segments, wide
        storage.settle(spark)
        coded_docs = self.blocks.where("codes IS NOT NULL").select("block", "doc_id", "codes")
        return coded_docs.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(_compose, RESULT)


def alignment(docs: DataFrame, a: str, b: str) -> Alignment:
    """The alignment of the tokens of tokenizer file ``a`` and model file ``b`` over ``docs`` (doc_id, text).

    Texts that are null or empty, or hold U+2581 (which the model gives back as a space), have no tokens:
    zeros and an empty digest.  Null and repeated ids give a row each; other columns are not read; very
    long texts are coded whole; an empty table gives empty tables."""
    token_pair(a, b)  # a wrong kind of file is an error here
    spark = docs.sparkSession
    blocks = storage.table(coded(docs, a, b), "alignment-blocks")
    found = storage.table(aligned(blocks, a, b), "alignment-segments")
    storage.settle(spark)
    pairs = storage.table(pair_counts(found.where("block IS NULL")), "alignment-pairs")
    storage.settle(spark)
    return Alignment(blocks, found, pairs)


def align_documents(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.  Edge cases: :func:`alignment`."""
    return alignment(docs, a, b).documents(last=True)
