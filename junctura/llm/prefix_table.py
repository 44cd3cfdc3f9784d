"""Exact encoding with a merge-type sentence-piece model by a prefix table.

The encoding of a prefix is unique, so is its last piece.  An automaton finds the
pieces that end at a position; the right one is the one that is compatible with
the last piece of the prefix before it, that is, the two pieces together encode
to themselves.  The ids are recovered from the end backwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from junctura.llm.word_encoding import slices

MARK = "▁"
SLICE_BYTES = 4 << 20
CACHED_CHUNKS = 250_000
CACHED_PAIRS = 700_000
LONG = 64  # longer chunks are not remembered
UNKNOWN = -1

_models: dict[str, "PrefixTable"] = {}


def model(path: str) -> "PrefixTable":
    if path not in _models:
        _models[path] = PrefixTable(path)
    return _models[path]


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, raw[at : at + size]
            at += size


class PrefixTable:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = {n: dict(_fields(v)) for n, v in _fields(sp.serialized_model_proto()) if n in (2, 3)}
        if spec[2].get(3) != 2 or spec[3].get(2) or not spec[3].get(3, 1) or spec[3].get(4, 1) or not spec[3].get(5, 1):
            raise ValueError("only merge-type models with an identity normalizer and a dummy prefix are supported")
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.silent = [sp.is_control(i) for i in range(len(self.pieces))]
        self.byte = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.unknown_id, self.end_id = sp.unk_id(), sp.eos_id()
        self.rank: dict[str, tuple[float, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            if not (self.silent[i] or i in self.byte or i == self.unknown_id):
                self.rank[p] = (sp.get_score(i), i)
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        # no piece has the mark after another character, or a \n: such places are borders
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.rank)
        self.chunks: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[int]:
        """Ids by merging: always the pair of the best score, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                if (found := self.rank.get(parts[i] + parts[i + 1])) and (best is None or found[0] > best):
                    best, at = found[0], i
            if best is None:
                return [self.rank[p][1] if p in self.rank else UNKNOWN for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs = {}
            known = self.pairs[key] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return known

    def encode_chunk(self, text: str) -> list[int]:
        """Ids of a marked text, by the prefix table."""
        n = len(text)
        last, size = [UNKNOWN] * (n + 1), [0] * (n + 1)
        for end, (piece, width) in self.automaton.iter(text):
            to = end + 1
            if not size[to]:
                before = to - width
                if not before:
                    last[to], size[to] = piece, width
                elif (prev := self._last(last, size, before)) == UNKNOWN or self.compatible(prev, piece):
                    last[to], size[to] = piece, width
        ids, at = [], n
        while at:
            if size[at]:
                ids.append(last[at])
                at -= size[at]
            else:  # a character that is no piece: its bytes
                if self.byte_id:
                    ids.extend(self.byte_id[b] for b in reversed(text[at - 1].encode()))
                else:
                    ids.append(self.unknown_id)
                at -= 1
        ids.reverse()
        return ids

    @staticmethod
    def _last(last: list[int], size: list[int], at: int) -> int:
        return last[at] if size[at] else UNKNOWN

    def decode(self, ids: list[int]) -> str:
        """The marked text of ids; control ids are silent, bytes that are no UTF-8 become U+FFFD."""
        out, raw = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(raw):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + width].decode())
                        at += width
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1
            raw.clear()

        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                flush()
            if not self.silent[i]:
                out.append(" ⁇ " if i == self.unknown_id else self.pieces[i])
        if raw:
            flush()
        return "".join(out)

    def chunk(self, text: str) -> tuple[str, int, str]:
        """Ids as text, their number and the decoded text of a chunk."""
        if len(text) > LONG:
            return self._long(text)
        known = self.chunks.get(text)
        if known is None and (known := self.older.get(text)) is not None:
            self.chunks[text] = known
        if known is None:
            ids = self.encode_chunk(text)
            known = self.chunks[text] = (" ".join(map(str, ids)), len(ids), self.decode(ids).replace(MARK, " "))
        return known

    def chunks_of(self, text: str) -> list[str]:
        """The chunks of a text with its dummy prefix."""
        if not text:
            return []
        text = MARK + text.replace(" ", MARK)
        return re.findall(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n", text) if self.by_word else [text]

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks_of(text) for i in self.encode_chunk(c)]

    def digest(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """(ids with the end id, digest of the ids, digest of the decoded text) of each row."""
        if len(self.chunks) > CACHED_CHUNKS:
            self.older, self.chunks = self.chunks, {}
        texts = pc.fill_null(texts, "")
        plain = np.full(len(texts), self.by_word)
        for odd in ("  ", MARK):
            plain &= ~pc.match_substring(texts, odd).to_numpy(zero_copy_only=False)
        plain &= ~pc.starts_with(texts, " ").to_numpy(zero_copy_only=False)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        plain &= (size > 0) & (size <= SLICE_BYTES)
        if not plain.any():
            yield from (self._odd(t) for t in texts.to_pylist())
            return
        split = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(plain)), "\n", " \n"), " ")
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        words = pc.dictionary_encode(split.flatten())
        code = words.indices.to_numpy()
        found = [self._word(w) for w in words.dictionary.to_pylist()]
        id_text, decoded = (np.array([f[k] for f in found], object)[code] for k in (0, 2))
        size = np.concatenate([[0], np.cumsum(np.fromiter((f[1] for f in found), np.int64, len(found))[code])])[at]
        row = 0
        for i, ok in enumerate(plain):
            if ok:
                a, b = at[row], at[row + 1]
                yield self._row(int(size[row + 1] - size[row]), id_text[a:b].tolist(), decoded[a:b].tolist())
                row += 1
            else:
                yield self._odd(texts[i].as_py())

    def _word(self, word: str) -> tuple[str, int, str]:
        if not word.startswith("\n"):
            return self.chunk(MARK + word)
        first, rest = self.chunk("\n"), word[1:]
        if not rest:
            return first
        rest = self.chunk(rest)
        return f"{first[0]} {rest[0]}", first[1] + rest[1], first[2] + rest[2]

    def _odd(self, text: str) -> tuple[int, str, str]:
        ids_sha, text_sha, n, first = hashlib.sha256(), hashlib.sha256(), 0, True
        for part in cut_at_space(text) if self.by_word else [text]:
            for c in self.chunks_of(part):  # the mark in front is the dummy prefix, or the space that was cut
                ids, size, decoded = self.chunk(c)
                ids_sha.update(f"{ids} ".encode())
                text_sha.update((decoded[1:] if first and decoded.startswith(" ") else decoded).encode())
                n, first = n + size, False
        ids_sha.update(str(self.end_id).encode())
        return n + 1, ids_sha.hexdigest(), text_sha.hexdigest()

    def _long(self, text: str) -> tuple[str, int, str]:
        ids = self.encode_chunk(text)
        return " ".join(map(str, ids)), len(ids), self.decode(ids).replace(MARK, " ")

    def _row(self, n: int, ids: list[str], decoded: list[str]) -> tuple[int, str, str]:
        text = "".join(decoded)
        text = text[1:] if text.startswith(" ") else text
        return n + 1, hashlib.sha256(f"{' '.join(ids)} {self.end_id}".encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def cut_at_space(text: str, limit: int = SLICE_BYTES) -> list[str]:
    """Parts between which one single space stood that has no other space or mark beside it."""
    parts, at = [], 0
    while len(text) - at > limit:
        found = re.compile(rf"(?<=[^ {MARK}]) (?=[^ {MARK}])").search(text, at + limit // 2)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.end()
    parts.append(text[at:])
    return parts


def encode_decode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text).

    Null texts are empty (the end id alone); null and repeated ids give a row each; very
    long texts are encoded whole, cut where no piece reaches across; an empty table gives
    no rows; other columns are not read, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model(model_file)
        for batch in batches:
            for first, rows in slices(batch.column("text"), SLICE_BYTES):
                n, ids, text = zip(*table.digest(rows))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(rows)), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

