"""Whole-text encoding with a word-level BPE of the tokenizers library.

Pre-tokens never cross white space, so a text's ids are the ids of its words in
order.  Arrow splits a slice's texts and numbers the distinct words, the library
encodes each of those once, and numpy gathers the ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
SLICE_BYTES = 6 << 20
CACHED_WORDS = 250_000
LONG = 64  # longer words are not remembered

# Characters outside those whose lower case and normal form C are one
# to one in every library; what the tokenizer's own split pattern cuts off from
# the letters beside it, within the plain characters.
NOT_PLAIN = r"[^!-~À-ÖØ-öø-įı-ňŊ-ž \n]"
BORDERED = r"('s|'t|'re|'ve|'m|'ll|'d|[!-/:-@\[-`{-~]+|[0-9])"

_encoders: dict[str, "WordEncoder"] = {}


def encoder(path: str) -> "WordEncoder":
    """This worker's encoder for the tokenizer file; its caches outlive a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of consecutive slices of at most ``limit`` bytes, or one row."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def cut_at_space(text: str, limit: int) -> list[str]:
    """Parts of at most about ``limit`` characters that end where a space or \\n was."""
    parts, at = [], 0
    while len(text) - at > limit:
        to = max(text.rfind(" ", at + 1, at + limit), text.rfind("\n", at + 1, at + limit))
        if to < 0:
            found = [x for x in (text.find(" ", at + limit), text.find("\n", at + limit)) if x >= 0]
            if not found:
                break
            to = min(found)
        parts.append(text[at:to])
        at = to + 1
    parts.append(text[at:])
    return parts


# How a tokenizer normalizes and splits for which this module is exact.
NORMALIZERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
SPLITTERS = [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), ("ByteLevel", None)]


def check_kind(path: str) -> None:
    """Refuse a tokenizer file for which this module's ids would not be the library's."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    steps = lambda x, name: [(y["type"], (y.get("pattern") or {}).get("Regex")) for y in (x or {}).get(name, [])]
    model = given["model"]
    found = steps(given.get("normalizer"), "normalizers"), steps(given.get("pre_tokenizer"), "pretokenizers"), model.get("type"), model.get("end_of_word_suffix"), model.get("dropout")
    if found != (NORMALIZERS, SPLITTERS, "BPE", "</w>", None):
        raise ValueError(f"{path}: not a tokenizer that can be encoded word by word")


class WordEncoder:
    """Rows are encoded in three ways with the same result: plain ones by pre-token,
    others by word, and those with a special token's text by the library as a whole."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        check_kind(path)
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.library.get_vocab_size() + 1, bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cached = cached
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in row order, and how many each row has (null: none)."""
        texts = pc.fill_null(texts, "")
        if len(texts) == 1 and len(whole := texts[0].as_py()) > SLICE_BYTES and not any(t in whole for t in self.special):
            parts = [self._by_kind(pa.array([p]))[0] for p in cut_at_space(whole, SLICE_BYTES)]
            return np.concatenate(parts), np.array([sum(map(len, parts))], np.int64)
        return self._by_kind(texts)

    def _by_kind(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        special = np.zeros(len(texts), bool)
        for token in self.special:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        plain = ~pc.match_substring_regex(texts, NOT_PLAIN).to_numpy(zero_copy_only=False)
        groups = [(np.flatnonzero(m), f) for m, f in ((plain & ~special, self._pretokens), (~plain & ~special, self._words), (special, self._whole)) if m.any()]
        if len(groups) == 1:
            return groups[0][1](texts)
        sizes, got = np.zeros(len(texts), np.int64), []
        for rows, f in groups:
            ids, n = f(texts.take(pa.array(rows)))
            sizes[rows] = n
            got.append((rows, ids, n))
        start = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        for rows, ids, n in got:
            out[np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, sizes

    def _pretokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.replace_substring(pc.utf8_lower(texts), "\n", " ")
        return self._gather(pc.replace_substring_regex(texts, BORDERED, r" \1 "), self._joined)

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._gather(pc.replace_substring(texts, "\n", " "), self._alone)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]
        return np.concatenate(ids), np.array(list(map(len, ids)), np.int64)

    def _gather(self, texts: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(texts, " ")
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        words = pc.dictionary_encode(split.flatten())
        code = words.indices.to_numpy()
        found = self._ids_of(words.dictionary.to_pylist(), encode)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table = np.frombuffer(b"".join(found), "<u4")
        first = np.cumsum(size) - size
        each = size[code]
        to = np.concatenate([[0], np.cumsum(each)])
        ids = table[np.repeat(first[code] - to[:-1], each) + np.arange(to[-1])]
        return ids, np.diff(to[at])

    def _ids_of(self, words: list[str], encode) -> list[bytes]:
        """Each word's ids as bytes.  Of two generations of known words, the older goes."""
        if len(self.known) > self.cached:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    missing.append(w)
        for i in range(0, len(missing), 8192):
            encode(missing[i : i + 8192])
        found = [known[w] for w in words]
        for w in missing:
            if len(w) > LONG:
                del known[w]
        return found

    def _joined(self, words: list[str]) -> None:
        """Pre-tokens encode alike alone and with others; each ends with a word-end id."""
        words = [w for w in words if w]
        self.known[""] = b""
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(words):
            return self._alone(words)
        raw, at = ids.tobytes(), 0
        for w, to in zip(words, (4 * stop).tolist()):
            self.known[w] = raw[at:to]
            at = to

    def _alone(self, words: list[str]) -> None:
        for w, e in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False)):
            self.known[w] = np.array(e.ids, "<u4").tobytes()


def with_end(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Append END_ID to each row's ids."""
    to = np.cumsum(sizes)
    return np.insert(ids, to, np.uint32(END_ID)), sizes + 1
