"""License statements: an exact set-similarity join of text blocks with templates.

Tokens are pairs of neighbouring words, so that scattered words make no statement.
The blocks of a template of L words are all windows of ``L / threshold`` words of
the whole text, across its lines; a block meets the template if it holds
``threshold`` of the template's tokens.

All tokens of the templates are ordered by how often the documents have them, the
rarest first.  A block that meets a template must share one of the template's first
tokens (prefix filter), so only the stretches of text that windows around such a
token cover are looked at.  A stretch must have enough token places (length filter).
From the first token, in the global order, that stretch and template share, both
must have enough tokens left (positional filter).  What passes is counted exactly,
with a window that slides over the stretch.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.license_texts import TEMPLATES
from junctura.llm.word_encoding import slices

# Fixed values of the task: words (in UTF-8, A-Z lower-cased), phrases and labels.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
THRESHOLD = 0.9

Pair = tuple[bytes, bytes]


def pairs_of(words: list[bytes]) -> list[Pair]:
    return list(zip(words, words[1:]))


class Template:
    """A label, the distinct tokens of a statement of two words or more, and its number of words.

    Of a statement of up to eleven words a block must hold all tokens at the usual threshold."""

    def __init__(self, label: str, text: str):
        words = WORD.findall(text.encode().lower())
        if len(words) < 2:
            raise ValueError("a template has two words at least")
        self.label, self.words, self.tokens = label, len(words), frozenset(pairs_of(words))


def templates(given: list[tuple[str, str]] = TEMPLATES) -> list[Template]:
    return [Template(*x) for x in given]


class Places:
    """Finds the tokens of a vocabulary in a list of words."""

    def __init__(self, number: dict[Pair, int]):
        self.number = number
        self.first = frozenset(a for a, _ in number)

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(place, number) of each token in the text, by place."""
        first, number = self.first, self.number
        out = []
        for i, (a, b) in enumerate(zip(words, words[1:])):
            if a in first and (n := number.get((a, b))) is not None:
                out.append((i, n))
        return out


def token_counts(docs: DataFrame, given: list[Template]) -> dict[Pair, int]:
    """How often all documents have each token of the templates; a row for each token comes back."""
    vocabulary = sorted(frozenset().union(*(t.tokens for t in given)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places({p: i for i, p in enumerate(vocabulary)})
        total: Counter = Counter()
        for batch in batches:
            for _, rows in slices(batch.column("text"), 8 << 20):
                for text in rows.to_pylist():
                    total.update(n for _, n in places.find(WORD.findall((text or "").encode().lower())))
        yield pa.RecordBatch.from_pydict({"token": list(total), "n": list(total.values())}, pa.schema([("token", pa.int32()), ("n", pa.int64())]))

    found = docs.select("text").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {vocabulary[r.token]: r.n for r in found}


class Join:
    """The templates' prefix index under a global token order."""

    def __init__(self, given: list[Template], counts: dict[Pair, int], threshold: float = THRESHOLD):
        self.given = given
        rank = {t: i for i, t in enumerate(sorted(counts, key=lambda t: (counts[t], t)))}
        self.places = Places(rank)
        self.span = [int(t.words / threshold + 1e-9) - 1 for t in given]  # token places of a window
        self.need = [max(1, math.ceil(threshold * len(t.tokens) - 1e-9)) for t in given]
        self.order = [sorted(rank[p] for p in t.tokens) for t in given]
        self.own = [frozenset(o) for o in self.order]
        self.index: dict[int, list[int]] = {}
        for k, order in enumerate(self.order):
            for r in order[: len(order) - self.need[k] + 1]:
                self.index.setdefault(r, []).append(k)
        self.pruned = Counter()  # stretches by what became of them

    def stretches(self, found: list[tuple[int, int]], n_places: int) -> Iterator[tuple[int, int, int]]:
        """(template, first and last place) of what the windows around each prefix token cover, overlapping ones as one."""
        held: dict[int, tuple[int, int]] = {}
        for at, r in found:
            for k in self.index.get(r, ()):
                low, high = max(0, at - self.span[k] + 1), min(n_places - 1, at + self.span[k] - 1)
                if k in held and low <= held[k][1]:
                    held[k] = held[k][0], high
                else:
                    if k in held:
                        yield k, *held[k]
                    held[k] = low, high
        for k, (low, high) in held.items():
            yield k, low, high

    def passes(self, k: int, block: list[int], n_places: int) -> bool:
        """Length and positional filter of a stretch with ``block``, its distinct tokens of all templates in order."""
        need, order, own = self.need[k], self.order[k], self.own[k]
        if n_places < need or len(block) < need:
            self.pruned["length"] += 1
            return False
        i = next((i for i, r in enumerate(block) if r in own), len(block))
        j = bisect_left(order, block[i]) if i < len(block) else len(order)
        if min(len(block) - i, len(order) - j) < need:
            self.pruned["position"] += 1
            return False
        self.pruned["verified"] += 1
        return True

    def windows(self, k: int, inside: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """(tokens met, first and last place) of each window that meets the template, at its last token."""
        own, span, need = self.own[k], self.span[k], self.need[k]
        inside = [x for x in inside if x[1] in own]
        held: Counter = Counter()
        left = 0
        for at, r in inside:
            held[r] += 1
            while at - inside[left][0] >= span or held[inside[left][1]] > 1:
                held[inside[left][1]] -= 1
                if not held[inside[left][1]]:
                    del held[inside[left][1]]
                left += 1
            if len(held) >= need:
                yield len(held), inside[left][0], at

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, float, int, int]]:
        """(template, containment, first and last word) of every block of the text that meets a template."""
        found = self.places.find(words)
        if not any(r in self.index for _, r in found):
            return
        at = [p for p, _ in found]
        for k, low, high in self.stretches(found, len(words) - 1):
            inside = found[bisect_left(at, low) : bisect_right(at, high)]
            if self.passes(k, sorted({r for _, r in inside}), high - low + 1):
                for n, a, b in self.windows(k, inside):
                    yield k, n / len(self.order[k]), a, b + 1


def scan(docs: DataFrame, given: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Base phrases, labels and score of every row of ``docs`` (doc_id, text).

    ``labels`` has the labels of all templates that a block of the text meets and the
    base ones.  ``score`` is the best containment, 1 where a base phrase stands; 0
    without either.  ``n_blocks`` counts the blocks found, those that overlap as one.
    A null or empty text has no words and no labels; texts are read whole, each row on
    its own, repeated ones too.  An empty table gives no rows; other columns of ``docs``
    are not read, whatever their names."""
    sets = templates(given)
    counts = token_counts(docs, sets)
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]

    def one(text: str | None, join: Join) -> tuple:
        words = WORD.findall((text or "").encode().lower())
        vocabulary = set(words)
        base, labels, score, blocks = [], set(), 0.0, 0
        for phrase, label in phrases:
            if vocabulary.issuperset(phrase):
                at, n = -1, len(phrase)
                while True:
                    try:
                        at = words.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if words[at : at + n] == phrase:
                        base.append(at)
                        labels.add(label)
        base_labels = ",".join(sorted(labels))
        if base:
            score = 1.0
        end = -1
        for k, part, first, last in sorted(join.matches(words), key=lambda x: x[2:]):
            labels.add(join.given[k].label)
            score = max(score, part)
            blocks += first > end
            end = max(end, last)
        return len(words), len(base), min(base, default=None), max(base, default=None), base_labels, ",".join(sorted(labels)), score, blocks

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = Join(sets, counts, threshold)
        for batch in batches:
            for first, rows in slices(batch.column("text"), 8 << 20):
                cols = zip(*(one(t, join) for t in rows.to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(rows)), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long")
