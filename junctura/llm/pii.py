"""Personal data: patterns propose spans, validators confirm them, context scores them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from junctura.llm import storage
from junctura.llm.word_encoding import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
ORDER = {k: i for i, k in enumerate(KINDS)}
THRESHOLD = 0.5
CONTEXT = 48  # characters on either side

# What a span of a kind scores before and after its validator, and
# the words beside it that make it likelier or less likely.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
WORDS = {
    "email": ({"mail", "mails", "email", "contact", "write"}, set()),
    "ip": ({"ip", "ipv4", "address", "host", "server"}, {"version", "release"}),
    "card": ({"card", "cards", "visa", "mastercard", "credit", "debit", "payment"}, {"isbn", "order", "tracking"}),
    "phone": ({"phone", "phones", "telephone", "tel", "call", "mobile", "cell", "fax"}, set()),
    "iban": ({"iban", "bank", "account", "konto", "transfer"}, {"serial", "part"}),
    "ssn": ({"ssn", "social", "security", "taxpayer"}, {"phone", "part", "serial"}),
}
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run is entered at its start only: where that fails, its tails fail too
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3}(?![A-Za-z0-9]))?")
NAME = re.compile(r"[^\W_]+")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    iban = iban.replace(" ", "")
    if IBAN_LENGTHS.get(iban[:2], len(iban)) != len(iban):
        return False
    rest = 0
    for c in iban[4:] + iban[:4]:
        n = int(c, 36)
        rest = (rest * (100 if n > 9 else 10) + n) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: linear in the text."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        floor = found.end() if found else at + 1
        if found:
            yield start, floor
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers, cut to their country's length; those of countries that are not listed as long as they stand.

    The pattern takes what looks like groups of one, a following word too; the length
    says where the number ends, and no letter or digit may follow there."""
    at = 0
    while m := IBAN.search(text, at):
        at = m.start() + 1
        n, end = IBAN_LENGTHS.get(m[1]), m.end()
        if n:
            end = m.start()
            while n and end < m.end():
                n -= text[end] != " "
                end += 1
            if n:
                continue
        if not (end < len(text) and text[end].isascii() and text[end].isalnum()) and mod97(text[m.start() : end]):
            yield m.start(), end
            at = end


def nearby(text: str, start: int, end: int) -> set[str]:
    """The whole words within CONTEXT characters of a span, in lower case; a word cut off at the border counts whole."""
    a, b = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    while a > max(0, start - 2 * CONTEXT) and text[a - 1].isalnum():
        a -= 1
    while b < min(len(text), end + 2 * CONTEXT) and text[b].isalnum():
        b += 1
    return {w.lower() for part in (text[a:start], text[end:b]) for w in NAME.findall(part)}


def score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    """0 to 1: the kind's prior, more for a checksum that holds, and the words nearby."""
    near = nearby(text, start, end)
    yes, no = WORDS[kind]
    value = PRIOR[kind] + 0.2 * confirmed + 0.2 * (not near.isdisjoint(yes)) - 0.3 * (not near.isdisjoint(no))
    return round(min(1.0, max(0.0, value)), 3)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by start, then kind.

    Base spans are always there; others from ``THRESHOLD`` on."""
    text = text or ""
    out = [(k, a, b, score(text, k, a, b, k == "card")) for k, a, b in base_spans(text)]
    for a, b in ibans(text):
        if (s := score(text, "iban", a, b, True)) >= THRESHOLD:
            out.append(("iban", a, b, s))
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" and (s := score(text, "ssn", *m.span(), False)) >= THRESHOLD:
            out.append(("ssn", *m.span(), s))
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]], x[2]))


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b, _ in find(text):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def detect(docs: DataFrame) -> DataFrame:
    """Counts, spans and their scores of every row of ``docs`` (doc_id, text).

    A null or empty text has no spans and a null ``top_score``.  Each row is searched
    on its own, repeated ones too, the whole text however long; an empty table gives no
    rows.  Other columns of ``docs`` are not read, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in slices(batch.column("text"), 8 << 20):
                found = [find(t) for t in rows.to_pylist()]
                base = [[s for s in f if s[0] in BASE] for f in found]
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE]
                sha = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base])
                top = pa.array([max((s[3] for s in f), default=None) for f in found], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(rows)), *counts, sha, pa.array([_joined(f) for f in found]), top, pa.array([[s[3] for s in f] for f in found], pa.list_(pa.float64()))], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "top_score", "scores"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double, scores array<double>")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced, and ``n_chars`` (if there) counted anew.

    All other columns, ids among them, are passed on as they came, whatever their names
    and types.  A null text stays null, an empty table stays empty; repeated rows are
    changed alike."""
    held = storage.narrowed(docs, "text", "n_chars")
    names = held.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in slices(batch.column("text"), 8 << 20):
                part = batch.slice(first, len(rows))
                texts = [redact(t) for t in rows.to_pylist()]
                new = {n: part.column(n) for n in names}
                new["text"] = pa.array(texts, rows.type)
                if "n_chars" in names:
                    new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(new.values()), list(new))

    return storage.widened(held.mapInArrow(run, held.schema), docs.columns, "text", "n_chars")
