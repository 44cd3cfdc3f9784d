"""op11 against whole-text encodings aligned byte by byte."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from junctura.llm import queries, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    """Whole texts, one after another; offsets from the libraries' own pieces."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = token_alignment.byte_alphabet()
    docs = []
    for doc_id, text in rows:
        ids_a, ids_b, whole = [], [], f" {text}".encode()
        if text:
            e = a.encode(f" {text}", add_special_tokens=False)
            ids_a, ids_b = e.ids, b.encode(text)
            bytes_a = [bytes(letters[c] for c in t) for t in e.tokens]
            bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
            if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
                ids_a, ids_b = [], []
        links, groups, start, i, j, at_a, at_b = [], [], (0, 0), 0, 0, 0, 0
        while i < len(ids_a) and j < len(ids_b):
            links.append((ids_a[i], ids_b[j]))
            end_a, end_b = at_a + len(bytes_a[i]), at_b + len(bytes_b[j])
            if end_a <= end_b:
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                j, at_b = j + 1, end_b
            if at_a == at_b:
                groups.append(f"{','.join(map(str, ids_a[start[0] : i]))}|{','.join(map(str, ids_b[start[1] : j]))}")
                start = i, j
        docs.append((doc_id, len(ids_a), len(ids_b), groups, links))
    count = Counter(x for d in docs for x in d[4])
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [
        (d, n_a, n_b, len(g), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, n_a, n_b, g, links in docs
    ]


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def test_query_against_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_segment_alignment"](spark, sf).collect()]
    assert sorted(got) == sorted(plain(docs))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 300)
    monkeypatch.setattr(token_alignment, "LIST_ROWS", 7)
    rows = [(1, None), (2, ""), (3, " "), (4, "  "), (None, "a b"), (5, "a b"), (5, "a b"), (6, "x\n\n y\r\n z\t"), (7, "has ▁ mark"), (8, "<|endoftext|> <s></s>"), (9, "nbsp  x　y \u0085\x1c q"),
            (10, "word " * 3000), (11, "é😀\x00" * 500), (12, "tail   "), (13, "\n"), (9007199254740993, "big id")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, segments string, block int").repartition(3)
    got = [tuple(r[c] for c in COLUMNS) for r in token_alignment.align_documents(docs, A, B).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    assert token_alignment.align_documents(docs.limit(0), A, B).collect() == []


def test_a_held_segment_counts_over_batches(spark):
    """Equal segments of many blocks meet in batches of two rows."""
    rows = [(i, "same words here") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        x = token_alignment.alignment(docs, A, B)
        got = [tuple(r[c] for c in COLUMNS) for r in x.documents().collect()]
        assert x.segments().count() == 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(got) == sorted(plain(rows))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list("ab'st .,}\n\t\r\v\x0c  　\x1c\x85é1<|>")), st.characters(exclude_categories=["Cs"])), min_size=1))
def test_segments_encode_as_in_the_text(text):
    pair = token_alignment.token_pair(A, B)
    segments = pair.segments(text)
    if "▁" in text:
        assert segments == []
        return
    a, b = pair.ids(segments)
    assert "".join(segments) == f" {text}"
    assert sum(a, []) == pair.a.encode(f" {text}", add_special_tokens=False).ids
    assert sum(b, []) == pair.b.encode(text)


def test_other_kinds_of_files_are_refused():
    with pytest.raises(Exception):
        token_alignment.TokenPair(public_tokenizers.path("piece_bpe_32k.model"), B)
