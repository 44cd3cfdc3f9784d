"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing names."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from junctura.llm import html_wrapper, iso_media, licenses, line_dedup, ngram_join, packing, pii, prefix_table, quality, wavelet

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, k int, h1 string, __bin string, key int, part int, n int, stratum string, kept int, start int"
LINE = "this very long line stands in many of the documents of this table"
PROSE = " ".join(f"word{i} and{i % 7} other{i % 11}" for i in range(60))


def _rows():
    texts = [None, "", " ", "\n\n", "one", "two words", PROSE, PROSE, PROSE + " tail", f"{LINE}\nown {PROSE}", f"  {LINE.upper()} \n x", f"{LINE}", f"{LINE}\n{LINE}", f"a\n{LINE}\t", "x" * 300_000, "no break " * 30_000, "mail a@b.co, card 4111 1111 1111 1111", "日本語 \u0000 🙂 é", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."]
    return [(i, t, [None, "en", "de"][i % 3], None if i % 2 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = _rows()
    rows += [rows[6], (7, "another text with the id of one before", None, None, 1), (None, LINE, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, "a", 1, "b", "c", 2, 3, 4, "d", 5, 6) for r in rows], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (6, 1, 0), (9, 0, None), (None, 1, 1), (8, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_wavelet(docs, empty):
    tok = Tokenizer.from_file(WORD)
    want = sorted((-1 if i is None else i, zlib.crc32(np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes())) for i, t in pairs(docs))
    got = wavelet.wavelet_tokens(docs, WORD, shard_tokens=5000).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    assert [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1].tolist()]
    assert wavelet.wavelet_tokens(empty, WORD).count() == 0


def test_pieces(docs, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = []
    for i, t in pairs(docs):
        ids = [*sp.encode(t), 2]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in prefix_table.encode_decode(docs, PIECE).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert prefix_table.encode_decode(empty, PIECE).count() == 0


def test_packing(docs, empty):
    tok = Tokenizer.from_file(WORD)
    pieces = packing.pack(docs, WORD, open_windows=3).collect()
    total = sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in pairs(docs))
    assert sum(p.length for p in pieces) == total
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for window in by.values():
        at = 0
        for p in sorted(window, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack(empty, WORD).count() == 0


def test_quality(docs, labels, empty):
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert not any(r.kept for r in got if r.n_words < 50)
    assert all(r.kept for r in got if r.doc_id == 6)
    assert quality.quality(empty, labels).count() == 0
    assert quality.quality(docs, labels.limit(0)).where("kept").count() > 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_media(docs, empty):
    for r in iso_media.media_columns(docs).collect():
        assert r.error is None and r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes)
    assert iso_media.media_columns(empty).count() == 0
    broken = docs.limit(1).select("doc_id", F.lit(1).cast("long").alias("n_bytes"), F.lit(b"\0\0\0\x40moov").alias("media"))
    assert iso_media.features(broken).collect()[0].error
    assert iso_media.features(broken.withColumn("media", F.lit(None).cast("binary"))).collect()[0].error


def test_pii(docs, empty):
    got = pii.detect(docs).collect()
    assert len(got) == docs.count()
    assert [(r.n_email, r.n_card) for r in got if r.doc_id == 16] == [(1, 1)]
    assert pii.redacted(docs).columns == docs.columns
    assert pii.redacted(docs).where("doc_id = 16").collect()[0].text == "mail [EMAIL], card [CARD]"
    assert pii.detect(empty).count() == pii.redacted(empty).count() == 0


def test_lines(docs, empty):
    got = {}
    for r in line_dedup.line_dedup(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_lines, r.n_dropped, r.kept_sha256))
    # five documents (9 to 13) hold the line; 13 keeps it, a row without an id loses it
    assert [got[i][0][:2] for i in (9, 10, 11, 12, 13)] == [(2, 1), (2, 1), (1, 1), (2, 2), (2, 0)]
    assert sorted(x[1] for x in got[None]) == [0, 1]
    assert got[0][0] == (1, 0, hashlib.sha256(b"").hexdigest())
    assert len(got[6]) == 2
    assert line_dedup.deduped(docs).columns == docs.columns
    assert line_dedup.line_dedup(empty).count() == 0


def test_join(docs, empty):
    got = {r.doc_id: r for r in ngram_join.ngram_join(docs.where("doc_id <> 7 OR doc_id IS NULL")).collect()}
    assert got[6].class_id == got[8].class_id == 6
    assert got[6].n_copies == 2 and got[6].n_links == 2 and got[9].class_id == 6
    assert got[0].class_id == 0 and got[0].n_links == 0
    kept = ngram_join.one_of_each(docs)
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and 8 not in ids and 6 in ids
    assert ngram_join.ngram_join(empty).count() == 0


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[18].base_labels == "cc-by" and got[18].labels == "cc-by,cc-by-nc,mit" and got[18].first_word == 2 and got[18].score == 1
    assert got[0].n_words == 0 and got[0].first_word is None and got[0].labels == "" and got[0].score == 0
    assert licenses.scan(empty).count() == 0


def test_pages(spark):
    html = "<html><body><nav>m</nav><article><h1>A &amp; b</h1><p>x\n y<p>z</article><aside>s</aside></body></html>"
    rows = [(1, "http://h.org/a", html), (2, "http://h.org/b", None), (3, None, ""), (4, "::bad", html), (None, "http://h.org/c", html), (1, "http://h.org/a", html), (5, "http://h.org/d", "<p>" * 20_000), (6, "http://[x", "plain text")]
    got = html_wrapper.extract(spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, url string, html string, host string, key int")).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[4] == texts[None] == "A & b\nx y\nz" and texts[2] == texts[3] == texts[5] == "" and texts[6] == "plain text"
    assert html_wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


BIG = (1 << 53) + 1


def test_large_ids(spark):
    """Ids above 2**53 beside nulls come back as they are, from every query and stage."""
    rows = [(BIG + 2 * k, t, "en", None, None) for k, t in enumerate([PROSE, PROSE + " end", f"{LINE}\nmine", None, "mail a@b.co", f"{LINE}\nyours"])]
    rows += [(None, PROSE, None, "s", 7), (None, None, None, None, None), (BIG, PROSE, "en", None, None), (BIG, "another text", None, None, BIG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    labels = spark.createDataFrame([(BIG, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    want = sorted(str(r[0]) for r in rows)
    every = {
        "op1": wavelet.wavelet_tokens(docs, WORD), "op2": prefix_table.encode_decode(docs, PIECE), "op4": packing.pack(docs, WORD), "op5": licenses.scan(docs),
        "op6": quality.quality(docs, labels), "op7": iso_media.media_columns(docs), "op8": pii.detect(docs), "op8r": pii.redacted(docs), "op9": ngram_join.ngram_join(docs), "op10": line_dedup.line_dedup(docs), "op10d": line_dedup.deduped(docs),
    }
    for name, got in every.items():
        assert sorted(str(r.doc_id) for r in got.collect()) == want, name
    assert {r.n_chars for r in pii.redacted(docs.where("text IS NULL")).collect()} == {None}
    kept = [r.doc_id for r in ngram_join.one_of_each(docs).collect()]
    assert {x for x in kept if x} <= {r[0] for r in rows}
    pages = spark.createDataFrame([(BIG, "http://h/a", "<p>x"), (None, None, None)], "page_id long, url string, html string")
    assert {r.page_id for r in html_wrapper.extract(pages).collect()} == {BIG, None}


def test_pieces_against_library(docs):
    """Where each piece starts, its checksum and its document's tokens, against the library's ids."""
    tok = Tokenizer.from_file(WORD)
    want = {}
    for i, t in pairs(docs):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(i, []).append(ids)
    for p in packing.pack(docs, WORD, open_windows=3).collect():
        assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in want[p.doc_id])


def test_pii_context_and_length():
    assert [s[:3] for s in pii.find("ES9121000418450200051332 EUR")] == [("iban", 0, 24)]
    assert [s[:3] for s in pii.find("ES91 2100 0418 4502 0005 1332 TO")] == [("iban", 0, 29)]
    assert [s[0] for s in pii.find("Party of 123-45-6789 social")] == ["ssn"]
    assert pii.find("hotel ship partly 123-45-6789") == [] and pii.find("DE89370400440532013000x") == []


def test_other_tokenizers_are_refused(tmp_path):
    from junctura.llm import word_encoding

    with open(WORD, encoding="utf-8") as f:
        given = f.read()
    other = tmp_path / "other.json"
    other.write_text(given.replace('"Lowercase"', '"NFKC"'), encoding="utf-8")
    with pytest.raises(ValueError):
        word_encoding.WordEncoder(str(other))
    word_encoding.check_kind(WORD)


def test_a_change_writes_no_more_in_a_larger_corpus(spark):
    """Bytes that one deletion and one insertion write do not grow with the corpus, and the index stays right."""
    import os

    def size(folder):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder.removeprefix("file://")) for f in names)

    written = []
    for n in (300, 3000):
        text = lambda i: "\n".join(f"line number {(i * 7 + k) % (n // 6)} of a text that is long enough to be a key" for k in range(6))  # noqa: B023, E731
        docs = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string")
        index = line_dedup.LineIndex(spark)
        index.insert(docs)
        before = size(index.folder)
        index.delete(spark.createDataFrame([(n - 1,)], "doc_id long"))
        index.insert(spark.createDataFrame([(n + 5, text(3))], "doc_id long, text string"))
        written.append(size(index.folder) - before)
        left = docs.where(f"doc_id <> {n - 1}").unionByName(spark.createDataFrame([(n + 5, text(3))], "doc_id long, text string"))
        fresh = line_dedup.LineIndex(spark)
        fresh.insert(left)
        key = lambda x: sorted(map(tuple, x.collect()))
        assert key(index.counts) == key(fresh.counts) and key(index.hot()) == key(fresh.hot())
        index.compact()
        assert key(index.counts) == key(fresh.counts) and index.n_hot == fresh.n_hot == fresh.hot().count()
        assert key(index.dedup(left)) == key(fresh.dedup(left))
    assert written[1] < 1.5 * written[0]
