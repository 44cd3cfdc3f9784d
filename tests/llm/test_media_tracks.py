"""Containers with more than what ``build`` writes."""

import hashlib
import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from junctura.llm import iso_media


def test_tracks_and_fragments(spark):
    one = iso_media.build(bytes(range(64)) * 3)
    (a, b), = [(a - 8, b) for path, a, b in iso_media.walk(one) if path == (b"moov", b"trak")]
    grown, at = b - a, one.index(b"moov") - 4
    trak = bytearray(one[a:b])
    spot = trak.index(b"stco") + 12
    offset = struct.unpack_from(">I", trak, spot)[0] + grown
    struct.pack_into(">I", trak, spot, offset)
    size = struct.unpack_from(">I", one, at)[0] + grown
    two = one[:at] + struct.pack(">I", size) + one[at + 4 : a] + bytes(trak) * 2 + one[b:]
    rows = [(1, 192, one), (2, 192, two), (3, 192, one + iso_media.box(b"moof", iso_media.box(b"traf")))]
    got = {r.doc_id: r for r in iso_media.features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1].error is None and got[1].codec == "raw" and got[1].payload_bytes == 192
    assert got[2].error is None and got[2].codec == "raw, raw" and got[2].payload_bytes == 384 and got[2].feature.count("keyframes") == 2
    assert "moof" in got[3].error and got[3].payload_bytes is None


def test_compact_sizes():
    def stz2(bits, n, table):
        stbl = iso_media.box(b"stbl", iso_media.full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)), iso_media.full(b"stz2", bytes([0, 0, 0, bits]), struct.pack(">I", n), table), iso_media.full(b"stco", struct.pack(">II", 1, 500)))
        return iso_media.box(b"moov", iso_media.box(b"trak", iso_media.box(b"mdia", iso_media.box(b"minf", stbl))))

    for bits, table in ((4, bytes([0x12, 0x30])), (8, bytes([1, 2, 3])), (16, struct.pack(">3H", 1, 2, 3))):
        (track,) = iso_media.tracks(stz2(bits, 3, table))
        assert track.sizes.tolist() == [1, 2, 3] and track.offsets.tolist() == [500, 501, 503]


def test_deep_boxes():
    data = b""
    for _ in range(5000):
        data = iso_media.box(b"moov", data)
    assert sum(1 for _ in iso_media.walk(data)) == 5000 and iso_media.tracks(data) == []


WHOLE = iso_media.build(bytes(range(256)) * 40)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, len(WHOLE) - 1), st.integers(0, 255)), max_size=6), st.integers(0, len(WHOLE)), st.integers(0, 700))
def test_no_bytes_crash(changes, cut, at):
    head = WHOLE.index(b"mdat")
    data = bytearray(WHOLE)
    for where, value in changes:
        data[where % head] = value  # the boxes and tables
    for given_bytes in (bytes(data), bytes(data[:cut]), bytes(data[at:])):
        try:
            for track in iso_media.tracks(given_bytes):
                iso_media.payload(given_bytes, track)
                iso_media.describe(track)
                track.key_ranges()
        except iso_media.Broken:
            pass


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300))
def test_any_bytes(data):
    try:
        iso_media.tracks(data)
    except iso_media.Broken:
        pass


def test_bad_tables(spark):
    def changed(kind, skip, value):
        data = bytearray(WHOLE)
        struct.pack_into(">I", data, data.index(kind) + skip, value)
        return bytes(data)

    cases = {
        1: changed(b"mdhd", 16, 0), 2: changed(b"stss", 12, 10**6), 3: changed(b"stsz", 12, 2**32 - 1), 4: changed(b"stco", 12, 2**31),
        5: changed(b"stsc", 12, 7), 6: changed(b"stss", 12, 0), 7: changed(b"stsz", 8, 2**31), 8: WHOLE[:100], 9: b"", 10: None,
    }
    frame = spark.createDataFrame([(k, 1, v) for k, v in cases.items()], "doc_id long, n_bytes long, media binary")
    rows = {r.doc_id: r for r in iso_media.features(frame).collect()}
    assert len(rows) == len(cases) and all(r.error and r.payload_bytes is None and r.keyframes is None for r in rows.values())


def test_query_against_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in iso_media.media_columns(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        body = raw + bytes(max(64, (len(raw) + 63) // 64 * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(body))
        assert r.payload_sha256 == hashlib.sha256(body).hexdigest() and r.tail_crc32 == zlib.crc32(body[-64:])
        whole = iso_media.build(body)
        assert r.media_bytes == len(whole) and r.media_sha256 == hashlib.sha256(whole).hexdigest()
        first = whole.index(b"mdat") + 4
        assert [(k.track, k.start, k.stop) for k in r.keyframes] == [(0, first + 64 * k, first + 64 * k + 64) for k in range(0, len(body) // 64, 32)]
