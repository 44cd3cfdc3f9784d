import gzip
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from junctura.functions import nbglm, sequence
from junctura.operators import graph, intervals, reads
from junctura.sources import alignments, annotation, fasta, sinks

GTF = """# made by hand
c1\tsim\tgene\t101\t400\t.\t+\t.\tgene_id "g1"; gene_name "G one"; gene_type "coding";
c1\tsim\texon\t101\t200\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c1\tsim\texon\t301\t400\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c2\tsim\tgene\t1\t90\t.\t-\t.\tgene_id "g2";
c2\tsim\texon\t51\t90\t.\t-\t.\tgene_id "g2"; transcript_id "t2";
c2\tsim\texon\t1\t20\t.\t-\t.\tgene_id "g2"; transcript_id "t2";
c2\tsim\tgene\t500\t600\t.\t-\t.\tgene_id "empty";
"""
GFF = """##gff-version 3
c1\tsim\tgene\t101\t400\t.\t+\t.\tID=g1;Name=G1
c1\tsim\tmRNA\t101\t400\t.\t+\t.\tID=t1;Parent=g1
c1\tsim\texon\t101\t200\t.\t+\t.\tID=e1;Parent=t1
c1\tsim\texon\t301\t400\t.\t+\t.\tParent=t1
c1\tsim\tchromosome\t1\t900\t.\t+\t.\tID=c1
"""
READS = [
    ("50M", 0, 0, None), ("20M100N30M", 0, 0, "+"), ("5M100N45M", 0, 0, "-"), ("20M2D30M", 0, 0, None),
    ("10S20M3I20M", 0, 0, None), ("50M", 0, 1, None), ("50M", 256, 0, None), ("20M100N30M", 0, 0, "-"), ("50M", 4, 0, None),
]


def test_gtf(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    genes, exons = annotation.read_gtf(spark, str(tmp_path / "a.gtf"))
    assert {(r.gene_id, r.g_start, r.g_end, r.strand, r.gene_type) for r in genes.collect()} == {("g1", 100, 400, "+", "coding"), ("g2", 0, 90, "-", None)}
    assert [tuple(r) for r in graph.edges(exons).orderBy("gene_id").collect()] == [("g1", 100, 200, 300, 400), ("g2", 0, 20, 50, 90)]
    genes, exons = annotation.checked(genes, exons, drop_overlapping_genes=True, drop_shared_exons=True, drop_overlapping_exons=True)
    assert genes.count() == 2


def test_gff3(spark, tmp_path):
    (tmp_path / "a.gff3").write_text(GFF)
    genes, exons = annotation.read_gff3(spark, str(tmp_path / "a.gff3"))
    assert [(r.gene_id, r.gene_symbol, r.g_start) for r in genes.collect()] == [("g1", "G1", 100)]
    assert exons.count() == 2


def test_fasta(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 first\nACGT\nAC\n>c2\nTTTT\n")
    assert {tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "g.fa")).collect()} == {("c1", "ACGTAC"), ("c2", "TTTT")}


def frame(spark):
    return spark.createDataFrame([("s", "c", 100, flag, c, nm, xs, None, None) for c, flag, nm, xs in READS], alignments.SCHEMA)


def test_filter(spark):
    df = frame(spark)
    kept = df.where(reads.passes(reads.ReadFilter(8, 0, 2))).select("cigar", "xs").collect()
    assert [tuple(r) for r in kept] == [("50M", None), ("20M100N30M", "+"), ("20M2D30M", None), ("10S20M3I20M", None), ("20M100N30M", "-")]
    assert df.where(reads.passes(None)).count() == 7
    assert df.where(reads.passes(None, strand=F.lit("+"))).count() == 5
    assert reads.ReadFilter.preset(3, 50) == reads.ReadFilter(13, 0, 2)


def test_junctions_and_coverage(spark):
    df = frame(spark).where(reads.passes(None))
    got = {(r.strand, r.i_start, r.i_end, r.n) for r in reads.junctions(df).collect()}
    assert got == {("+", 120, 220, 1), ("-", 120, 220, 1), ("-", 105, 205, 1)}
    depth = np.zeros(400, int)
    for row in df.collect():
        for b in row_blocks(row.pos, row.cigar):
            depth[b[0] : b[1]] += 1
    for r in reads.coverage(df).collect():
        assert (depth[r.run_start : r.run_end] == r.depth).all()
        depth[r.run_start : r.run_end] = 0
    assert not depth.any()


def row_blocks(pos, text):
    import re

    for n, op in re.findall(r"(\d+)(.)", text):
        if op in "MD=X":
            yield pos, pos + int(n)
        if op in "MDN=X":
            pos += int(n)


def test_sam_and_bam(spark, tmp_path):
    sam = "@SQ\tSN:c\tLN:1000\n" + "".join(f"r{i}\t{flag}\tc\t101\t60\t{c}\t*\t0\t0\t*\t*\tNM:i:{nm}" + (f"\tXS:A:{xs}" if xs else "") + "\n" for i, (c, flag, nm, xs) in enumerate(READS))
    (tmp_path / "s.sam").write_text(sam)
    want = sorted(map(repr, frame(spark).collect()))
    assert sorted(map(repr, alignments.read_sam(spark, str(tmp_path / "s.sam")).collect())) == want
    assert [tuple(r) for r in alignments.sam_contigs(spark, str(tmp_path / "s.sam")).collect()] == [("c", 1000)]
    import re

    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 1000)
    for c, flag, nm, xs in READS:
        ops = [(int(n) << 4) | alignments.OPS.index(op) for n, op in re.findall(r"(\d+)(.)", c)]
        rec = struct.pack("<iiBBHHHiiii", 0, 100, 2, 60, 0, len(ops), flag, 0, -1, -1, 0) + b"r\0" + struct.pack(f"<{len(ops)}I", *ops) + b"NMC" + bytes([nm]) + (b"XSA" + xs.encode() if xs else b"")
        body += struct.pack("<i", len(rec)) + rec
    out = bgzf([body[:100], body[100:], b""])
    assert gzip.decompress(out) == body
    (tmp_path / "s.bam").write_bytes(out)
    assert sorted(map(repr, alignments.read_bam(spark, [str(tmp_path / "s.bam")]).collect())) == want


def bgzf(parts):
    out = b""
    for part in parts:
        co = zlib.compressobj(wbits=-15)
        raw = co.compress(part) + co.flush()
        out += struct.pack("<BBBBIBBH", 31, 139, 8, 4, 0, 0, 255, 6) + b"BC" + struct.pack("<HH", 2, len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam_splits(tmp_path):
    rng = np.random.default_rng(6)
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 100_000)
    for k in range(3000):
        name, seq = f"read{k}".encode() + b"\0", bytes(rng.integers(0, 256, 25, dtype=np.uint8)) + bytes(rng.integers(0, 40, 50, dtype=np.uint8))
        rec = struct.pack("<iiBBHHHiiii", 0, k, len(name), 60, 0, 1, 0, 50, -1, -1, 0) + name + struct.pack("<I", 50 << 4) + seq + b"NMC\0"
        body += struct.pack("<i", len(rec)) + rec
    raw = bgzf([*(body[i : i + 5000] for i in range(0, len(body), 5000)), b""])
    (tmp_path / "s.bam").write_bytes(raw)
    for size in (len(raw) + 1, 40_000, 7001):
        reader = alignments.BamReader({"path": str(tmp_path / "s.bam"), "splitBytes": str(size)})
        got = [r[2] for p in reader.partitions() for r in reader.read(p)]
        assert sorted(got) == list(range(3000))


def test_interval_join(spark):
    rng = np.random.default_rng(5)
    make = lambda n, a, b: spark.createDataFrame([(int(k), int(s), int(s + w)) for k, s, w in zip(rng.integers(0, 3, n), rng.integers(0, 500, n), rng.integers(1, 90, n))], f"k int, {a} int, {b} int").distinct()
    x, y = make(80, "s", "e"), make(80, "u", "v")
    want = sorted((a.k, a.s, a.e, b.u, b.v) for a in x.collect() for b in y.collect() if a.k == b.k and a.s < b.v and b.u < a.e)
    for width in (None, 32, 1000):
        got = intervals.interval_join(x, y, ["k"], ("s", "e"), ("u", "v"), width)
        assert sorted(map(tuple, got.select("k", "s", "e", "u", "v").collect())) == want


def test_sequence(spark):
    row = spark.range(1).select(sequence.reverse_complement(F.lit("ACGTT")).alias("r"), sequence.consensus(F.lit("xxGTccAGxx"), F.lit("+"), F.lit(2), F.lit(8), "strict").alias("a"), sequence.consensus(F.lit("xxCTccACxx"), F.lit("-"), F.lit(2), F.lit(8), "strict").alias("b")).collect()[0]
    assert tuple(row) == ("AACGT", True, True)


def test_glm():
    rng = np.random.default_rng(1)
    in_a = np.repeat([1.0, 0.0], 10)
    x, sf = nbglm.design(in_a), np.exp(rng.normal(0, 0.1, 40))
    draw = lambda mu, d: rng.poisson(rng.gamma(1 / d, mu * d)).astype(float)
    disp, p0, p1 = [], [], []
    for _ in range(40):
        base = np.concatenate([np.full(20, 60.0), np.full(20, 300.0)]) * sf
        y = draw(base, 0.05)
        d, ok = nbglm.raw_dispersion(y, sf, x, 10)
        assert ok and 0 < d < 1
        disp.append(d)
        p0.append(nbglm.ratio_test(y, sf, in_a, d, 0.5))
        p1.append(nbglm.ratio_test(draw(base * np.where(np.arange(40) < 10, 3, 1), 0.05), sf, in_a, d, 0.5))
    assert 0.03 < np.median(disp) < 0.07
    assert np.mean(np.array(p0) < 0.05) < 0.25 and np.median(p1) < 1e-4
    # the search agrees with a fine grid, the fit with zero score
    _, mu, _ = nbglm.fit(y, x, np.log(sf), 0.05)
    assert np.abs(x.T @ ((y - mu) / (1 + 0.05 * mu))).max() < 1e-3
    grid = np.linspace(1e-4, 1, 20_000)
    best = grid[np.argmax([nbglm.profile(g, y, mu, x) for g in grid[::20]]) * 20]
    assert abs(nbglm.bounded_max(lambda v: nbglm.profile(v, y, mu, x))[0] - best) < 2e-3
    assert abs(nbglm.trigamma(1.0) - np.pi**2 / 6) < 1e-10
    assert abs(nbglm.chi2_1_survival(3.841458820694124) - 0.05) < 1e-10


def test_writers(spark):
    schema = "event_type string, event_id int, contig string, strand string, gene_id string, annotated int, exons1 array<struct<start:int,stop:int>>, exons2 array<struct<start:int,stop:int>>"
    events = spark.createDataFrame([("exon_skip", 1, "c1", "+", "g", 3, [(0, 10), (40, 50)], [(0, 10), (20, 30), (40, 50)])], schema)
    gff = [r.value for r in sinks.gff3(events).orderBy("line_no").collect()]
    assert gff[0] == 'c1\texon_skip\tgene\t1\t50\t.\t+\t.\tID=exon_skip.1;GeneName="g";HasNovelJunction="N"'
    assert len(gff) == 8 and gff[-1] == "c1\texon_skip\texon\t41\t50\t.\t+\t.\tParent=exon_skip.1_iso2"
    line = sinks.bed(events).collect()[0].value.split("\t")
    assert len(line) == 12 and line[9:] == ["3", "10,10,10", "0,20,40"]
    row = sinks.coordinates(events).collect()[0]
    assert (row.exon_pos, row.alt_usage) == ("0-10:20-30:40-50", "0:1:0")
    counts = spark.createDataFrame([("exon_skip", 1, "a", 5, 0.5), ("exon_skip", 1, "b", 7, None)], "event_type string, event_id int, sample string, n int, psi double")
    assert sinks.wide(events, counts, ["n", "psi"], ["a", "b"]).collect()[0]["b:n"] == 7
    row = sinks.icgc(events, counts, ["a", "b"]).collect()[0]
    assert tuple(row)[:9] == ("exon_skip.1", "ES", "c1", 3, "0:10:20:30:40:50", "20:30", "g", "0.500000", "nan")
    features = spark.createDataFrame([("exon_skip", 1, "a", 9, 7, 4), ("exon_skip", 1, "b", 1, 2, 3)], "event_type string, event_id int, sample string, e1e2 int, e2e3 int, e1e3 int")
    assert tuple(sinks.tcga("exon_skip", events, features, ["a", "b", "c"]).collect()[0]) == ("g", "exon_skip", "c1::0-10:20-30:40-50", "0.7", "NA", "NA", 1)


def test_shown_exons(spark):
    schema = "event_type string, event_id int, contig string, strand string, gene_id string, annotated int, exons1 array<struct<start:int,stop:int>>, exons2 array<struct<start:int,stop:int>>"
    rows = [
        ("intron_retention", 1, "c", "+", "g", 3, [(0, 10), (40, 50)], [(0, 50)]), ("alt_3prime", 2, "c", "+", "g", 3, [(0, 10), (40, 50)], [(0, 10), (30, 50)]),
        ("alt_5prime", 3, "c", "+", "g", 3, [(0, 10), (40, 50)], [(0, 20), (40, 50)]), ("mutex_exons", 4, "c", "+", "g", 3, [(0, 9), (10, 19), (40, 50)], [(0, 9), (20, 30), (40, 50)]),
        ("mult_exon_skip", 5, "c", "+", "g", 3, [(0, 9), (40, 50)], [(0, 9), (10, 12), (20, 30), (40, 50)]),
    ]
    events = spark.createDataFrame(rows, schema)
    psi = spark.createDataFrame([(r[0], r[1], "a", 0.25, 6, 12, 0, 0) for r in rows], "event_type string, event_id int, sample string, psi double, e2 int, e1e3 int, x int, y int")
    got = {r.number: (r.event_coordinates, r.alt_region_coordinates) for r in sinks.icgc(events, psi, ["a"]).collect()}
    assert got == {1: ("0:10:40:50", "10:40"), 2: ("0:10:40:50:30:50", "30:40"), 3: ("40:50:0:10:0:20", "10:20"), 4: ("0:9:10:19:20:30:40:50", "10:19:20:30"), 5: ("0:9:10:12:20:30:40:50", ":10:12:20:30")}
    assert sinks.tcga("alt_left", events.where("event_id = 3"), psi, ["a"]).collect()[0][2:4] == ("c::40-50:0-10:0-20", "0.7")
    assert sinks.tcga("intron_retention", events.where("event_id = 1"), psi, ["a"]).collect()[0].a == "12.0"


def test_structured(spark):
    schema = "event_type string, event_id int, contig string, strand string, gene_id string, annotated int, exons1 array<struct<start:int,stop:int>>, exons2 array<struct<start:int,stop:int>>"
    rows = [
        ("exon_skip", 1, "c", "+", "g", 1, [(0, 10), (40, 50)], [(0, 10), (20, 30), (40, 50)]),
        ("exon_skip", 2, "c", "-", "g", 1, [(0, 10), (40, 50)], [(0, 10), (20, 30), (40, 50)]),
        ("alt_3prime", 1, "c", "+", "g", 1, [(0, 10), (30, 50)], [(0, 10), (20, 50)]),
        ("alt_3prime", 2, "c", "-", "g", 1, [(0, 10), (40, 50)], [(0, 15), (40, 50)]),
        ("alt_5prime", 1, "c", "+", "g", 1, [(0, 10), (40, 50)], [(0, 15), (40, 50)]),
        ("intron_retention", 1, "c", "+", "g", 1, [(0, 10), (40, 50)], [(0, 50)]),
    ]
    psi = spark.createDataFrame([("exon_skip", 1, "s", 0.25)], "event_type string, event_id int, sample string, psi double")
    out = {(r.event_type, r.event_id): r.value for r in sinks.structured(spark.createDataFrame(rows, schema), psi, ["s"]).collect()}
    assert out["exon_skip", 1] == 'c\tundefined\texon_skip\t0\t50\t.\t+\t.\tgene_id "exon_skip.1"; transcript_id "exon_skip.1"; gene_name "g"; is_annotated "1"; flanks "10^,41-"; structure "0,1-2^"; splice_chain ",21-30^"; psi_s "0.250000";'
    assert 'flanks "41^,10-"; structure "0,1-2^"; splice_chain ",30-21^"' in out["exon_skip", 2]
    assert 'flanks "10^,50^"; structure "1-,2-"; splice_chain "21-,31-"' in out["alt_3prime", 1]
    assert 'flanks "41^,1^"; structure "1-,2-"; splice_chain "15-,10-"' in out["alt_3prime", 2]
    assert 'structure "1^,2^"; splice_chain "10^,15^"' in out["alt_5prime", 1]
    assert 'structure "0,1^2-"; splice_chain ",10^41-"' in out["intron_retention", 1]


def test_cube_gives_every_filter(spark):
    """Sums over the cube are the junctions of the reads that pass, for the given filter and all tighter ones."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = []
    for i in range(600):
        a, b = rng.randint(1, 49), rng.choice([100, 200, 300])
        cigar = rng.choice([f"{a}M{b}N{50 - a}M", f"{a}M{b}N5M1D{45 - a if a < 45 else 1}M60N9M", "50M"])
        rows.append((rng.choice("ab"), "c1", rng.choice([10, 20]), rng.choice([0, 0, 0, 256]), cigar, rng.choice([0, 0, 1, 2, 9]), rng.choice(["+", "-", None]), 0, 0))
    df = spark.createDataFrame(rows, alignments.SCHEMA)
    key = lambda d: sorted((r["sample"], r.strand, r.i_start, r.i_end, r.n) for r in d.collect())
    given = reads.ReadFilter.preset(1, 50)
    cube = reads.junction_cube(df.where(reads.passes(None)), given, reads.mismatches())
    for _ in range(8):
        want = reads.junctions(df.where(reads.passes(given)))
        assert key(reads.cube_junctions(cube, given)) == key(want)
        assert key(reads.cube_junctions(cube, given, False)) == key(reads.junctions(df.where(reads.passes(given, use_mismatches=False))))
        given = given.tightened()
    every = reads.all_junctions(cube)
    assert every.agg(F.sum("n")).first()[0] == reads.junctions(df.where(reads.passes(None))).agg(F.sum("n")).first()[0]


def test_tracks_in_one_pass(spark):
    from pyspark.sql import functions as F

    rows = [("a", "c1", 0, 0, "10M", 0, None, 0, 0), ("a", "c1", 5, 0, "10M5N10M", 0, "+", 0, 0), ("b", "c1", 5, 0, "4M", 3, None, 0, 0)]
    df = spark.createDataFrame(rows, alignments.SCHEMA)
    got = reads.tracks(df, spliced=F.col("cigar").contains("N"), depth=F.lit(True))
    bases = {(r["sample"], p): (r.spliced, r.depth) for r in got.collect() for p in range(r.run_start, r.run_end)}
    want = {("a", p): (int(5 <= p < 15 or 20 <= p < 30), int(p < 10) + int(5 <= p < 15 or 20 <= p < 30)) for p in [*range(15), *range(20, 30)]} | {("b", p): (0, 1) for p in range(5, 9)}
    assert bases == want


def test_pieces_of_sequences(spark):
    seq = spark.createDataFrame([("c1", "ACGTACGTAC"), ("c2", "gt"), ("c3", "")], "contig string, seq string")
    spots = spark.createDataFrame([("c1", i) for i in range(-1, 11)] + [("c2", 0), ("c3", 0), ("cx", 0)], "contig string, pos int")
    got = {(r.contig, r.pos): r.pair for r in fasta.pairs_at(seq, spots, 4).collect()}
    assert {k: v for k, v in got.items() if len(v) == 2} == {("c1", i): "ACGTACGTAC"[i : i + 2] for i in range(9)} | {("c2", 0): "GT"}


def test_stage_settings():
    from dataclasses import replace

    from junctura.config import Config

    a = Config(outdir="o", annotation="g.gtf", samples=("a.bam",))
    same = lambda stage, **kw: a.digest(stage, {}) == replace(a, **kw).digest(stage, {})
    assert same("prep/tracks", psi_min_reads=3) and same("prep/tracks", edge_limit=9) and same("genes", samples=("b.bam",)) and same("events/exon_skip", psi_min_reads=3)
    assert not same("psi/exon_skip", psi_min_reads=3) and not same("merged", iterations=2) and not same("prep/introns-0", filter_ambiguous=True) and not same("counts/runs", annotation="h.gtf")
    assert a.digest("prep/tracks", {"a.bam": "1"}) != a.digest("prep/tracks", {"a.bam": "2"}) and a.digest("genes", {"a.bam": "1"}) == a.digest("genes", {"a.bam": "2"})


def bin_of(start, stop):
    """The smallest bin that holds [start, stop)."""
    stop -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == stop >> shift:
            return first + (start >> shift)
    return 0


def indexed_bam(path, reads_of, contigs, block=3000):
    """A BAM file of (contig, pos, cigar) in order, and the bytes of its BAI and CSI indexes."""
    import re

    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(contigs))
    for name, length in contigs:
        body += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    spans = []
    for k, (c, pos, cigar) in enumerate(reads_of):
        ops = [(int(n) << 4) | alignments.OPS.index(op) for n, op in re.findall(r"(\d+)(.)", cigar)]
        name = f"r{k}".encode() + b"\0"
        rec = struct.pack("<iiBBHHHiiii", c, pos, len(name), 60, 0, len(ops), 0, 0, -1, -1, 0) + name + struct.pack(f"<{len(ops)}I", *ops) + b"NMC\0"
        spans.append((c, pos, pos + alignments.reference_length(cigar), len(body), len(body) + 4 + len(rec)))
        body += struct.pack("<i", len(rec)) + rec
    parts = [body[i : i + block] for i in range(0, len(body), block)] + [b""]
    starts = np.cumsum([0, *(len(bgzf([x])) for x in parts)]).tolist()
    path.write_bytes(bgzf(parts))
    at = lambda x: starts[x // block] << 16 | x % block
    bai, csi = b"BAI\1" + struct.pack("<i", len(contigs)), b"CSI\1" + struct.pack("<iiii", 14, 5, 0, len(contigs))
    for c in range(len(contigs)):
        own = [s for s in spans if s[0] == c]
        bins, linear = {}, {}
        for _, a, b, first, last in own:
            bins.setdefault(bin_of(a, b), []).append((at(first), at(last)))
            for w in range(a >> 14, ((b - 1) >> 14) + 1):
                linear.setdefault(w, at(first))
        bai += struct.pack("<i", len(bins) + 1)
        csi += struct.pack("<i", len(bins))
        for number, chunks in bins.items():
            raw = struct.pack("<i", len(chunks)) + b"".join(struct.pack("<QQ", *x) for x in chunks)
            bai += struct.pack("<I", number) + raw
            shift, first_bin = next((x, f) for x, f in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0)) if number >= f)
            low, high = (number - first_bin) << shift, (number - first_bin + 1) << shift
            csi += struct.pack("<IQ", number, min(at(first) for _, a, b, first, _ in own if a < high and b > low)) + raw
        bai += struct.pack("<Ii", 37450, 2) + struct.pack("<QQQQ", 0, 0, len(own), 0)
        n = max(linear, default=-1) + 1
        bai += struct.pack("<i", n) + struct.pack(f"<{n}Q", *(linear.get(w, min([v for x, v in linear.items() if x > w], default=0)) for w in range(n)))
    return bai, csi


def counted(monkeypatch):
    """Count the bytes that the reader takes from files."""
    read, plain = [0], alignments._open

    class Counting:
        def __init__(self, f):
            self.f = f

        def read(self, n=-1):
            out = self.f.read(n)
            read[0] += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    monkeypatch.setattr(alignments, "_open", lambda path: Counting(plain(path)))
    return read


def test_regions_read_their_blocks(tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    contigs = [("c1", 3_000_000), ("c2", 500_000), ("MT", 16_000), ("c3", 10)]
    rows = sorted((int(c), int(p), cigar) for c, p, cigar in zip(rng.choice([0, 1, 2], 6000, p=[0.7, 0.25, 0.05]), rng.integers(0, 15_000, 6000), rng.choice(["50M", "10M900N40M", "5S40M5D5M", "20M120000N30M"], 6000, p=[0.5, 0.25, 0.245, 0.005])))
    rows = sorted((c, p * (190 if c == 0 else 30 if c == 1 else 1), cigar) for c, p, cigar in rows)
    path = tmp_path / "s.bam"
    bai, csi = indexed_bam(path, rows, contigs)
    size, read = path.stat().st_size, counted(monkeypatch)

    def got(**options):
        reader = alignments.BamReader({"path": str(path), **options})
        return sorted((r[1], r[2], r[4]) for p in reader.partitions() for r in reader.read(p))

    def want(c, a, b):
        return sorted((contigs[c][0], p, cigar) for k, p, cigar in rows if k == c and p < b and p + alignments.reference_length(cigar) > a)

    regions = [(0, 0, 3_000_000), (0, 1_000_000, 1_010_000), (0, 2_500_000, 2_500_001), (1, 0, 100), (1, 449_000, 600_000), (1, 163_840, 163_841), (3, 0, 10)]
    plain = {r: got(region=f"{contigs[r[0]][0]}:{r[1]}-{r[2]}") for r in regions}  # without an index
    for name, raw in (("s.bam.bai", bai), ("s.bam.csi", csi), ("s.csi", gzip.compress(csi))):
        (tmp_path / name).write_bytes(raw)
        for c, a, b in regions:
            read[0] = 0
            assert got(region=f"{contigs[c][0]}:{a}-{b}") == want(c, a, b) == plain[c, a, b], (name, c, a, b)
            if b - a <= 10_000 and c == 0:
                assert read[0] - len(raw) < size / 4
        assert got(region="c2") == want(1, 0, 1 << 40) and got(region="c2", splitBytes="2000") == want(1, 0, 1 << 40)
        assert got(region="nowhere") == got(region="MT") == []
        (tmp_path / name).unlink()
    (tmp_path / "s.bam.bai").write_bytes(bai)
    assert len(got()) == 6000


def test_region_as_a_table(spark, tmp_path):
    rows = sorted((i % 2, 100 * i, "50M") for i in range(4000))
    path = tmp_path / "s.bam"
    bai, _ = indexed_bam(path, rows, [("c1", 500_000), ("c2", 500_000)])
    (tmp_path / "s.bam.bai").write_bytes(bai)
    reader = alignments.BamReader({"path": str(path), "region": "c2:100000-103000"})
    parts = reader.partitions()
    assert len(parts) == 1 and 0 < sum((b >> 16) - (a >> 16) for a, b in parts[0].chunks) < path.stat().st_size / 10
    region = alignments.read_bam(spark, [str(path)], region="c2:100000-103000")
    assert sorted(r.pos for r in region.collect()) == [p for c, p, _ in rows if c == 1 and p < 103_000 and p + 50 > 100_000]
    assert region.where("pos < 101000").count() == 5 and region.count() == 15 and alignments.read_bam(spark, [str(path)]).count() == 4000


def test_gff3_sequences_are_no_rows(spark, tmp_path):
    (tmp_path / "a.gff3").write_text("##gff-version 3\nc1\ts\tgene\t1\t90\t.\t+\t.\tID=g1\nc1\ts\tmRNA\t1\t90\t.\t+\t.\tID=t1;Parent=g1\nc1\ts\texon\t1\t90\t.\t+\t.\tParent=t1\n##FASTA\n>c1" + "\tx" * 9 + "\nACGT\n")
    assert annotation.lines(spark, str(tmp_path / "a.gff3")).count() == 3
    genes, exons = annotation.read_gff3(spark, str(tmp_path / "a.gff3"))
    assert [r.gene_id for r in genes.collect()] == ["g1"] and exons.count() == 1
