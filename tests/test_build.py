"""Simulated reads through the whole build and a test of two groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura import cli
from junctura.config import Config
from junctura.plans import report, viz_data
from junctura.plans.build import Build, SampleCounts

EXONS = [(1000, 1200), (1500, 1600), (2000, 2300)]
LEN = 50


def reads(path, exons, n, rng, out):
    pos = np.concatenate([np.arange(s, e) for s, e in exons])
    for start in rng.integers(0, len(pos) - LEN, n):
        p = pos[start : start + LEN]
        cut = np.flatnonzero(np.diff(p) > 1)
        cigar, last = "", 0
        for c in cut:
            cigar += f"{c + 1 - last}M{p[c + 1] - p[c] - 1}N"
            last = c + 1
        out.append(f"r\t0\tc1\t{p[0] + 1}\t60\t{cigar}{LEN - last}M\t*\t0\t0\t*\t*\tNM:i:0" + ("\tXS:A:+" if len(cut) else ""))


def test_build(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = ['c1\tsim\tgene\t1001\t2300\t.\t+\t.\tgene_id "g1";']
    rows += [f'c1\tsim\texon\t{s + 1}\t{e}\t.\t+\t.\tgene_id "g1"; transcript_id "t1";' for s, e in EXONS]
    for k in range(12):
        at = 10_000 + 3000 * k
        rows += [f'c1\tsim\tgene\t{at + 1}\t{at + 1000}\t.\t+\t.\tgene_id "x{k}";', f'c1\tsim\texon\t{at + 1}\t{at + 1000}\t.\t+\t.\tgene_id "x{k}"; transcript_id "x{k}";']
    (tmp_path / "a.gtf").write_text("\n".join(rows) + "\n")
    samples = []
    for i in range(8):
        out = []
        skipped = 400 if i < 4 else 60
        reads(None, EXONS, 600, rng, out)
        reads(None, [EXONS[0], EXONS[2]], skipped, rng, out)
        for k in range(12):
            reads(None, [(10_000 + 3000 * k, 11_000 + 3000 * k)], 300, rng, out)
        samples.append(str(tmp_path / f"s{i}.sam"))
        (tmp_path / f"s{i}.sam").write_text("\n".join(out) + "\n")
    cfg = Config(outdir=str(tmp_path / "out"), annotation=str(tmp_path / "a.gtf"), samples=tuple(samples))
    job = Build(spark, cfg)
    found = job.run()
    psi, confirmed = found["exon_skip"]
    assert confirmed.where("confirmed = 8").count() == 1  # the skipping intron was not in the annotation
    got = {r.sample: r for r in psi.collect()}
    assert got["s0"].annotated == 2 and got["s0"].e1e3 > 30 and got["s0"].psi < got["s7"].psi
    assert found["mutex_exons"][0].count() == found["intron_retention"][0].count() == 0
    sf = {r.sample: r.sf for r in spark.read.parquet(cfg.root + "/size_factors").collect()}
    assert len(sf) == 8 and all(0.8 < v < 1.3 for v in sf.values())
    test = job.test("exon_skip", [f"s{i}" for i in range(4)], [f"s{i}" for i in range(4, 8)]).collect()
    assert len(test) == 1 and test[0].p < 0.05 and test[0].dpsi < -0.1
    report.write(spark, cfg)
    lines = [r.value for r in spark.read.text(cfg.root + "/reports/exon_skip.confirmed.gff3").collect()]
    assert len(lines) == 8 and "\tgene\t1001\t2300\t" in lines[0] and 'HasNovelJunction="Y"' in lines[0]
    assert spark.read.option("header", True).option("sep", "\t").csv(cfg.root + "/reports/exon_skip.tsv").columns[-1] == "s7:psi"
    a, b = ["s0", "s1", "s2", "s3"], ["s4", "s5", "s6", "s7"]
    report.write_test(spark, cfg, job.test("exon_skip", a, b), "exon_skip", a, b)
    written = lambda name: spark.read.option("header", True).option("sep", "\t").csv(f"{cfg.root}/testing/test_results_C3_exon_skip.{name}")
    assert written("gene_unique.tsv").count() == 1
    assert written("tsv").columns == "event_id chrm exon_pos alt_usage gene_id gene_name p_val p_val_adj dPSI mean_event_count_A mean_event_count_B log2FC_event_count mean_gene_exp_A mean_gene_exp_B log2FC_gene_exp".split()
    rows, (low, high) = viz_data.event_rows(spark, cfg.root, "exon_skip.1")
    assert rows.count() == 8 and low < 1000 and high > 2300 and viz_data.top_tracks(spark, cfg.root, job.test("exon_skip", a, b), "exon_skip", 3)[0][0] == "exon_skip.1"
    row = written("extended.tsv").collect()[0].asDict()
    assert row["exon_pos"] == "1000-1200:1500-1600:2000-2300" and row["alt_usage"] == "0:1:0" and row["event_id"] == "exon_skip.1"
    assert abs(sum(float(row[f"event_count:{s}"]) for s in a) / 4 - float(row["mean_event_count_A"])) < 1e-6 and len(row) == 15 + 16 + 2
    again = Build(spark, cfg).run()["exon_skip"][0]
    assert again.count() == 8
    runs = spark.read.parquet(cfg.root + "/counts/runs").where("gene_id = 'g1'")
    low, high = viz_data.plot_range(runs, "run_start", "run_end")
    assert low < 1000 < 2300 < high and viz_data.coverage_bins(runs, low, high, 20).count() > 8
    groups = spark.createDataFrame([(f"s{i}", "a" if i < 4 else "b") for i in range(8)], "sample string, `group` string")
    assert viz_data.segment_means(spark.read.parquet(cfg.root + "/counts/segment_depth"), groups).where("sem IS NOT NULL").count() > 0
    tables = viz_data.gene_tables(spark, cfg.root, "g1.5")
    assert tables["exons"].count() == 3 and tables["events/exon_skip"].count() == 1
    near = viz_data.range_tables(spark, cfg.root, "c1:9000-14000")
    assert {r.gene_id for r in near["exons"].collect()} == {"x0", "x1"} and near["events/exon_skip"].count() == 0
    assert near["coverage"].where("run_start >= 9000 AND run_end <= 14000").select("sample").distinct().count() == 8 and near["introns"].count() == 0
    assert spark.read.parquet(cfg.root + "/prep/regions").count() == 0  # these texts have no headers
    assert viz_data.top_tables(spark, cfg.root, 3, "exon_skip", 2) == ["exon_skip.1"]
    one = viz_data.event_tables(spark, cfg.root, "exon_skip.1")
    assert one["evidence"].count() == 8 and one["exons"].count() == 3
    # samples one by one: the same tables, and a later sample touches its own partition only
    store = SampleCounts(spark, cfg)
    with pytest.raises(ValueError, match="s0"):
        store.collect()
    store.add(samples[:7])
    stamps = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("by_sample/*/sample=*/*.parquet")}
    before = stamps()
    with pytest.raises(ValueError, match="s7"):
        store.collect()
    store.add(samples[7:])
    after = stamps()
    assert all(after[k] == v for k, v in before.items()) and all("sample=s7" in k for k in set(after) - set(before)) and len(after) > len(before)
    got, names = store.collect(), {"runs": "counts/runs", "junctions": "counts/junctions", "depth": "counts/segment_depth", "expression": "expression"}
    for table, stage in names.items():
        want = spark.read.parquet(f"{cfg.root}/{stage}")
        assert sorted(map(repr, got[table].select(want.columns).collect())) == sorted(map(repr, want.collect())), table
    assert Build(spark, cfg).run(collected=True)["exon_skip"][0].count() == 8


def test_plot_tables(spark):
    runs = spark.createDataFrame([("a", 0, 10, 4), ("b", 5, 15, 2)], "sample string, run_start int, run_end int, depth int")
    bins = viz_data.coverage_bins(runs, 0, 20, 4)
    sf = spark.createDataFrame([("a", 2.0)], "sample string, sf double")
    assert {(r.sample, r.bin): r.depth for r in viz_data.normalised(bins, sf).collect()} == {("a", 0): 2.0, ("a", 1): 2.0, ("b", 1): 2.0, ("b", 2): 2.0}
    groups = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "sample string, `group` string")
    got = {(r["group"], r.bin): r.depth for r in viz_data.mean_coverage(bins, groups, 4).collect()}
    assert got[("x", 1)] == 3 and got[("x", 3)] == 0 and got[("y", 0)] == 0 and len(got) == 8
    rows = {r.sample: r.depths for r in viz_data.heatmap(bins, ["a", "c"], 4, log=False).collect()}
    assert rows == {"a": [4.0, 4.0, 0.0, 0.0], "c": [0.0] * 4}
    many = spark.createDataFrame([(f"s{i}",) for i in range(30)], "sample string")
    assert len({r.sample for r in viz_data.some_samples(many, 5).collect()}) == 5 and viz_data.some_samples(many, 5, 1).collect() != viz_data.some_samples(many, 5).collect()


def test_plot_data(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 5, 20), (1, 12, 15), (2, 0, 3)], "g int, s int, e int")
    assert [r.level for r in viz_data.levels(df, ["g"], "s", "e").orderBy("g", "s").collect()] == [0, 1, 0, 0]
    p = spark.range(1, 101).select((F.col("id") / 101).alias("p"))
    assert viz_data.qq(p).where("abs(expected - observed) > 1e-9").count() == 0
    assert sum(r.n for r in viz_data.histogram(p, "p").collect()) == 100
    assert viz_data.ma(spark.createDataFrame([(4.0, 1.0), (0.0, 1.0)], "x double, y double"), "x", "y").collect()[0].m == 2


def test_command_line(tmp_path):
    (tmp_path / "l.txt").write_text("a.bam\nb.bam\n")
    args = cli.parser().parse_args(["build", "-o", "o", "-a", "x.gtf", "-b", str(tmp_path / "l.txt"), "-c", "2", "--no-insert-ir", "--validate-sg"])
    cfg = cli.config(args)
    assert cfg.samples == ("a.bam", "b.bam") and cfg.confidence == 2 and not cfg.insert_retentions and cfg.support == 2
