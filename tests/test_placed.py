"""Tables by contig and position: numbers of contigs, and what a window reads."""

import gzip
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from junctura.sources import placed


def test_contigs_in_the_order_of_headers(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:c10\tLN:500\n@SQ\tSN:c2\tLN:400\nr\t0\tc2\t1\t60\t4M\t*\t0\t0\t*\t*\n@SQ\tSN:not\tLN:1\n")
    with gzip.open(tmp_path / "b.sam.gz", "wt") as f:
        f.write("@SQ\tLN:400\tSN:c2\n@SQ\tSN:c1\tLN:300\n")
    (tmp_path / "c.sam").write_text("r\t0\tc9\t1\t60\t4M\t*\t0\t0\t*\t*\n")
    got = placed.contigs(spark, [str(tmp_path / n) for n in ("a.sam", "b.sam.gz", "c.sam", "d.parquet")])
    assert sorted(map(tuple, got.collect())) == [(0, "c10", 500), (1, "c2", 400), (2, "c1", 300)]
    assert placed.contigs(spark, []).count() == 0
    rows = spark.createDataFrame([("c2", "-", 5, 9, 2), ("c2", "-", 5, 9, 1), ("c2", ".", 5, 9, 4), ("c9", "+", 1, 2, 1)], "contig string, xs string, i_start int, i_end int, n int")
    seen = {(r.contig, r.strand): (r.region_id, r.n_introns, r.n_reads) for r in placed.region_summary(rows, got).collect()}
    assert len(seen) == 6 and seen["c2", "-"] == (3, 1, 3) and seen["c2", "+"] == (2, 1, 4) and seen["c1", "+"] == (4, 0, 0)


def scanned(df):
    """How many rows the file scan of a collected query gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_a_window_reads_its_row_groups_only(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for _ in range(120_000):
        at = rng.randrange(1_000_000)
        rows.append((f"s{rng.randrange(9)}", rng.choice(["chrB", "chrA", "chrZ"]), at, at + rng.randrange(1, 90), rng.randrange(1, 1 << 30)))
    rows.append(("s1", "chrB", 10, 900_000, 7))  # one long intron
    table = spark.createDataFrame(rows, "sample string, contig string, s int, e int, n int")
    listed = spark.createDataFrame([(0, "chrB", 1_000_000), (1, "chrA", 1_000_000)], "contig_id int, contig string, length long")
    path = str(tmp_path / "t")
    placed.clustered(table, listed, "s", "e", "sample").write.option("parquet.block.size", 1 << 15).parquet(path)
    stats = [pq.ParquetFile(f).metadata for f in sorted((tmp_path / "t").glob("*.parquet"))]
    groups = [m.row_group(i) for m in stats for i in range(m.num_row_groups)]
    assert len(groups) > 20
    names = [c.name for c in pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).schema]
    bounds = lambda g, c: (lambda x: (x.min, x.max))(g.column(names.index(c)).statistics)
    low, high = 500_000, 510_000
    hit = [g for g in groups if bounds(g, "contig")[0] <= "chrB" <= bounds(g, "contig")[1] and bounds(g, "s")[0] < high and bounds(g, "e")[1] > low]
    assert 1 <= len(hit) <= 4  # its own ones, one with a border, and the one with the long intron
    near = placed.window(spark.read.parquet(path), "chrB", low, high, "s", "e")
    want = {r for r in rows if r[1] == "chrB" and r[2] < high and r[3] > low}
    assert {tuple(r) for r in near.select("sample", "contig", "s", "e", "n").collect()} == want and rows[-1] in want
    assert scanned(near) <= sum(g.num_rows for g in hit) < len(rows) / 5
    order = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min(F.struct("contig_id", "s")).alias("a"), F.max(F.struct("contig_id", "s")).alias("b")).orderBy("a").collect()
    assert all(tuple(x.b) <= tuple(y.a) for x, y in zip(order, order[1:])) and order[-1].b.contig_id == placed.NOT_LISTED
