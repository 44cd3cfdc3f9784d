from junctura.config import Evidence
from junctura.operators import verify

RUNS = [("g", "a", 0, 100, 20), ("g", "a", 150, 250, 10), ("g", "a", 300, 500, 20)]


def frames(spark):
    runs = spark.createDataFrame(RUNS, "gene_id string, sample string, run_start int, run_end int, depth int")
    junctions = spark.createDataFrame([("g", "a", 100, 150, 9), ("g", "a", 250, 300, 8), ("g", "a", 100, 300, 2)], "gene_id string, sample string, i_start int, i_end int, n int")
    return spark.createDataFrame([("a",), ("b",)], "sample string"), runs, junctions


def test_exon_skip(spark):
    event = spark.createDataFrame([("g", 1, 0, 100, 150, 250, 300, 500)], "gene_id string, event_id int, e1s int, e1e int, e2s int, e2e int, e3s int, e3e int")
    got = {r.sample: r for r in verify.evidence("exon_skip", event, *frames(spark)).collect()}
    a, b = got["a"], got["b"]
    assert (a.e2_cov, a.e1e2, a.e2e3, a.e1e3) == (10, 9, 8, 2) and (a.v1, a.v2, a.v3, a.v4) == (True, True, True, False)
    assert a.psi == 0.8 and (a.iso2, a.iso1) == (8, 2) and b.psi is None and not b.v2
    known = spark.createDataFrame([("g", 100, 300)], "gene_id string, i_start int, i_end int")
    again = {r.sample: r for r in verify.evidence("exon_skip", event, *frames(spark), known=known).collect()}
    assert again["a"].v4 and again["b"].v4 and not again["b"].v3


def test_retention_and_alt(spark):
    event = spark.createDataFrame([("g", 1, 0, 100, 300, 500)], "gene_id string, event_id int, e1s int, e1e int, e2s int, e2e int")
    a = {r.sample: r for r in verify.evidence("intron_retention", event, *frames(spark)).collect()}["a"]
    assert (a.e2_cov, a.e2_region) == (5, 0.5) and not a.v1 and not a.v2
    event = spark.createDataFrame([("g", 1, 0, 100, 150, 500, 300, 500)], "gene_id string, event_id int, e1s int, e1e int, e2s int, e2e int, e3s int, e3e int")
    a = {r.sample: r for r in verify.evidence("alt_right", event, *frames(spark), Evidence(junction=2)).collect()}["a"]
    assert (a.e2, a.e1e3) == (9, 2) and a.v1 and a.v2 and abs(a.psi - 9 / 11) < 1e-12 and "__a" not in a


def test_mutex_and_multi(spark):
    event = spark.createDataFrame([("g", 1, 0, 100, 150, 200, 210, 250, 300, 500)], "gene_id string, event_id int, " + ", ".join(f"e{i}{x} int" for i in (1, 2, 3, 4) for x in "se"))
    a = {r.sample: r for r in verify.evidence("mutex_exons", event, *frames(spark)).collect()}["a"]
    assert (a.e1e2, a.e3e4, a.e1e3, a.e2e4) == (9, 8, 0, 0) and (a.v1, a.v2, a.v3, a.v4) == (True, True, False, False)
    event = spark.createDataFrame([("g", 1, 0, 100, 300, 500, [(150, 180), (220, 250)])], "gene_id string, event_id int, us int, ue int, vs int, ve int, inner array<struct<start:int,stop:int>>")
    a = {r.sample: r for r in verify.evidence("mult_exon_skip", event, *frames(spark)).collect()}["a"]
    assert (a.e1e2, a.e2e3, a.sum_e2, a.num_e2, a.e2_cov) == (9, 8, 0, 2, 10) and a.psi == 17 / 23
