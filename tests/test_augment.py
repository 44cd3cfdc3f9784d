import numpy as np

from junctura.config import Cassette, Config, IntronEdges, Retention
from junctura.operators import augment
from junctura.operators.augment import Depth, Graph

FLAT = Depth(np.array([0]), np.array([1000]), np.array([20]))
NONE = Depth(np.array([], int), np.array([], int), np.array([], int))


def test_depth():
    rng = np.random.default_rng(0)
    base = np.repeat(rng.integers(0, 5, 40), rng.integers(1, 9, 40))
    cut = np.flatnonzero(np.diff(base)) + 1
    start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(base)]])
    keep = base[start] > 0
    d = Depth(start[keep], end[keep], base[start][keep])
    for _ in range(200):
        a, b = sorted(rng.choice(len(base), 2, replace=False))
        assert d.median(a, b) == np.median(base[a:b])
        assert abs(d.mean(a, b) - base[a:b].mean()) < 1e-9
        assert abs(d.share_above(a, b, 1) - (base[a:b] > 1).mean()) < 1e-9


def test_both_ends():
    g = Graph([(0, 100), (200, 300), (400, 500)], [((0, 100), (200, 300)), ((200, 300), (400, 500))])
    assert augment.add_introns(g, [(100, 400)], NONE, IntronEdges()) == (True, 0)
    assert ((0, 100), (400, 500)) in g.edges


def test_inside_an_exon():
    g = Graph([(0, 500), (600, 700)], [((0, 500), (600, 700))])
    augment.add_introns(g, [(100, 300)], NONE, IntronEdges())
    assert {((0, 100), (300, 500)), ((300, 500), (600, 700))} <= g.edges


def test_nearby_exon_is_cut():
    g = Graph([(0, 120), (200, 300)], [((0, 120), (200, 300))])
    augment.add_introns(g, [(100, 200)], NONE, IntronEdges())
    assert ((0, 100), (200, 300)) in g.edges
    g = Graph([(0, 100), (200, 400)], [((0, 100), (200, 400))])
    augment.add_introns(g, [(100, 230)], NONE, IntronEdges())
    assert ((0, 100), (230, 400)) in g.edges


def test_gap_and_terminal():
    g = Graph([(0, 100), (600, 700)], [])
    augment.add_introns(g, [(300, 600)], FLAT, IntronEdges())
    assert ((0, 300), (600, 700)) in g.edges
    g = Graph([(0, 100), (600, 700)], [])
    augment.add_introns(g, [(300, 600)], NONE, IntronEdges())
    assert ((100, 300), (600, 700)) in g.edges
    g = Graph([(0, 100)], [])
    augment.add_introns(g, [(100, 500), (560, 900)], NONE, IntronEdges())
    assert ((0, 100), (500, 560)) in g.edges


def test_neighbouring_gene():
    g = Graph([(0, 100), (600, 700)], [])
    assert augment.add_introns(g, [(300, 600)], NONE, IntronEdges(), (frozenset([300]), frozenset())) == (False, 1)


def test_retention_chain():
    vs = [(0, 100), (150, 250), (300, 400), (500, 600)]
    g = Graph(vs, list(zip(vs, vs[1:])))
    assert augment.add_retentions(g, Depth(np.array([0, 500]), np.array([400, 600]), np.array([20, 20])), Retention.preset(3))
    assert {(0, 250), (150, 400), (0, 400)} <= g.vertices and ((0, 400), (500, 600)) in g.edges and (300, 600) not in g.vertices


def test_cassette():
    g = Graph([(0, 100), (400, 500)], [((0, 100), (400, 500))])
    d = Depth(np.array([0, 200, 400]), np.array([100, 260, 500]), np.array([30, 25, 30]))
    assert augment.add_cassettes(g, [(100, 200), (260, 400)], d, Cassette())
    assert {((0, 100), (200, 260)), ((200, 260), (400, 500))} <= g.edges


def test_short_exons():
    vs = [(0, 5), (100, 130), (200, 205), (300, 400)]
    g = Graph(vs, list(zip(vs, vs[1:])))
    augment.drop_short(g)
    assert g.vertices == {(100, 130), (300, 400)}
    assert g.edges == {((100, 130), (300, 400))}


def test_distributed(spark):
    cfg = Config(outdir="x")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    v = frame([("g", 0, 100), ("g", 200, 300), ("g", 400, 500)], "gene_id string, v_start int, v_end int")
    e = frame([("g", 0, 100, 200, 300), ("g", 200, 300, 400, 500)], "gene_id string, us int, ue int, vs int, ve int")
    i = frame([("a", "g", 100, 400)], "sample string, gene_id string, i_start int, i_end int")
    r = frame([], "sample string, gene_id string, run_start int, run_end int, depth int")
    n = frame([], "gene_id string, kind string, at int")
    each, plain = augment.augmented(v, e, i, r, n, cfg), augment.untouched(v, e, cfg)
    assert [x.sample for x in each.collect()] == ["a"] * 6 and plain.count() == 5
    got = {(x.us, x.ue, x.vs, x.ve): x.n_samples for x in augment.merged(each, plain, ["a", "b", "c"]).collect()}
    assert len(got) == 6 and got[(0, 100, 400, 500)] == 1 and got[(0, 100, 200, 300)] == got[(200, 300, None, None)] == 3


def test_untouched_genes_lose_short_exons(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    v = frame([("g", 0, 5), ("g", 100, 130), ("g", 200, 205), ("g", 300, 400)], "gene_id string, v_start int, v_end int")
    e = frame([("g", 0, 5, 100, 130), ("g", 100, 130, 200, 205), ("g", 200, 205, 300, 400)], "gene_id string, us int, ue int, vs int, ve int")
    got = {(x.us, x.ue, x.vs, x.ve) for x in augment.untouched(v, e, Config(outdir="x", remove_short=True)).collect()}
    assert {(100, 130, None, None), (300, 400, None, None), (100, 130, 300, 400)} <= got and all(x[:2] != (200, 205) for x in got)


def test_huge_genes_stop(spark):
    """Against merging one sample after another."""
    import random

    from junctura.operators import graph

    rng, rows = random.Random(2), []
    for gene in range(6):
        for place in range(8):
            vs = sorted(rng.sample(range(30), 6))
            rows += [(gene, v, v + 1, None, None, place, 1) for v in vs] + [(gene, a, a + 1, b, b + 1, place, 1) for a, b in zip(vs, vs[1:])]
    want = {}
    for gene in range(6):
        have, counts = set(), {}
        for place in range(8):
            own = [r[1:5] for r in rows if r[0] == gene and r[5] == place]
            if sum(x[2] is None for x in have) <= 15:
                have |= set(own)
            for x in own:
                counts[x] = counts.get(x, 0) + 1
        want |= {(gene, *x): counts[x] for x in have}
    df = spark.createDataFrame(rows, "gene_id int, us int, ue int, vs int, ve int, place int, n long")
    got = {tuple(r)[:5]: r.n_samples for r in graph.bounded_merge(df, 15).select("gene_id", "us", "ue", "vs", "ve", "n_samples").collect()}
    assert got == want
