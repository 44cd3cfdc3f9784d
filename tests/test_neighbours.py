import itertools
import random

import pytest

from junctura.operators import events, graph
from junctura.plans import catalogue, projection

LOCAL = [f"{q}_{k}" for q in ("evidence", "quantify", "counts_for_test") for k in ("mutex_exons", "alt_right", "alt_left", "mult_exon_skip")]


@pytest.mark.parametrize("name", LOCAL)
def test_rows_of_events_are_not_shuffled(spark, sf, name):
    """From the top of the plan the join that makes an event's rows in its samples comes before any shuffle."""
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and plan.index("Join") < plan.index("Exchange")


def test_mutex_exons_of_a_dense_gene(spark):
    rng = random.Random(5)
    v = [(100 * k + 10 * i, 100 * k + 60 + 10 * i) for k in range(5) for i in range(3)]
    edges = {("g", *a, *b) for a, b in itertools.product(v, v) if b[0] > a[1] and rng.random() < 0.6}
    after = {(e[1:3], e[3:5]) for e in edges}
    want = {("g", *a, *b, *c, *d) for a, b, c, d in itertools.product(v, repeat=4) if c[0] >= b[1] and {(a, b), (a, c), (b, d), (c, d)} <= after and (b, c) not in after}
    df = events.mutex_exons(spark.createDataFrame(sorted(edges), "gene_id string, us long, ue long, vs long, ve long"))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")


def _plain(nodes, pairs):
    """The rule of mult_exon_skip for one edge at a time."""
    before = {v: [a for a, b in pairs if b == v] for v in nodes}
    for a, b in pairs:
        for choose in (min, max):
            best = {a: (0, None)}
            for w in nodes:
                if a < w <= b:
                    ways = [(best[v][0] + 1, v) for v in before[w] if v in best and not (w == b and v == a)]
                    if ways:
                        best[w] = next(x for x in ways if x[0] == choose(n for n, _ in ways))
            if b in best and best[b][0] > 2:
                inner, v = [], best[b][1]
                while v != a:
                    inner.append(v)
                    v = best[v][1]
                yield (*a, *b, [(s, e) for s, e in inner[::-1]])
                break


def test_paths_from_all_exons_in_one_pass(spark):
    rng = random.Random(7)
    rows, want = [], []
    for g, share in enumerate((0.1, 0.25, 0.5, 0.9)):
        v = [(100 * k + 10 * i, 100 * k + 60 + 40 * i) for k in range(7) for i in range(3)]
        pairs = sorted((a, b) for a, b in itertools.product(v, v) if b[0] > a[1] and rng.random() < share)
        rows += [(g, *a, *b) for a, b in pairs]
        want += [(g, *x) for x in _plain(sorted(v), pairs)]
    got = events.mult_exon_skip(spark.createDataFrame(rows, "gene_id long, us long, ue long, vs long, ve long")).collect()
    assert sorted((r.gene_id, r.us, r.ue, r.vs, r.ve, [tuple(x) for x in r.inner]) for r in got) == sorted(want) and want
    assert events.mult_exon_skip(spark.createDataFrame(rows, "gene_id long, us long, ue long, vs long, ve long"), 3).count() == 0


def test_a_task_sorts_no_more_of_a_larger_table(spark, sf, monkeypatch):
    whole = sorted(map(tuple, projection.exons(spark, sf).collect()))
    monkeypatch.setattr(projection, "ROWS", 500)
    dealt = projection.exons(spark, sf)
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert dealt.rdd.getNumPartitions() >= n // 500 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, dealt.collect())) == whole


@pytest.mark.parametrize("name", ["merged_bounded", "terminals"])
def test_the_exons_are_made_once(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Window [row_number(") == 1


@pytest.mark.parametrize("name", ["merged_bounded", "curated_alt_left", "curated_alt_right", "intron_retention", "mult_exon_skip", "terminals"])
def test_line_items_are_sorted_in_as_many_tasks_as_they_need(spark, sf, monkeypatch, name):
    want = sorted(map(str, catalogue.QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(projection, "ROWS", 500)
    df = catalogue.QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    below = plan[plan.rindex("row_number(") :]
    assert "hashpartitioning(l_orderkey" in below and f", {n}), REPARTITION_BY_NUM" in below and "ENSURE_REQUIREMENTS" not in below
    assert sorted(map(str, df.collect())) == want


def test_vertices_and_edges_of_one_pass(spark):
    """Exons that touch or overlap the next one have no edge, a lone exon is a vertex; doubles count once."""
    rows = [(1, t, 10, 20) for t in (1, 2)] + [(1, t, 30, 40) for t in (1, 2)] + [(1, 3, 10, 20), (1, 3, 20, 25), (1, 3, 22, 50), (2, 4, 5, 9)]
    e = spark.createDataFrame(rows, "gene_id long, transcript_id long, ex_start long, ex_end long")
    got = graph.vertices_and_edges(e)
    assert sorted(map(tuple, got.where("vs IS NULL").select("gene_id", "us", "ue").collect())) == sorted(map(tuple, graph.vertices(e).collect()))
    assert sorted(map(tuple, got.where("vs IS NOT NULL").collect())) == sorted(map(tuple, graph.edges(e).collect())) == [(1, 10, 20, 30, 40)]
    assert sorted(map(tuple, graph.exon_terminals(e).collect())) == sorted(map(tuple, graph.terminals(graph.vertices(e), graph.edges(e)).collect()))
