"""Changes to a splice graph."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.config import Cassette, Config, IntronEdges, Retention
from junctura.operators import graph


def retention_closure(retained: DataFrame) -> DataFrame:
    """(gene_id, us, ue, vs, ve) of every pair of exons joined by a chain of retained introns.

    Chains go from left to right, so the recursion ends after the longest one."""
    spark: SparkSession = retained.sparkSession
    retained.createOrReplaceTempView("__retained")
    return spark.sql("""
WITH RECURSIVE chain(gene_id, us, ue, vs, ve) AS (
  SELECT gene_id, us, ue, vs, ve FROM __retained
  UNION ALL
  SELECT c.gene_id, c.us, c.ue, r.vs, r.ve FROM chain c JOIN __retained r ON c.gene_id = r.gene_id AND c.vs = r.us AND c.ve = r.ue)
SELECT DISTINCT gene_id, us, ue, vs, ve FROM chain""")


class Depth:
    """Depth along a gene as runs; statistics never lay out bases one by one."""

    def __init__(self, start: np.ndarray, end: np.ndarray, depth: np.ndarray):
        order = np.argsort(start, kind="stable")
        self.start, self.end, self.depth = start[order], end[order], depth[order].astype(float)

    def cut(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(depths, lengths) of [a, b), uncovered bases as depth 0."""
        lo, hi = np.searchsorted(self.end, a, "right"), np.searchsorted(self.start, b, "left")
        size = np.minimum(self.end[lo:hi], b) - np.maximum(self.start[lo:hi], a)
        gap = (b - a) - size.sum()
        return (np.append(self.depth[lo:hi], 0.0), np.append(size, gap)) if gap > 0 else (self.depth[lo:hi], size)

    def mean(self, a: int, b: int) -> float:
        d, n = self.cut(a, b)
        return float((d * n).sum() / n.sum()) if n.sum() else 0.0

    def share_above(self, a: int, b: int, level: float) -> float:
        d, n = self.cut(a, b)
        return float(n[d > level].sum() / n.sum()) if n.sum() else 0.0

    def median(self, a: int, b: int) -> float:
        d, n = self.cut(a, b)
        total = int(n.sum())
        if not total:
            return 0.0
        order = np.argsort(d, kind="stable")
        to = np.cumsum(n[order])
        low, high = (int(np.searchsorted(to, k, "right")) for k in ((total - 1) // 2, total // 2))
        return float((d[order][low] + d[order][high]) / 2)


class Graph:
    """One gene's exons and the introns between them, by coordinates; pairs have the left exon first."""

    def __init__(self, vertices, edges):
        self.vertices: set[tuple[int, int]] = set(vertices)
        self.edges: set[tuple] = {(min(e), max(e)) for e in edges}

    def copy(self) -> "Graph":
        return Graph(self.vertices, self.edges)

    def into(self, v) -> list:
        return [a for a, b in self.edges if b == v]

    def out_of(self, v) -> list:
        return [b for a, b in self.edges if a == v]

    def connect(self, a, b) -> None:
        self.vertices |= {a, b}
        self.edges.add((min(a, b), max(a, b)))

    def ending(self, at: int) -> list:
        return sorted(v for v in self.vertices if v[1] == at)

    def starting(self, at: int) -> list:
        return sorted(v for v in self.vertices if v[0] == at)


def add_cassettes(g: Graph, introns: list[tuple[int, int]], depth: Depth, cfg: Cassette) -> bool:
    """An exon between two introns whose outer ends lie on exons, covered well and better than its flanks."""
    added, covered = False, sorted(g.vertices)
    introns = sorted(set(introns))
    for k, (s, stop) in enumerate(introns):
        before = g.ending(s)
        if not before:
            continue
        for start, e in introns[k + 1 :]:
            after = g.starting(e)
            if start <= stop or not after or any(v[0] < start and stop < v[1] for v in covered):
                continue
            level = depth.mean(stop, start)
            if depth.share_above(stop, start, 0.2 * level) <= cfg.min_region or depth.median(stop, start) <= cfg.min_cov:
                continue
            left, right = min(stop - s, start - stop), min(e - start, start - stop)
            jump_left = depth.median(stop, stop + left) / max(depth.median(stop - left, stop), 1.0) - 1
            jump_right = depth.median(start - right, start) / max(depth.median(start, start + right), 1.0) - 1
            if jump_left >= cfg.rel_diff and jump_right >= cfg.rel_diff:
                exon = (stop, start)
                for v in before:
                    g.connect(v, exon)
                for v in after:
                    g.connect(exon, v)
                added = True
    return added


def is_retained(a, b, depth: Depth, cfg: Retention) -> bool:
    """Whether the intron between the two exons is covered like they are."""
    start, stop = a[1], b[0]
    if stop <= start:
        return False
    level, flanks = depth.mean(start, stop), (depth.median(*a), depth.median(*b))
    mean_flank = sum(flanks) / 2
    return (
        depth.median(start, stop) > cfg.min_cov
        and depth.share_above(start, stop, 0.5 * level) > cfg.min_region
        and max(flanks) / (1e-6 + min(flanks)) <= cfg.fold
        and cfg.rel_low * mean_flank <= level <= cfg.rel_high * mean_flank
    )


def add_retentions(g: Graph, depth: Depth, cfg: Retention) -> bool:
    """A joined exon over each retained intron and each chain of them, with the outer exons' edges."""
    kept = [(a, b) for a, b in sorted(g.edges) if not any(a[1] <= v[0] and v[1] <= b[0] for v in g.vertices) and is_retained(a, b, depth, cfg)]
    reach: dict = {}
    for a, b in sorted(kept, reverse=True):
        reach.setdefault(a, set()).add(b)
        reach[a] |= reach.get(b, set())
    before = len(g.vertices)
    plain = g.copy()
    for a in sorted(reach):
        for b in sorted(reach[a]):
            exon = (a[0], b[1])
            g.vertices.add(exon)
            for v in plain.into(a):
                g.connect(v, exon)
            for v in plain.out_of(b):
                g.connect(exon, v)
    return len(g.vertices) > before


def add_introns(g: Graph, introns: list[tuple[int, int]], depth: Depth, cfg: IntronEdges, outside: tuple[frozenset, frozenset] = (frozenset(), frozenset())) -> tuple[bool, int]:
    """Bring introns into the graph in coordinate order; (changed, introns that found no place).

    ``outside``: ends of the previous gene's exons, starts of the next gene's.
    Where an end is missing: introns inside an exon split copies of it; a nearby or
    gaplessly covered exon is cut or extended to the end; else a new terminal exon is
    added, no longer than ``max_terminal`` and not over another intron."""
    changed, unused = False, 0
    introns = sorted(set(introns))
    for s, e in introns:
        left, right = g.ending(s), g.starting(e)
        size = (len(g.vertices), len(g.edges))
        if not left and not right:
            inside = [v for v in sorted(g.vertices) if v[0] < s and e < v[1]]
            for v in inside:
                a, b = (v[0], s), (e, v[1])
                for x in g.into(v):
                    g.connect(x, a)
                for x in g.out_of(v):
                    g.connect(b, x)
                g.connect(a, b)
            unused += not inside
        elif not left:
            if s in outside[0]:
                unused += 1
                continue
            new = _left_exon(g, s, introns, depth, cfg)
            for v in right:
                g.connect(new, v)
        elif not right:
            if e in outside[1]:
                unused += 1
                continue
            new = _right_exon(g, e, introns, depth, cfg)
            for v in left:
                g.connect(v, new)
        elif len(left) <= cfg.max_copies and len(right) <= cfg.max_copies:
            for a in left:
                for b in right:
                    g.connect(a, b)
        else:
            unused += 1
        changed |= size != (len(g.vertices), len(g.edges))
    return changed, unused


def _left_exon(g: Graph, s: int, introns: list, depth: Depth, cfg: IntronEdges) -> tuple[int, int]:
    near = [v for v in sorted(g.vertices) if min(abs(v[0] - s), abs(v[1] - s)) <= cfg.vicinity and v[0] < s]
    if not near:
        before = [v for v in g.vertices if v[1] <= s]
        last = max(before, key=lambda v: (v[1], v[0]), default=None)
        if last and depth.share_above(last[1], s, cfg.gap_cov) >= cfg.gap_region:
            near = [last]
    if near:
        v = min(near, key=lambda v: (min(abs(v[0] - s), abs(v[1] - s)), v))
        if s - v[0] >= cfg.min_exon:
            new = (v[0], s)
            for x in g.into(v):
                g.connect(x, new)
            g.vertices.add(new)
            return new
    low = max([b for _, b in introns if b < s] + [s - cfg.max_terminal])
    return max(low, 1), s


def _right_exon(g: Graph, e: int, introns: list, depth: Depth, cfg: IntronEdges) -> tuple[int, int]:
    near = [v for v in sorted(g.vertices) if min(abs(v[0] - e), abs(v[1] - e)) <= cfg.vicinity and v[1] > e]
    if not near:
        after = [v for v in g.vertices if v[0] >= e]
        first = min(after, key=lambda v: (v[0], v[1]), default=None)
        if first and depth.share_above(e, first[0], cfg.gap_cov) >= cfg.gap_region:
            near = [first]
    if near:
        v = min(near, key=lambda v: (min(abs(v[0] - e), abs(v[1] - e)), v))
        if v[1] - e >= cfg.min_exon:
            new = (e, v[1])
            for x in g.out_of(v):
                g.connect(new, x)
            g.vertices.add(new)
            return new
    high = min([a for a, _ in introns if a > e] + [e + cfg.max_terminal])
    return e, high


def drop_short(g: Graph, tiny: int = 10, short: int = 50, grow: int = 40) -> None:
    """Grow tiny terminal exons, bridge short inner ones, drop the tiny that are left."""
    for v in sorted(g.vertices):
        if v[1] - v[0] >= tiny:
            continue
        ins, outs = g.into(v), g.out_of(v)
        if bool(ins) != bool(outs):
            new = (v[0], v[1] + grow) if ins else (max(v[0] - grow, 0), v[1])
            g.vertices.discard(v)
            g.edges = {(new if a == v else a, new if b == v else b) for a, b in g.edges}
            g.vertices.add(new)
    for v in sorted(g.vertices):
        if v[1] - v[0] < short:
            for a in g.into(v):
                for b in g.out_of(v):
                    g.edges.add((a, b))
    gone = {v for v in g.vertices if v[1] - v[0] < tiny}
    g.vertices -= gone
    g.edges = {(a, b) for a, b in g.edges if a not in gone and b not in gone}


def augment(g: Graph, introns: list[tuple[int, int]], depth: Depth, cfg: Config, outside: tuple[frozenset, frozenset] = (frozenset(), frozenset())) -> Graph:
    """Cassette exons, retentions, short exons, then introns until nothing changes."""
    g = g.copy()
    if cfg.insert_cassettes:
        add_cassettes(g, introns, depth, cfg.cassette)
    if cfg.insert_retentions:
        add_retentions(g, depth, cfg.retention)
    if cfg.remove_short:
        drop_short(g)
    if cfg.insert_edges:
        for _ in range(cfg.iterations):
            if not add_introns(g, introns, depth, cfg.edges, outside)[0]:
                break
    return g


ROW = "sample string, gene_id string, us int, ue int, vs int, ve int"


def augmented(vertices: DataFrame, edges: DataFrame, introns: DataFrame, runs: DataFrame, neighbours: DataFrame, cfg: Config) -> DataFrame:
    """sample, gene_id, us, ue, vs, ve of each gene's graph in each sample with introns or depth for it; a vertex is a row without vs, ve.

    What the other samples have is :func:`untouched`.  One task call holds one gene of one
    sample: its exons, introns, depth runs and the neighbouring genes' exon ends (as they
    are before any change)."""
    active = introns.select("sample", "gene_id").unionByName(runs.select("sample", "gene_id")).distinct()
    kinds = [
        vertices.select("gene_id", F.lit("v").alias("kind"), *_ints("v_start", "v_end", None, None)).join(active, "gene_id"),
        edges.select("gene_id", F.lit("e").alias("kind"), *_ints("us", "ue", "vs", "ve")).join(active, "gene_id"),
        neighbours.select("gene_id", "kind", *_ints("at", None, None, None)).join(active, "gene_id"),
        introns.select("gene_id", F.lit("i").alias("kind"), *_ints("i_start", "i_end", None, None), "sample"),
        runs.select("gene_id", F.lit("d").alias("kind"), *_ints("run_start", "run_end", "depth", None), "sample"),
    ]
    return _applied(reduce(DataFrame.unionByName, kinds), cfg)


def untouched(vertices: DataFrame, edges: DataFrame, cfg: Config) -> DataFrame:
    """gene_id, us, ue, vs, ve of each gene's graph where a sample has neither introns nor depth for it: the same in all of them."""
    if not cfg.remove_short:
        return vertices.select("gene_id", *_ints("v_start", "v_end", None, None)).unionByName(edges.select("gene_id", *_ints("us", "ue", "vs", "ve"))).toDF("gene_id", "us", "ue", "vs", "ve").distinct()
    one = F.lit("").alias("sample")
    rows = vertices.select("gene_id", F.lit("v").alias("kind"), *_ints("v_start", "v_end", None, None), one).unionByName(edges.select("gene_id", F.lit("e").alias("kind"), *_ints("us", "ue", "vs", "ve"), one))
    return _applied(rows, cfg).drop("sample")


MAX_VERTICES = 10_000  # of a gene, beyond which it takes no more of other samples


def merged(each: DataFrame, plain: DataFrame, samples: list[str], limit: int = MAX_VERTICES) -> DataFrame:
    """gene_id, us, ue, vs, ve, n_samples over all samples' graphs in the order of ``samples``: those of ``each``, and ``plain`` in the samples that a gene has no rows of.

    Genes beyond ``limit`` vertices stop as in :func:`junctura.operators.graph.bounded_merge`."""
    key = ["gene_id", "us", "ue", "vs", "ve"]
    place = F.array_position(F.lit(samples), F.col("sample"))
    placed = each.select(*key, place.cast("int").alias("place"))
    active = placed.groupBy("gene_id").agg(F.collect_set("place").alias("active"))
    rest = F.array_except(F.sequence(F.lit(1), F.lit(len(samples))), F.coalesce("active", F.array().cast("array<int>")))
    others = plain.join(active, "gene_id", "left").withColumn("rest", rest).where(F.size("rest") > 0)
    rows = placed.select(*key, "place", F.lit(1).cast("long").alias("n")).unionByName(others.select(*key, F.array_min("rest").alias("place"), F.size("rest").cast("long").alias("n")))
    return graph.bounded_merge(rows, limit)


def _applied(rows: DataFrame, cfg: Config) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = {k: v for k, v in pdf.groupby("kind")}
        take = lambda k, n: part[k].iloc[:, 2 : 2 + n].astype(int).itertuples(index=False, name=None) if k in part else ()
        edges = [((a, b), (c, d)) for a, b, c, d in take("e", 4)]
        d = list(take("d", 3))
        depth = Depth(*(np.array([x[i] for x in d], int) for i in range(3)))
        outside = tuple(frozenset(x[0] for x in take(k, 1)) for k in ("p", "n"))
        g = augment(Graph(take("v", 2), edges), list(take("i", 2)), depth, cfg, outside)
        out = [(*key, *v, None, None) for v in sorted(g.vertices)] + [(*key, *a, *b) for a, b in sorted(g.edges)]
        return pd.DataFrame(out, columns=["sample", "gene_id", "us", "ue", "vs", "ve"]).astype({c: "Int32" for c in ("us", "ue", "vs", "ve")})

    return rows.select("gene_id", "kind", "c0", "c1", "c2", "c3", "sample").groupBy("sample", "gene_id").applyInPandas(run, ROW)


def _ints(*names) -> list:
    return [(F.col(n) if n else F.lit(None)).cast("int").alias(f"c{i}") for i, n in enumerate(names)]


def neighbour_ends(genes: DataFrame, vertices: DataFrame) -> DataFrame:
    """gene_id, kind, at: exon ends of the previous gene ("p") and exon starts of the next one ("n"), by contig and strand."""
    by = Window.partitionBy("contig", "strand").orderBy("g_start", "g_end", "gene_id")
    placed = genes.select("gene_id", F.lag("gene_id").over(by).alias("prev"), F.lead("gene_id").over(by).alias("next"))
    v = vertices.select(F.col("gene_id").alias("other"), "v_start", "v_end")
    before = placed.join(v, F.col("prev") == F.col("other")).select("gene_id", F.lit("p").alias("kind"), F.col("v_end").alias("at"))
    after = placed.join(v, F.col("next") == F.col("other")).select("gene_id", F.lit("n").alias("kind"), F.col("v_start").alias("at"))
    return before.unionByName(after).distinct()
