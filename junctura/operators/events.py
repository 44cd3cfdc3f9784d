"""Alternative-splicing events as joins over the edge table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.operators import neighbours

MIN_OVERLAP = 11
TRIPLE = ["gene_id", "e1s", "e1e", "e2s", "e2e", "e3s", "e3e"]


def _edge(edges: DataFrame, left: str, right: str) -> DataFrame:
    return edges.select("gene_id", F.col("us").alias(f"{left}s"), F.col("ue").alias(f"{left}e"), F.col("vs").alias(f"{right}s"), F.col("ve").alias(f"{right}e"))


def small_genes(edges: DataFrame, vertices: DataFrame, limit: int) -> DataFrame:
    """The edges of genes with at most ``limit`` vertices."""
    few = vertices.groupBy("gene_id").agg(F.count("*").alias("n")).where(F.col("n") <= limit)
    return edges.join(few.select("gene_id"), "gene_id", "left_semi")


def exon_skip(edges: DataFrame) -> DataFrame:
    """a-b, b-c and a-c: exon b is skipped.

    The direct edge is joined first on the shared left exon's gene and ends, so the
    shuffle by gene serves all three sides."""
    ab, bc, ac = _edge(edges, "e1", "e2"), _edge(edges, "e2", "e3"), _edge(edges, "e1", "e3")
    return ab.join(bc, ["gene_id", "e2s", "e2e"]).join(ac, ["gene_id", "e1s", "e1e", "e3s", "e3e"], "left_semi").select(*TRIPLE)


def mutex_exons(edges: DataFrame) -> DataFrame:
    """a-b-d and a-c-d with c right of b and no edge b-c."""
    rows = neighbours.mutex_pairs(neighbours.linked(edges, ["gene_id"], F.lit(1), F.lit(1)), ["gene_id"])
    return rows.select("gene_id", *neighbours.coordinates({f"e{i}": x for i, x in enumerate("abcd", 1)}))


def intron_retention(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Introns that a vertex covers: one event for each intron, with the smallest left start, then right end."""
    v = vertices.select("gene_id", F.col("v_start").alias("x"), F.col("v_end").alias("y"))
    held = edges.join(v, (edges["gene_id"] == v["gene_id"]) & (v["x"] < edges["ue"]) & (v["y"] > edges["vs"]), "left_semi")
    best = F.min(F.struct("us", "ve")).alias("best")
    return held.groupBy("gene_id", "ue", "vs").agg(best).select("gene_id", F.col("best.us").alias("e1s"), F.col("ue").alias("e1e"), F.col("vs").alias("e2s"), F.col("best.ve").alias("e2e"))


def _overlapping(a: Column, b: Column, c: Column, d: Column, least: int) -> Column:
    return F.least(b, d) - F.greatest(a, c) >= least


def alt_right(edges: DataFrame, least: int = MIN_OVERLAP) -> DataFrame:
    """One left exon, two overlapping right exons with different starts: alt 3' on plus, alt 5' on minus."""
    x, y = _edge(edges, "e1", "e2"), _edge(edges, "e1", "e3")
    pairs = x.join(y, ["gene_id", "e1s", "e1e"]).where(F.col("e2s") < F.col("e3s"))
    return pairs.where(_overlapping(*map(F.col, ("e2s", "e2e", "e3s", "e3e")), least)).select(*TRIPLE)


def alt_left(edges: DataFrame, least: int = MIN_OVERLAP) -> DataFrame:
    """One right exon, two overlapping left exons with different ends."""
    x, y = _edge(edges, "e1", "e3"), _edge(edges, "e2", "e3")
    pairs = x.join(y, ["gene_id", "e3s", "e3e"]).where(F.col("e1e") < F.col("e2e"))
    return pairs.where(_overlapping(*map(F.col, ("e1s", "e1e", "e2s", "e2e")), least)).select(*TRIPLE)


def mult_exon_skip(edges: DataFrame, limit: int = 500) -> DataFrame:
    """For each edge the path of three edges or more between its exons: gene_id, us, ue, vs, ve, inner (exons).

    The shortest path besides the edge, if it has more than two edges, else the
    longest.  Paths are found in one gene's graph at a time; genes with more than
    ``limit`` vertices give none."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pairs = np.unique(rows[["us", "ue", "vs", "ve"]].to_numpy(dtype=np.int64), axis=0)
        nodes, at = np.unique(pairs.reshape(-1, 2), axis=0, return_inverse=True)
        found = [] if len(nodes) > limit else [
            (key[0], *nodes[a].tolist(), *nodes[b].tolist(), [{"start": s, "stop": e} for s, e in nodes[inner].tolist()])
            for a, b, inner in _detours(len(nodes), at.reshape(-1, 2))
        ]
        return pd.DataFrame(found, columns=["gene_id", "us", "ue", "vs", "ve", "inner"])

    return edges.groupBy("gene_id").applyInPandas(run, f"gene_id {dict(edges.dtypes)['gene_id']}, us long, ue long, vs long, ve long, inner array<struct<start:long,stop:long>>")


def _detours(n: int, pairs: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """For each edge a-b the inner vertices of the path from a to b besides it: the shortest
    if it has more than two edges, else the longest if that has; edges without one are left out.

    Vertices are numbers in order, ``pairs`` are sorted.  The best lengths from all vertices
    are found in one pass over the vertices; of equal ways the one over the first vertex is taken."""
    before = [pairs[pairs[:, 1] == w, 0] for w in range(n)]
    best, length = [], []
    for sign in (1, -1):  # the longest has the least negative length
        cost = np.full((n, n), np.inf)  # of the best path from a column's vertex to a row's
        np.fill_diagonal(cost, 0)
        last = np.full((n, n), -1)
        around, over = {}, {}
        for w, ways in enumerate(before):
            if len(ways):
                each = cost[ways] + sign
                first = each.argmin(axis=0)
                cost[w] = np.where(np.arange(n) == w, 0, each[first, np.arange(n)])
                last[w] = ways[first]
                direct = each[:, ways]  # from the vertices with an edge to w, without that edge
                np.fill_diagonal(direct, np.inf)
                first = direct.argmin(axis=0)
                around[w], over[w] = direct[first, np.arange(len(ways))] * sign, ways[first]
        best.append((around, over))
        length.append(last)
    found = []
    for b, ways in enumerate(before):
        for i, a in enumerate(ways.tolist()):
            for (around, over), last in zip(best, length):
                if np.isfinite(around[b][i]) and around[b][i] > 2:
                    inner, v = [], int(over[b][i])
                    while v != a:
                        inner.append(v)
                        v = int(last[v, a])
                    found.append((a, b, inner[::-1]))
                    break
    return found


def deduplicated(events: DataFrame, keys: list[str], inner: list[str], span: tuple[str, str], order: list[str]) -> DataFrame:
    """Of events with equal inner coordinates the one of the shortest span, of equals the last in ``order``."""
    by = Window.partitionBy(*keys, *inner).orderBy((F.col(span[1]) - F.col(span[0])).asc(), *[F.col(c).desc() for c in order])
    return events.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def numbered(events: DataFrame, order: list[str], lead: int) -> DataFrame:
    """Ids from 1 in ``order``: ranks within groups of the first ``lead`` columns, plus
    the counts of the groups before.  Only the counts (a row a gene or contig) meet in one task."""
    groups = order[:lead]
    counts = events.groupBy(*groups).agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = events.withColumn("__r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order[lead:])))
    return ranked.join(counts.select(*groups, before.alias("__b")), groups).withColumn("event_id", (F.col("__r") + F.col("__b")).cast("long")).drop("__r", "__b")


def annotated(events: DataFrame, introns: DataFrame, iso1: list[tuple[str, str]], iso2: list[tuple[str, str]]) -> DataFrame:
    """``annotated`` = 3, less 1 if an intron of isoform 1 is not annotated, less 2 for isoform 2."""
    out, flags = events, []
    for i, (s, e) in enumerate([*iso1, *iso2]):
        known = introns.select("gene_id", F.col("i_start").alias(s), F.col("i_end").alias(e), F.lit(True).alias(f"__k{i}")).distinct()
        out = out.join(known, ["gene_id", s, e], "left")
        flags.append(F.col(f"__k{i}").isNull())
    one = F.lit(False)
    two = F.lit(False)
    for i, f in enumerate(flags):
        one, two = (one | f, two) if i < len(iso1) else (one, two | f)
    return out.withColumn("annotated", (3 - one.cast("int") - 2 * two.cast("int")).cast("long")).drop(*[f"__k{i}" for i in range(len(flags))])


def curate_alt(events: DataFrame) -> DataFrame:
    """Alt right: overlapping exons are trimmed to the shorter outer end; introns must not be empty."""
    end = F.least("e2e", "e3e")
    trimmed = events.where("e2s > e1e AND e3s > e1e").withColumn("__e", end)
    return trimmed.withColumn("e2e", F.col("__e")).withColumn("e3e", F.col("__e")).drop("__e").where("e2e > e2s AND e3e > e3s")


def curate_alt_left(events: DataFrame) -> DataFrame:
    """Alt left: overlapping exons are trimmed to the later outer start; introns must not be empty."""
    start = F.greatest("e1s", "e2s")
    trimmed = events.where("e3s > e1e AND e3s > e2e").withColumn("__s", start)
    return trimmed.withColumn("e1s", F.col("__s")).withColumn("e2s", F.col("__s")).drop("__s").where("e1e > e1s AND e2e > e2s")


def annotated_paths(events: DataFrame, introns: DataFrame) -> DataFrame:
    """``annotated`` of events of :func:`mult_exon_skip`: 3, less 1 if the skipping intron is not annotated, less 2 if one of the path's is not."""
    key = ["gene_id", "us", "ue", "vs", "ve"]
    ends, starts = F.concat(F.array("ue"), F.transform("inner", lambda x: x["stop"])), F.concat(F.transform("inner", lambda x: x["start"]), F.array("vs"))
    steps = events.select(*key, F.explode(F.arrays_zip(ends.alias("s"), starts.alias("e"))).alias("i"), F.lit(2).alias("bit")).select(*key, F.col("i.s").alias("i_start"), F.col("i.e").alias("i_end"), "bit")
    skip = events.select(*key, F.col("ue").alias("i_start"), F.col("vs").alias("i_end"), F.lit(1).alias("bit"))
    known = introns.select("gene_id", "i_start", "i_end").distinct().withColumn("known", F.lit(True))
    novel = steps.unionByName(skip).join(known, ["gene_id", "i_start", "i_end"], "left").where("known IS NULL").groupBy(*key).agg(F.bit_or("bit").alias("bits"))
    return events.join(novel, key, "left").withColumn("annotated", (3 - F.coalesce("bits", F.lit(0))).cast("long")).drop("bits")


def path_inner(events: DataFrame) -> DataFrame:
    """``events`` of :func:`mult_exon_skip` with ``inner_coords``: of the path's coordinates the second to fourth and the three before the last."""
    flat = F.flatten(F.concat(F.array(F.array("us", "ue")), F.transform("inner", lambda x: F.array(x["start"], x["stop"])), F.array(F.array("vs", "ve"))))
    return events.withColumn("inner_coords", F.sort_array(F.array_distinct(F.concat(F.slice(F.sort_array(flat), 2, 3), F.slice(F.sort_array(flat), -4, 3)))))
