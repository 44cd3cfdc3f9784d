"""Queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.config import Evidence, Retention
from junctura.functions import multiple_testing, sequence
from junctura.operators import events, graph, intervals, neighbours, quant, quantify, reads, testing, verify
from junctura.plans import viz_data
from junctura.plans.projection import EDGE, EXON, PAIR, READ, VERTEX, aligned, exons
from junctura.sources import placed, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString() == "int" else F.col(f.name) for f in df.schema])


def rounded(c: str | Column, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


WITH = f"WITH {EXON}, {PAIR}, {EDGE}, {VERTEX}"


@query(f"WITH {EXON} SELECT * FROM exon")
def exon_rows(spark, sf_dir):
    return exons(spark, sf_dir)


@query(f"{WITH} SELECT * FROM vertex")
def vertices(spark, sf_dir):
    return graph.vertices(exons(spark, sf_dir))


@query(f"{WITH} SELECT * FROM edge")
def edges(spark, sf_dir):
    return graph.edges(exons(spark, sf_dir))


@query(f"{WITH} SELECT DISTINCT gene_id, ue AS i_start, vs AS i_end FROM edge")
def annotated_introns(spark, sf_dir):
    return graph.introns(exons(spark, sf_dir))


@query(f"""{WITH} SELECT gene_id, v_start, v_end,
  NOT EXISTS (SELECT 1 FROM edge e WHERE e.gene_id = v.gene_id AND e.vs = v_start AND e.ve = v_end) AS is_start,
  NOT EXISTS (SELECT 1 FROM edge e WHERE e.gene_id = v.gene_id AND e.us = v_start AND e.ue = v_end) AS is_end
FROM vertex v""")
def terminals(spark, sf_dir):
    return graph.exon_terminals(exons(spark, sf_dir))


SKIP = """skip AS (
SELECT a.gene_id, a.us e1s, a.ue e1e, a.vs e2s, a.ve e2e, b.vs e3s, b.ve e3e
FROM edge a JOIN edge b ON a.gene_id = b.gene_id AND a.vs = b.us AND a.ve = b.ue
JOIN edge c ON c.gene_id = a.gene_id AND c.us = a.us AND c.ue = a.ue AND c.vs = b.vs AND c.ve = b.ve)"""


@query(f"{WITH}, {SKIP} SELECT * FROM skip")
def exon_skip(spark, sf_dir):
    return events.exon_skip(graph.edges(exons(spark, sf_dir)))


MUTEX = """path AS MATERIALIZED (SELECT a.gene_id, a.us "as", a.ue ae, a.vs bs, a.ve be, b.vs ds, b.ve de
  FROM edge a JOIN edge b ON a.gene_id = b.gene_id AND a.vs = b.us AND a.ve = b.ue),
both_ways AS MATERIALIZED (SELECT p.gene_id, p."as" e1s, p.ae e1e, p.bs e2s, p.be e2e, q.bs e3s, q.be e3e, p.ds e4s, p.de e4e
  FROM path p JOIN path q ON p.gene_id = q.gene_id AND p."as" = q."as" AND p.ae = q.ae AND p.ds = q.ds AND p.de = q.de WHERE q.bs >= p.be),
mutex AS (SELECT b.* FROM both_ways b ANTI JOIN edge e ON e.gene_id = b.gene_id AND e.us = b.e2s AND e.ue = b.e2e AND e.vs = b.e3s AND e.ve = b.e3e)"""


@query(f"{WITH}, {MUTEX} SELECT * FROM mutex")
def mutex_exons(spark, sf_dir):
    return events.mutex_exons(graph.edges(exons(spark, sf_dir)))


@query(f"""{WITH}, held AS (SELECT * FROM edge e WHERE EXISTS (
    SELECT 1 FROM vertex v WHERE v.gene_id = e.gene_id AND v.v_start < e.ue AND v.v_end > e.vs))
SELECT gene_id, us e1s, ue e1e, vs e2s, ve e2e FROM (
  SELECT *, row_number() OVER (PARTITION BY gene_id, ue, vs ORDER BY us, ve) rn FROM held) t WHERE rn = 1""")
def intron_retention(spark, sf_dir):
    e = exons(spark, sf_dir)
    return events.intron_retention(graph.edges(e), graph.vertices(e))


@query(f"""{WITH} SELECT x.gene_id, x.us e1s, x.ue e1e, x.vs e2s, x.ve e2e, y.vs e3s, y.ve e3e
FROM edge x JOIN edge y ON x.gene_id = y.gene_id AND x.us = y.us AND x.ue = y.ue
WHERE x.vs < y.vs AND least(x.ve, y.ve) - greatest(x.vs, y.vs) >= 11""")
def alt_right(spark, sf_dir):
    return events.alt_right(graph.edges(exons(spark, sf_dir)))


LEFT = """alt AS (SELECT x.gene_id, x.us e1s, x.ue e1e, y.us e2s, y.ue e2e, x.vs e3s, x.ve e3e
FROM edge x JOIN edge y ON x.gene_id = y.gene_id AND x.vs = y.vs AND x.ve = y.ve
WHERE x.ue < y.ue AND least(x.ue, y.ue) - greatest(x.us, y.us) >= 11)"""


@query(f"{WITH}, {LEFT} SELECT * FROM alt")
def alt_left(spark, sf_dir):
    return events.alt_left(graph.edges(exons(spark, sf_dir)))


MULT = """hop AS MATERIALIZED (SELECT gene_id, {'s': us, 'e': ue} AS a, {'s': vs, 'e': ve} AS b FROM edge),
way AS (
  SELECT gene_id, a AS first, b AS last, 1 AS n, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS back FROM hop
  UNION ALL
  SELECT way.gene_id, first, hop.b, n + 1, list_prepend(way.last, back) FROM way JOIN hop ON hop.gene_id = way.gene_id AND hop.a = way.last),
around AS (
  SELECT w.gene_id, w.first, w.last, n, back, row_number() OVER (PARTITION BY w.gene_id, w.first, w.last ORDER BY n, back) AS low, row_number() OVER (PARTITION BY w.gene_id, w.first, w.last ORDER BY n DESC, back) AS high
  FROM way w SEMI JOIN hop s ON s.gene_id = w.gene_id AND s.a = w.first AND s.b = w.last WHERE n > 1),
chosen AS (
  SELECT gene_id, first, last, coalesce(max(back) FILTER (low = 1 AND n > 2), max(back) FILTER (high = 1 AND n > 2)) AS back FROM around GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {EXON}, {PAIR}, {EDGE}, {MULT}
SELECT gene_id, first.s AS us, first.e AS ue, last.s AS vs, last.e AS ve, len(back) AS n_inner,
  array_to_string(list_transform(list_reverse(back), lambda x: concat(x.s, '-', x.e)), ':') AS inner_exons FROM chosen WHERE back IS NOT NULL""")
def mult_exon_skip(spark, sf_dir):
    out = events.mult_exon_skip(graph.edges(exons(spark, sf_dir)))
    return out.select("gene_id", "us", "ue", "vs", "ve", F.size("inner").cast("long").alias("n_inner"), F.array_join(F.transform("inner", lambda x: F.concat_ws("-", x["start"], x["stop"])), ":").alias("inner_exons"))


DEDUP = f"""{WITH}, {SKIP}, one AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY gene_id, e1e, e2s, e2e, e3s ORDER BY e3e - e1s, e1s DESC, e3e DESC) rn FROM skip) t WHERE rn = 1)"""


def _skip_events(spark, sf_dir):
    found = events.exon_skip(graph.edges(exons(spark, sf_dir)))
    return events.deduplicated(found, ["gene_id"], ["e1e", "e2s", "e2e", "e3s"], ("e1s", "e3e"), ["e1s", "e3e"])


@query(f"{DEDUP} SELECT gene_id, e1s, e1e, e2s, e2e, e3s, e3e FROM one")
def exon_skip_dedup(spark, sf_dir):
    return _skip_events(spark, sf_dir)


@query(f"{DEDUP} SELECT gene_id, e1s, e1e, e2s, e2e, e3s, e3e, row_number() OVER (ORDER BY gene_id, e1e, e2s, e2e, e3s) AS event_id FROM one")
def event_ids(spark, sf_dir):
    return events.numbered(_skip_events(spark, sf_dir), ["gene_id", "e1e", "e2s", "e2e", "e3s"], 1)


@query(f"""{DEDUP}, known AS (SELECT DISTINCT gene_id, ue AS s, vs AS e FROM pair WHERE transcript_id % 2 = 1)
SELECT o.gene_id, e1s, e1e, e2s, e2e, e3s, e3e,
  3 - CASE WHEN NOT EXISTS (SELECT 1 FROM known k WHERE k.gene_id = o.gene_id AND k.s = e1e AND k.e = e3s) THEN 1 ELSE 0 END
    - CASE WHEN NOT EXISTS (SELECT 1 FROM known k WHERE k.gene_id = o.gene_id AND k.s = e1e AND k.e = e2s)
             OR NOT EXISTS (SELECT 1 FROM known k WHERE k.gene_id = o.gene_id AND k.s = e2e AND k.e = e3s) THEN 2 ELSE 0 END AS annotated
FROM one o""")
def annotated_flag(spark, sf_dir):
    e = exons(spark, sf_dir)
    return longs(events.annotated(_skip_events(spark, sf_dir), graph.introns(e.where("transcript_id % 2 = 1")), [("e1e", "e3s")], [("e1e", "e2s"), ("e2e", "e3s")]))


@query(f"""{WITH}, alt AS (SELECT x.gene_id, x.us e1s, x.ue e1e, x.vs e2s, x.ve e2e, y.vs e3s, y.ve e3e
  FROM edge x JOIN edge y ON x.gene_id = y.gene_id AND x.us = y.us AND x.ue = y.ue
  WHERE x.vs < y.vs AND least(x.ve, y.ve) - greatest(x.vs, y.vs) >= 11)
SELECT gene_id, e1s, e1e, e2s, least(e2e, e3e) e2e, e3s, least(e2e, e3e) e3e FROM alt
WHERE e2s > e1e AND e3s > e1e AND least(e2e, e3e) > e2s AND least(e2e, e3e) > e3s""")
def curated_alt_right(spark, sf_dir):
    return events.curate_alt(events.alt_right(graph.edges(exons(spark, sf_dir))))


RUNS = """step AS (SELECT gene_id, sample_id, pos, sum(d) AS d FROM (
    SELECT gene_id, sample_id, ex_start AS pos, 1 AS d FROM exon UNION ALL SELECT gene_id, sample_id, ex_end, -1 FROM exon) t GROUP BY ALL),
runs AS (SELECT * FROM (
  SELECT gene_id, sample_id, pos AS run_start, lead(pos) OVER w AS run_end, CAST(sum(d) OVER w AS BIGINT) AS depth
  FROM step WINDOW w AS (PARTITION BY gene_id, sample_id ORDER BY pos)) t WHERE depth > 0 AND run_end IS NOT NULL)"""
SEGS = """point AS (SELECT DISTINCT gene_id, v_start AS pos FROM vertex UNION SELECT DISTINCT gene_id, v_end FROM vertex),
seg AS (SELECT * FROM (SELECT gene_id, pos AS seg_start, lead(pos) OVER (PARTITION BY gene_id ORDER BY pos) AS seg_end FROM point) p
  WHERE seg_end IS NOT NULL AND EXISTS (SELECT 1 FROM vertex v WHERE v.gene_id = p.gene_id AND v.v_start <= seg_start AND v.v_end >= seg_end))"""
COV = """cov AS (SELECT s.gene_id, sample_id, seg_start, seg_end,
    sum((least(seg_end, run_end) - greatest(seg_start, run_start)) * depth) / (seg_end - seg_start) AS mean_cov,
    CAST(sum(least(seg_end, run_end) - greatest(seg_start, run_start)) AS BIGINT) AS covered
  FROM seg s JOIN runs r ON s.gene_id = r.gene_id AND seg_start < run_end AND run_start < seg_end GROUP BY s.gene_id, sample_id, seg_start, seg_end)"""


def _cov(spark, sf_dir) -> DataFrame:
    e = exons(spark, sf_dir)
    runs = intervals.coverage_runs(e, ["gene_id", "sample_id"], "ex_start", "ex_end")
    return intervals.segment_coverage(graph.segments(graph.vertices(e)), runs, ["gene_id"], ["sample_id"])


@query(f"WITH {EXON}, {RUNS} SELECT * FROM runs")
def coverage_runs(spark, sf_dir):
    return intervals.coverage_runs(exons(spark, sf_dir), ["gene_id", "sample_id"], "ex_start", "ex_end")


@query(f"{WITH}, {SEGS} SELECT * FROM seg")
def segments(spark, sf_dir):
    return graph.segments(graph.vertices(exons(spark, sf_dir)))


@query(f"{WITH}, {SEGS} SELECT v.gene_id, v_start, v_end, seg_start, seg_end FROM vertex v JOIN seg s ON v.gene_id = s.gene_id AND v_start <= seg_start AND seg_end <= v_end")
def vertex_segment(spark, sf_dir):
    v = graph.vertices(exons(spark, sf_dir))
    return graph.vertex_segments(v, graph.segments(v))


SEG_EDGE = """seg_edge AS (SELECT DISTINCT e.gene_id, d.seg_start AS d_start, e.ue AS d_end, e.vs AS a_start, a.seg_end AS a_end
  FROM edge e JOIN seg d ON d.gene_id = e.gene_id AND d.seg_end = e.ue JOIN seg a ON a.gene_id = e.gene_id AND a.seg_start = e.vs)"""


@query(f"{WITH}, {SEGS}, {SEG_EDGE} SELECT * FROM seg_edge")
def segment_edges(spark, sf_dir):
    e = exons(spark, sf_dir)
    return graph.segment_edges(graph.edges(e), graph.segments(graph.vertices(e)))


@query(f"{WITH}, {RUNS}, {SEGS}, {COV} SELECT gene_id, sample_id, seg_start, seg_end, round(mean_cov, 6) AS mean_cov, covered FROM cov")
def segment_coverage(spark, sf_dir):
    return _cov(spark, sf_dir).withColumn("mean_cov", rounded("mean_cov"))


JUNCTION = "junction AS (SELECT sample_id, gene_id, ue AS i_start, vs AS i_end, count(*) AS n FROM pair GROUP BY ALL)"


@query(f"{WITH}, {JUNCTION} SELECT * FROM junction")
def junction_counts(spark, sf_dir):
    return quant.junction_counts(exons(spark, sf_dir))


SUPPORT = "support AS (SELECT gene_id, us, ue, vs, ve, count(DISTINCT sample_id) AS n_samples FROM pair GROUP BY ALL)"


@query(f"{WITH}, {SUPPORT} SELECT * FROM support")
def edge_support(spark, sf_dir):
    return graph.edge_support(exons(spark, sf_dir))


@query(f"{WITH}, {SUPPORT} SELECT * FROM support WHERE n_samples >= 2")
def validated_edges(spark, sf_dir):
    return graph.validated(graph.edge_support(exons(spark, sf_dir)), 2)


@query(f"""{WITH}, {SUPPORT}, kept AS (SELECT * FROM support WHERE n_samples >= 2)
SELECT gene_id, v_start, v_end FROM vertex v WHERE EXISTS (SELECT 1 FROM kept e WHERE e.gene_id = v.gene_id AND ((e.us = v_start AND e.ue = v_end) OR (e.vs = v_start AND e.ve = v_end)))
  OR NOT EXISTS (SELECT 1 FROM support e WHERE e.gene_id = v.gene_id AND ((e.us = v_start AND e.ue = v_end) OR (e.vs = v_start AND e.ve = v_end)))""")
def validated_vertices(spark, sf_dir):
    e = exons(spark, sf_dir)
    support = graph.edge_support(e)
    return graph.validated_vertices(graph.vertices(e), support, graph.validated(support, 2))


# genes on contigs: a gene's span lies at an offset of its own; contig = gene_id % 4
PLACED = """gene AS (SELECT gene_id % 4 AS contig, gene_id, min(ex_start) + (gene_id // 4) * 900 AS g_start, max(ex_end) + (gene_id // 4) * 900 AS g_end FROM exon GROUP BY gene_id),
intron AS (SELECT DISTINCT gene_id % 4 AS contig, ue + (gene_id // 4) * 900 AS i_start, vs + (gene_id // 4) * 900 AS i_end FROM pair)"""


def _placed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = exons(spark, sf_dir)
    at = F.floor(F.col("gene_id") / 4) * 900
    genes = e.groupBy("gene_id").agg(F.min("ex_start").alias("s"), F.max("ex_end").alias("e")).select((F.col("gene_id") % 4).alias("contig"), "gene_id", (F.col("s") + at).alias("g_start"), (F.col("e") + at).alias("g_end"))
    introns = graph.introns(e).select((F.col("gene_id") % 4).alias("contig"), (F.col("i_start") + at).alias("i_start"), (F.col("i_end") + at).alias("i_end")).distinct()
    return genes, introns


@query(f"""{WITH}, {PLACED} SELECT i.contig, i_start, i_end FROM intron i JOIN gene g ON g.contig = i.contig AND i_start - 200 < g_end AND g_start < i_end + 200
GROUP BY ALL HAVING count(*) = 1""")
def ambiguity_filter(spark, sf_dir):
    genes, introns = _placed(spark, sf_dir)
    return graph.unambiguous(introns, genes, 200, 4096)


@query(f"""{WITH}, {PLACED} SELECT a.contig, a.gene_id, count(*) AS n_overlaps FROM gene a JOIN gene b ON a.contig = b.contig AND a.gene_id <> b.gene_id AND a.g_start < b.g_end AND b.g_start < a.g_end GROUP BY ALL""")
def overlapping_genes(spark, sf_dir):
    genes, _ = _placed(spark, sf_dir)
    other = genes.select("contig", F.col("gene_id").alias("other"), F.col("g_start").alias("o_start"), F.col("g_end").alias("o_end"))
    pairs = intervals.interval_join(genes, other, ["contig"], ("g_start", "g_end"), ("o_start", "o_end"), 4096)
    return pairs.where("gene_id <> other").groupBy("contig", "gene_id").agg(F.count("*").alias("n_overlaps"))


@query(f"""{WITH}, {PLACED} SELECT j.gene_id, count(*) AS n_introns, min(i_start) AS first_intron FROM gene j JOIN intron i ON j.contig = i.contig AND i_start > g_start - 5000 AND i_end < g_end + 5000 GROUP BY ALL""")
def window_introns(spark, sf_dir):
    genes, introns = _placed(spark, sf_dir)
    wide = genes.withColumn("w_start", F.col("g_start") - 5000).withColumn("w_end", F.col("g_end") + 5000)
    pairs = intervals.interval_join(wide, introns, ["contig"], ("w_start", "w_end"), ("i_start", "i_end"), 16384)
    return pairs.where("i_start > w_start AND i_end < w_end").groupBy("gene_id").agg(F.count("*").alias("n_introns"), F.min("i_start").alias("first_intron"))


@query(f"""{WITH}, span AS (SELECT gene_id, v_start AS s, v_end AS e FROM vertex UNION ALL SELECT DISTINCT gene_id, ue, vs FROM edge),
step AS (SELECT gene_id, pos, sum(d) AS d FROM (SELECT gene_id, s AS pos, 1 AS d FROM span UNION ALL SELECT gene_id, e, -1 FROM span) t GROUP BY ALL),
depth AS (SELECT gene_id, sum(d) OVER (PARTITION BY gene_id ORDER BY pos) AS n FROM step)
SELECT gene_id, CAST(max(n) AS BIGINT) AS max_depth, max(n) > 1 AS is_alt FROM depth GROUP BY gene_id""")
def label_alt(spark, sf_dir):
    e = exons(spark, sf_dir)
    return graph.label_alt(graph.vertices(e), graph.edges(e))


@query(f"""{WITH}, v AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY v_start, v_end) AS k FROM vertex),
e AS (SELECT e.gene_id, e.us, e.ue, e.vs, e.ve, a.k AS u, b.k AS v FROM edge e JOIN v a ON a.gene_id = e.gene_id AND a.v_start = e.us AND a.v_end = e.ue
  JOIN v b ON b.gene_id = e.gene_id AND b.v_start = e.vs AND b.v_end = e.ve),
f AS (SELECT v.*, (SELECT string_agg(e.v, ',' ORDER BY e.v) FROM e WHERE e.gene_id = v.gene_id AND e.u = v.k) AS next,
  (SELECT string_agg(e.u, ',' ORDER BY e.u) FROM e WHERE e.gene_id = v.gene_id AND e.v = v.k) AS last,
  (SELECT max(e.ue) FROM e WHERE e.gene_id = v.gene_id AND e.v = v.k) AS end_before,
  (SELECT min(w.v_start) FROM e JOIN v w ON w.gene_id = e.gene_id AND w.k = e.v - 1 WHERE e.gene_id = v.gene_id AND e.u = v.k) AS near FROM v),
simple AS (
  SELECT i.gene_id, i.v_start, i.v_end FROM f i JOIN f j ON i.gene_id = j.gene_id AND i.v_end = j.v_end AND i.k <> j.k WHERE i.last IS NULL
  GROUP BY ALL HAVING NOT bool_or(i.next IS DISTINCT FROM j.next OR coalesce(j.end_before > i.v_start, false))
  UNION
  SELECT i.gene_id, i.v_start, i.v_end FROM f i JOIN f j ON i.gene_id = j.gene_id AND i.v_start = j.v_start AND i.k <> j.k WHERE i.next IS NULL
  GROUP BY ALL HAVING NOT bool_or(i.last IS DISTINCT FROM j.last OR coalesce(j.near < i.v_end, false))),
rest AS (SELECT gene_id, v_start, v_end FROM vertex ANTI JOIN simple USING (gene_id, v_start, v_end)),
span AS (SELECT gene_id, v_start AS s, v_end AS e FROM rest UNION ALL SELECT e.gene_id, e.ue, e.vs FROM e
  SEMI JOIN rest a ON a.gene_id = e.gene_id AND a.v_start = e.us AND a.v_end = e.ue SEMI JOIN rest b ON b.gene_id = e.gene_id AND b.v_start = e.vs AND b.v_end = e.ve),
deep AS (SELECT gene_id, max(d) AS d FROM (
  SELECT p.gene_id, p.s, count(*) AS d FROM (SELECT DISTINCT gene_id, s FROM span) p JOIN span q ON q.gene_id = p.gene_id AND q.s <= p.s AND q.e > p.s GROUP BY ALL) GROUP BY gene_id),
n AS (SELECT gene_id, count(*) AS n FROM vertex GROUP BY gene_id)
SELECT n.gene_id, n > 1 AND coalesce(d, 0) > 1 AS is_alt_spliced, n > 1 AND (coalesce(d, 0) > 1 OR n.gene_id IN (SELECT gene_id FROM simple)) AS is_alt FROM n LEFT JOIN deep USING (gene_id)""")
def label_alt_full(spark, sf_dir):
    e = exons(spark, sf_dir)
    return graph.label_alt_full(graph.vertices(e), graph.edges(e))


EXPR = "expr AS (SELECT gene_id, sample_id, sum(mean_cov * (seg_end - seg_start)) / 50 AS raw_count FROM cov GROUP BY ALL)"
FULL = """grid AS (SELECT g.gene_id, s.sample_id, coalesce(raw_count, 0.0) AS x FROM (SELECT DISTINCT gene_id FROM expr) g CROSS JOIN (SELECT DISTINCT sample_id FROM expr) s
  LEFT JOIN expr e ON e.gene_id = g.gene_id AND e.sample_id = s.sample_id)"""
GEO = """geo AS (SELECT gene_id, exp(avg(ln(x + 1))) AS g FROM grid GROUP BY gene_id),
sf AS (SELECT sample_id, quantile_cont(x / g, 0.5) AS sf FROM grid JOIN geo USING (gene_id) WHERE x > 0 GROUP BY sample_id)"""
QUANT = f"{WITH}, {RUNS}, {SEGS}, {COV}, {EXPR}"


@query(f"{QUANT} SELECT gene_id, sample_id, round(raw_count, 6) AS raw_count FROM expr")
def gene_expression(spark, sf_dir):
    return quant.gene_expression(_cov(spark, sf_dir)).withColumn("raw_count", rounded("raw_count"))


@query(f"""{QUANT}, {SEG_EDGE} SELECT gene_id, sample_id, round(sum(mean_cov * (seg_end - seg_start)) / 50, 6) AS raw_count FROM cov c
WHERE NOT EXISTS (SELECT 1 FROM seg_edge e WHERE e.gene_id = c.gene_id AND seg_start >= e.d_end AND seg_start <= e.a_start) GROUP BY gene_id, sample_id""")
def non_alt_expression(spark, sf_dir):
    e = exons(spark, sf_dir)
    segs = graph.segments(graph.vertices(e))
    alone = graph.single_cover(segs, graph.segment_edges(graph.edges(e), segs))
    cov = _cov(spark, sf_dir).join(alone, ["gene_id", "seg_start", "seg_end"], "left_semi")
    return quant.gene_expression(cov).withColumn("raw_count", rounded("raw_count"))


@query(f"{QUANT}, {FULL}, {GEO} SELECT sample_id, round(sf, 6) AS sf FROM sf")
def size_factors_geomean(spark, sf_dir):
    return quant.size_factors(quant.gene_expression(_cov(spark, sf_dir))).withColumn("sf", rounded("sf"))


@query(f"{QUANT} SELECT sample_id, round(sum(raw_count) / 1e8, 9) AS sf FROM expr GROUP BY sample_id")
def size_factors_tc(spark, sf_dir):
    return quant.total_count_factors(quant.gene_expression(_cov(spark, sf_dir))).withColumn("sf", rounded("sf", 9))


@query(f"{QUANT}, {FULL} SELECT sample_id, round(quantile_cont(x, 0.75) + 1, 6) AS sf FROM grid GROUP BY sample_id")
def size_factors_uq(spark, sf_dir):
    return quant.upper_quartile_factors(quant.gene_expression(_cov(spark, sf_dir))).withColumn("sf", rounded("sf"))


def _count(name: str, s: str, e: str) -> str:
    return f"coalesce((SELECT max(j.n) FROM junction j WHERE j.gene_id = o.gene_id AND j.sample_id = o.sample_id AND j.i_start = {s} AND j.i_end = {e}), 0) AS {name}"


FEATURES = f"""{DEDUP}, {JUNCTION}, feat AS (SELECT o.*, {_count('e1e2', 'e1e', 'e2s')}, {_count('e2e3', 'e2e', 'e3s')}, {_count('e1e3', 'e1e', 'e3s')}
  FROM (SELECT one.*, s.sample_id FROM one JOIN (SELECT DISTINCT gene_id, sample_id FROM junction) s USING (gene_id)) o)"""


def _features(spark, sf_dir) -> DataFrame:
    counts = quant.junction_counts(exons(spark, sf_dir))
    return quant.with_junctions(_skip_events(spark, sf_dir), counts, {"e1e2": ("e1e", "e2s"), "e2e3": ("e2e", "e3s"), "e1e3": ("e1e", "e3s")})


@query(f"""{FEATURES} SELECT gene_id, sample_id, e1s, e1e, e2s, e2e, e3s, e3e, e1e2, e2e3, e1e3,
  CASE WHEN least(e1e2, e2e3) + e1e3 >= 2 THEN round(CAST(least(e1e2, e2e3) AS DOUBLE) / (least(e1e2, e2e3) + e1e3), 6) END AS psi FROM feat""")
def psi_exon_skip(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.withColumn("psi", rounded(quant.psi(*quant.psi_terms("exon_skip"), 2)))


@query(f"""{FEATURES} SELECT gene_id, e1s, e1e, e2s, e2e, e3s, e3e, count(*) FILTER (e1e2 >= 1) AS n_v1, count(*) FILTER (e2e3 >= 1) AS n_v2, count(*) FILTER (e1e3 >= 1) AS n_v3,
  least(count(*) FILTER (e1e2 >= 1), count(*) FILTER (e2e3 >= 1), count(*) FILTER (e1e3 >= 1)) AS confirmed FROM feat GROUP BY ALL""")
def confirmed_events(spark, sf_dir):
    f = _features(spark, sf_dir).withColumns({"v1": F.col("e1e2") >= 1, "v2": F.col("e2e3") >= 1, "v3": F.col("e1e3") >= 1})
    return quant.confirmed(f, events.TRIPLE, ["v1", "v2", "v3"])


@query(f"""{FEATURES} SELECT gene_id, e1s, e1e, e2s, e2e, e3s, e3e, round(coalesce(avg(psi) FILTER (sample_id < 6) - avg(psi) FILTER (sample_id >= 6), 0), 6) AS dpsi
FROM (SELECT *, CASE WHEN least(e1e2, e2e3) + e1e3 >= 1 THEN CAST(least(e1e2, e2e3) AS DOUBLE) / (least(e1e2, e2e3) + e1e3) END AS psi FROM feat) t GROUP BY ALL""")
def delta_psi(spark, sf_dir):
    f = _features(spark, sf_dir).withColumn("psi", quant.psi(*quant.psi_terms("exon_skip"), 1))
    a, b = F.avg(F.when(F.col("sample_id") < 6, F.col("psi"))), F.avg(F.when(F.col("sample_id") >= 6, F.col("psi")))
    return f.groupBy(*events.TRIPLE).agg(rounded(F.coalesce(a - b, F.lit(0.0))).alias("dpsi"))


@query(f"""{FEATURES} SELECT gene_id, e1s, e1e, e2s, e2e, e3s, e3e FROM feat GROUP BY ALL
HAVING avg(CASE WHEN e1e3 <= 1 THEN 1.0 ELSE 0 END) FILTER (sample_id < 6) <= 0.5 OR avg(CASE WHEN e1e3 <= 1 THEN 1.0 ELSE 0 END) FILTER (sample_id >= 6) <= 0.5
  OR avg(CASE WHEN least(e1e2, e2e3) <= 1 THEN 1.0 ELSE 0 END) FILTER (sample_id < 6) <= 0.5 OR avg(CASE WHEN least(e1e2, e2e3) <= 1 THEN 1.0 ELSE 0 END) FILTER (sample_id >= 6) <= 0.5""")
def low_coverage_filter(spark, sf_dir):
    f = _features(spark, sf_dir)
    low = lambda c, a: F.avg(F.when((F.col("sample_id") < 6) == a, F.when(c <= 1, 1.0).otherwise(0.0)))
    c0, c1 = F.col("e1e3"), F.least("e1e2", "e2e3")
    out = f.groupBy(*events.TRIPLE).agg(*[low(c, a).alias(f"z{i}{int(a)}") for i, c in enumerate((c0, c1)) for a in (True, False)])
    return out.where("z01 <= 0.5 OR z00 <= 0.5 OR z11 <= 0.5 OR z10 <= 0.5").select(*events.TRIPLE)


@query(f"""{QUANT}, {FULL}, {GEO} SELECT gene_id, round(avg(x / sf) FILTER (sample_id < 6), 6) AS mean_a, round(avg(x / sf) FILTER (sample_id >= 6), 6) AS mean_b,
  CASE WHEN avg(x / sf) FILTER (sample_id < 6) > 0 AND avg(x / sf) FILTER (sample_id >= 6) > 0
    THEN round(log2(avg(x / sf) FILTER (sample_id < 6)) - log2(avg(x / sf) FILTER (sample_id >= 6)), 6) END AS log2fc
FROM grid JOIN sf USING (sample_id) GROUP BY gene_id""")
def fold_change(spark, sf_dir):
    expr = quant.gene_expression(_cov(spark, sf_dir))
    full = quant.dense(expr, "gene_id", "sample_id", "raw_count").join(F.broadcast(quant.size_factors(expr)), "sample_id")
    x = F.col("raw_count") / F.col("sf")
    out = full.groupBy("gene_id").agg(F.avg(F.when(F.col("sample_id") < 6, x)).alias("a"), F.avg(F.when(F.col("sample_id") >= 6, x)).alias("b"))
    return out.select("gene_id", rounded("a").alias("mean_a"), rounded("b").alias("mean_b"), rounded(F.log2("a") - F.log2("b")).alias("log2fc"))


@query(f"""{QUANT}, {FULL}, {GEO}, lg AS (SELECT gene_id, sample_id, sf, x, log2(x / sf + 1) AS l FROM grid JOIN sf USING (sample_id)),
q AS (SELECT gene_id, quantile_cont(l, 0.25) AS p25, quantile_cont(l, 0.75) AS p75 FROM lg GROUP BY gene_id)
SELECT gene_id, sample_id, round(CASE WHEN p75 > p25 AND l > p75 + 1.5 * (p75 - p25) THEN (pow(2, p75 + 1.5 * (p75 - p25)) - 1) * sf ELSE x END, 6) AS capped FROM lg JOIN q USING (gene_id)""")
def cap_outliers(spark, sf_dir):
    expr = quant.gene_expression(_cov(spark, sf_dir))
    full = quant.dense(expr, "gene_id", "sample_id", "raw_count").join(F.broadcast(quant.size_factors(expr)), "sample_id")
    out = testing.cap_outliers(full, "gene_id", "raw_count", "sf", 1.5)
    return out.select("gene_id", "sample_id", rounded("capped").alias("capped"))


# p-values: a fixed arithmetic over customers; null where the remainder is 0
TESTS = "test AS (SELECT c_custkey AS event_id, c_custkey % 200 AS gene_id, CASE WHEN c_custkey % 97 <> 0 THEN ((c_custkey * 7919) % 10007) / 10007.0 * (((c_custkey * 31) % 101) / 101.0) END AS p FROM customer)"
RANKED = f"WITH {TESTS}, ranked AS (SELECT *, row_number() OVER (ORDER BY p, event_id) AS r, (SELECT count(p) FROM test) AS m FROM test WHERE p IS NOT NULL)"


def _tests(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    p = F.when(k % 97 != 0, ((k * 7919) % 10007) / F.lit(10007.0) * (((k * 31) % 101) / F.lit(101.0)))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("event_id"), (k % 200).alias("gene_id"), p.alias("p"))


def _adjusted(method: str):
    def run(spark, sf_dir):
        return multiple_testing.adjust(_tests(spark, sf_dir), "p", method).where("p IS NOT NULL").select("event_id", rounded("p", 9).alias("p"), rounded("p_adj", 9).alias("p_adj"))

    return run


for _name, _method, _value in (
    ("bonferroni", "bonferroni", "least(1, p * m)"),
    ("holm", "holm", "least(1, max(p * (m - r + 1)) OVER (ORDER BY r))"),
    ("hochberg", "hochberg", "least(1, min(p * (m - r + 1)) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"),
    ("bh_adjust", "bh", "least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"),
    ("by_adjust", "by", "least(1, min(p * m * h / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"),
):
    QUERIES[_name] = _adjusted(_method)
    if _name == "by_adjust":
        ORACLES[_name] = f"{RANKED}, har AS (SELECT sum(1.0 / r) AS h FROM ranked) SELECT event_id, round(p, 9) AS p, round({_value}, 9) AS p_adj FROM ranked, har"
    else:
        ORACLES[_name] = f"{RANKED} SELECT event_id, round(p, 9) AS p, round({_value}, 9) AS p_adj FROM ranked"


@query(f"WITH {TESTS} SELECT event_id, gene_id, round(p, 9) AS p FROM test WHERE p IS NOT NULL ORDER BY test.p, event_id LIMIT 20")
def topk_tests(spark, sf_dir):
    return _tests(spark, sf_dir).where("p IS NOT NULL").orderBy("p", "event_id").limit(20).withColumn("p", rounded("p", 9))


@query(f"WITH {TESTS} SELECT gene_id, event_id, round(p, 9) AS p FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY p, event_id) AS r FROM test WHERE p IS NOT NULL) t WHERE r = 1")
def gene_unique(spark, sf_dir):
    best = _tests(spark, sf_dir).where("p IS NOT NULL").groupBy("gene_id").agg(F.min(F.struct("p", "event_id")).alias("b"))
    return best.select("gene_id", "b.event_id", rounded("b.p", 9).alias("p"))


@query(f"""{WITH}, mark AS (SELECT DISTINCT gene_id, v_end FROM vertex), pt AS (SELECT DISTINCT gene_id, vs FROM edge)
SELECT pt.gene_id, pt.vs, mark.v_end AS before FROM pt ASOF LEFT JOIN mark ON pt.gene_id = mark.gene_id AND pt.vs >= mark.v_end""")
def nearest_exon(spark, sf_dir):
    e = exons(spark, sf_dir)
    return intervals.nearest_before(graph.edges(e), graph.vertices(e), ["gene_id"], "vs", "v_end")


@query(f"""{WITH}, t AS (SELECT DISTINCT gene_id, transcript_id FROM exon), n AS (SELECT transcript_id % 2 AS half, count(*) AS transcripts, count(DISTINCT gene_id) AS genes FROM t GROUP BY ALL) SELECT * FROM n""")
def transcript_counts(spark, sf_dir):
    t = exons(spark, sf_dir).select("gene_id", "transcript_id").distinct()
    return t.groupBy((F.col("transcript_id") % 2).alias("half")).agg(F.count("*").alias("transcripts"), F.countDistinct("gene_id").alias("genes"))


@query(f"""{WITH}, t AS (SELECT DISTINCT gene_id, transcript_id FROM exon), n AS (SELECT transcript_id % 2 AS half, count(*) AS transcripts, count(DISTINCT gene_id) AS genes FROM t GROUP BY ALL) SELECT * FROM n""")
def transcript_counts_all(spark, sf_dir):
    """The same as ``transcript_counts``."""
    return transcript_counts(spark, sf_dir)


SEQ = "seq AS (SELECT p_partkey AS part, translate(upper(p_name), 'BDEFHIJKLMNOPQRSUVWXYZ ', 'ACGTACGTACGTACGTACGTACG') AS s, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)"


@query(f"""WITH {SEQ}, site AS (SELECT part, s, strand, substr(s, 1, 2) AS l, substr(s, length(s) - 1, 2) AS r FROM seq WHERE length(s) >= 4)
SELECT part, strand, reverse(translate(s, 'ACGTacgt', 'TGCAtgca')) AS rc,
  CASE WHEN strand = '+' THEN l IN ('GT', 'GC') AND r = 'AG' ELSE reverse(translate(r, 'ACGT', 'TGCA')) IN ('GT', 'GC') AND reverse(translate(l, 'ACGT', 'TGCA')) = 'AG' END AS ok FROM site""")
def consensus_filter(spark, sf_dir):
    s = F.translate(F.upper("p_name"), "BDEFHIJKLMNOPQRSUVWXYZ ", "ACGTACGTACGTACGTACGTACG")
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("part"), s.alias("s"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand")).where("length(s) >= 4")
    ok = sequence.consensus(F.col("s"), F.col("strand"), F.lit(0), F.length("s"), "lenient")
    return df.select("part", "strand", sequence.reverse_complement(F.col("s")).alias("rc"), ok.alias("ok"))


RETAINED = f"""held AS (SELECT * FROM edge e WHERE EXISTS (
    SELECT 1 FROM vertex v WHERE v.gene_id = e.gene_id AND v.v_start < e.ue AND v.v_end > e.vs)),
retained AS (SELECT gene_id, us, ue, vs, ve FROM (
  SELECT *, row_number() OVER (PARTITION BY gene_id, ue, vs ORDER BY us, ve) rn FROM held) t WHERE rn = 1)"""


@query(f"""{WITH.replace('WITH', 'WITH RECURSIVE', 1)}, {RETAINED}, chain AS (SELECT * FROM retained
  UNION SELECT c.gene_id, c.us, c.ue, r.vs, r.ve FROM chain c JOIN retained r ON c.gene_id = r.gene_id AND c.vs = r.us AND c.ve = r.ue)
SELECT * FROM chain""")
def retained_chains(spark, sf_dir):
    """Chains of retained introns: each start exon with every exon reached over them."""
    from junctura.operators import augment

    e = exons(spark, sf_dir)
    kept = events.intron_retention(graph.edges(e), graph.vertices(e))
    return augment.retention_closure(kept.select("gene_id", F.col("e1s").alias("us"), F.col("e1e").alias("ue"), F.col("e2s").alias("vs"), F.col("e2e").alias("ve")))


# --- evidence, writers, tests over the projection -------------------------------------

DEPTH = """(SELECT coalesce(sum((least({e}, r.run_end) - greatest({s}, r.run_start)) * r.depth), 0) / CAST({e} - {s} AS DOUBLE)
    FROM runs r WHERE r.gene_id = o.gene_id AND r.sample_id = o.sample_id AND r.run_start < {e} AND {s} < r.run_end)"""


def _evidence(spark, sf_dir, kind: str, found: DataFrame, counted: bool = False) -> DataFrame:
    """Events in the samples of their own gene, as :func:`junctura.operators.verify.evidence` gives them; ``counted``: from the depth of the graph's segments."""
    e = exons(spark, sf_dir)
    named = lambda df: df.withColumn("sample", F.col("sample_id").cast("string")).drop("sample_id")
    runs = named(intervals.coverage_runs(e, ["gene_id", "sample_id"], "ex_start", "ex_end"))
    counts = named(quant.junction_counts(e))
    own = counts.select("gene_id", "sample").distinct()
    if counted:
        segs = graph.segments(graph.vertices(e))
        runs = quantify.from_segments(segs, intervals.segment_coverage(segs, runs, ["gene_id"], ["sample"]))
    ev = verify.evidence(kind, found, own, runs, counts, Evidence(junction=1, mutex_junction=1), Retention(1, 0.5, 0.1, 2), 1)
    return ev.withColumn("sample_id", F.col("sample").cast("long"))


def _local(spark, sf_dir, kind: str, counted: bool = False) -> DataFrame:
    """The same for the kinds of :mod:`junctura.operators.neighbours`, which makes the events itself.

    Vertices, edges, runs and counts are all sums over one table of distinct exons and what
    follows them, which is kept while the query is, so the line items are joined and sorted once."""
    hops = graph.followed(exons(spark, sf_dir), ["sample_id"]).groupBy("sample_id", *graph.EDGE).agg(F.count("*").alias("n")).localCheckpoint()
    span = hops.groupBy("gene_id", "sample_id", F.col("us").alias("ex_start"), F.col("ue").alias("ex_end")).agg(F.sum("n").alias("n"))
    link = hops.where("vs IS NOT NULL AND vs > ue")
    counts = link.groupBy("gene_id", F.col("sample_id").alias("sample"), F.col("ue").alias("i_start"), F.col("vs").alias("i_end")).agg(F.sum("n").alias("n"))
    v, edge = graph.vertices(span), link.select(*graph.EDGE).distinct()
    runs = intervals.coverage_runs(span, ["gene_id", "sample_id"], "ex_start", "ex_end", "n").withColumnRenamed("sample_id", "sample")
    places = neighbours.places(v, counts.select("gene_id", "sample").distinct())
    area = neighbours.area_of_segments(intervals.segment_coverage(graph.segments(v), runs, ["gene_id"], ["sample"]), places) if counted else neighbours.area_at(runs, places)
    ev, ir = Evidence(junction=1, mutex_junction=1), Retention(1, 0.5, 0.1, 2)
    if kind == "mult_exon_skip":
        out = neighbours.path_evidence(events.mult_exon_skip(edge), area, counts, ev, ir, 1)
    else:
        out = neighbours.evidence(kind, v, edge, area, counts, ev, ir, 1)
    return out.withColumnRenamed("sample", "sample_id")


OWN = "(SELECT {t}.*, s.sample_id FROM {t} JOIN (SELECT DISTINCT gene_id, sample_id FROM junction) s USING (gene_id)) o"


@query(f"""{DEDUP}, {JUNCTION}, {RUNS}, feat AS (SELECT o.*, {DEPTH.format(s='e1s', e='e1e')} AS d1, {DEPTH.format(s='e2s', e='e2e')} AS d2, {DEPTH.format(s='e3s', e='e3e')} AS d3,
  {_count('e1e2', 'e1e', 'e2s')}, {_count('e2e3', 'e2e', 'e3s')}, {_count('e1e3', 'e1e', 'e3s')} FROM {OWN.format(t='one')})
SELECT gene_id, sample_id, e1s, e1e, e2s, e2e, e3s, e3e, round(d2, 6) AS e2_cov, d2 >= 0.05 * ((d1 + d3) / 2) AS v1, e1e2 >= 1 AS v2, e2e3 >= 1 AS v3, e1e3 >= 1 AS v4 FROM feat""")
def evidence_exon_skip(spark, sf_dir, counted=False):
    out = _evidence(spark, sf_dir, "exon_skip", _skip_events(spark, sf_dir), counted)
    return out.select("gene_id", "sample_id", *events.TRIPLE[1:], rounded("e2_cov").alias("e2_cov"), "v1", "v2", "v3", "v4")


COVERED = """(SELECT coalesce(sum(least({e}, r.run_end) - greatest({s}, r.run_start)), 0) / CAST({e} - {s} AS DOUBLE)
    FROM runs r WHERE r.gene_id = o.gene_id AND r.sample_id = o.sample_id AND r.run_start < {e} AND {s} < r.run_end)"""


@query(f"""{WITH}, {RETAINED}, {JUNCTION}, {RUNS}, ev AS (SELECT gene_id, us e1s, ue e1e, vs e2s, ve e2e FROM retained), feat AS (SELECT o.*,
  {DEPTH.format(s='e1s', e='e1e')} AS d1, {DEPTH.format(s='e1e', e='e2s')} AS d2, {DEPTH.format(s='e2s', e='e2e')} AS d3, {COVERED.format(s='e1e', e='e2s')} AS share, {_count('n', 'e1e', 'e2s')} FROM {OWN.format(t='ev')})
SELECT gene_id, sample_id, e1s, e1e, e2s, e2e, round(d2, 6) AS cov, round(share, 6) AS share, d2 > 1 AND share > 0.5 AND d2 >= 0.1 * ((d1 + d3) / 2) AS v1, n >= 1 AS v2,
  CASE WHEN d2 + n >= 1 THEN round(d2 / (d2 + n), 6) END AS psi FROM feat""")
def evidence_intron_retention(spark, sf_dir, counted=False):
    e = exons(spark, sf_dir)
    out = _evidence(spark, sf_dir, "intron_retention", events.intron_retention(graph.edges(e), graph.vertices(e)), counted)
    return out.select("gene_id", "sample_id", "e1s", "e1e", "e2s", "e2e", rounded("e2_cov").alias("cov"), rounded("e2_region").alias("share"), "v1", "v2", rounded("psi").alias("psi"))


RIGHT = """alt AS (SELECT x.gene_id, x.us e1s, x.ue e1e, x.vs e2s, x.ve e2e, y.vs e3s, y.ve e3e FROM edge x JOIN edge y ON x.gene_id = y.gene_id AND x.us = y.us AND x.ue = y.ue
WHERE x.vs < y.vs AND least(x.ve, y.ve) - greatest(x.vs, y.vs) >= 11)"""


def _alt_evidence_sql(alt: str, parts: list[tuple[str, str]], longer: tuple[str, str], shorter: tuple[str, str]) -> str:
    d1, d2, d3 = (DEPTH.format(s=s, e=e) for s, e in parts)
    n1, n3 = (f"({parts[k][1]} - {parts[k][0]})" for k in (0, 2))
    return f"""{WITH}, {alt}, {JUNCTION}, {RUNS}, feat AS (SELECT o.*, {d1} AS d1, {d2} AS d2, {d3} AS d3, {n1} AS n1, {n3} AS n3, {_count('e2', *longer)}, {_count('e1e3', *shorter)} FROM {OWN.format(t='alt')})
SELECT gene_id, sample_id, e1s, e1e, e2s, e2e, e3s, e3e, round(d2, 6) AS e2_cov, e2, e1e3, d2 >= 0.05 * ((d1 * n1 + d3 * n3) / (n1 + n3)) AS v1, e2 >= 1 AND e1e3 >= 1 AS v2,
  CASE WHEN e2 + e1e3 >= 1 THEN round(CAST(e2 AS DOUBLE) / (e2 + e1e3), 6) END AS psi FROM (SELECT * REPLACE (CAST(e2 AS BIGINT) AS e2, CAST(e1e3 AS BIGINT) AS e1e3) FROM feat)"""


def _alt_evidence(spark, sf_dir, kind: str, counted: bool) -> DataFrame:
    out = _local(spark, sf_dir, kind, counted)
    return out.select("gene_id", "sample_id", *events.TRIPLE[1:], rounded("e2_cov").alias("e2_cov"), "e2", "e1e3", "v1", "v2", rounded("psi").alias("psi"))


@query(_alt_evidence_sql(RIGHT, [("e1s", "e1e"), ("e2s", "e3s"), ("e3s", "least(e2e, e3e)")], ("e1e", "e2s"), ("e1e", "e3s")))
def evidence_alt_right(spark, sf_dir, counted=False):
    """Depth, counts, criteria and PSI of alternative right ends."""
    return _alt_evidence(spark, sf_dir, "alt_right", counted)


@query(_alt_evidence_sql(LEFT, [("greatest(e1s, e2s)", "e1e"), ("e1e", "e2e"), ("e3s", "e3e")], ("e2e", "e3s"), ("e1e", "e3s")))
def evidence_alt_left(spark, sf_dir, counted=False):
    """Depth, counts, criteria and PSI of alternative left ends."""
    return _alt_evidence(spark, sf_dir, "alt_left", counted)


@query(f"""{WITH}, {MUTEX}, {JUNCTION}, {RUNS}, feat AS (SELECT o.*, {', '.join(f"{DEPTH.format(s=f'e{k}s', e=f'e{k}e')} AS d{k}" for k in (1, 2, 3, 4))},
  {', '.join(_count(f'e{a}e{b}', f'e{a}e', f'e{b}s') for a, b in ((1, 2), (1, 3), (2, 4), (3, 4)))} FROM {OWN.format(t='mutex')})
SELECT gene_id, sample_id, e1s, e1e, e2s, e2e, e3s, e3e, e4s, e4e, d2 >= 0.05 * ((d1 + d4) / 2) AS v1, d3 >= 0.05 * ((d1 + d4) / 2) AS v2, e1e2 >= 1 AND e2e4 >= 1 AS v3, e1e3 >= 1 AND e3e4 >= 1 AS v4,
  CASE WHEN e1e2 + e2e4 + e1e3 + e3e4 >= 1 THEN round(CAST(e1e3 + e3e4 AS DOUBLE) / (e1e2 + e2e4 + e1e3 + e3e4), 6) END AS psi FROM feat""")
def evidence_mutex_exons(spark, sf_dir, counted=False):
    """Criteria and PSI of mutually exclusive exons."""
    out = _local(spark, sf_dir, "mutex_exons", counted)
    return out.select("gene_id", "sample_id", *[f"e{k}{x}" for k in (1, 2, 3, 4) for x in "se"], "v1", "v2", "v3", "v4", rounded("psi").alias("psi"))


@query(f"""WITH RECURSIVE {EXON}, {PAIR}, {EDGE}, {MULT}, {JUNCTION}, {RUNS},
mult AS (SELECT gene_id, first.s AS us, first.e AS ue, last.s AS vs, last.e AS ve, list_reverse(back) AS inner_exons FROM chosen WHERE back IS NOT NULL),
own AS (SELECT mult.*, s.sample_id FROM mult JOIN (SELECT DISTINCT gene_id, sample_id FROM junction) s USING (gene_id)),
part AS (SELECT o.gene_id, o.sample_id, o.us, o.ue, o.vs, o.ve, k, o.inner_exons[k].s AS xs, o.inner_exons[k].e AS xe, o.inner_exons[k + 1].s AS after
  FROM (SELECT *, unnest(range(1, len(inner_exons) + 1)) AS k FROM own) o),
sums AS (SELECT gene_id, sample_id, us, ue, vs, ve, sum({DEPTH.format(s='xs', e='xe')} * (xe - xs)) / sum(xe - xs) AS d2, count(*) AS num_e2,
  coalesce(sum((SELECT sum(j.n) FROM junction j WHERE j.gene_id = o.gene_id AND j.sample_id = o.sample_id AND j.i_start = xe AND j.i_end = after)), 0) AS sum_e2 FROM part o GROUP BY ALL),
feat AS (SELECT o.*, d2, num_e2, sum_e2, {DEPTH.format(s='o.us', e='o.ue')} AS d1, {DEPTH.format(s='o.vs', e='o.ve')} AS d3,
  {_count('e1e2', 'o.ue', 'o.inner_exons[1].s')}, {_count('e2e3', 'o.inner_exons[-1].e', 'o.vs')}, {_count('e1e3', 'o.ue', 'o.vs')} FROM own o JOIN sums USING (gene_id, sample_id, us, ue, vs, ve))
SELECT gene_id, sample_id, us, ue, vs, ve, round(d2, 6) AS e2_cov, CAST(sum_e2 AS BIGINT) AS sum_e2, num_e2, d2 >= 0.05 * ((d1 + d3) / 2) AS v1, e1e2 >= 1 AS v2, e2e3 >= 1 AS v3, sum_e2 / num_e2 >= 1 AS v4, e1e3 >= 1 AS v5,
  CASE WHEN e1e2 + e2e3 + sum_e2 + (num_e2 + 1) * e1e3 >= 1 THEN round(CAST(e1e2 + e2e3 + sum_e2 AS DOUBLE) / (e1e2 + e2e3 + sum_e2 + (num_e2 + 1) * e1e3), 6) END AS psi FROM feat""")
def evidence_mult_exon_skip(spark, sf_dir, counted=False):
    """Depth, counts, criteria and PSI of several skipped exons."""
    out = _local(spark, sf_dir, "mult_exon_skip", counted)
    return longs(out.select("gene_id", "sample_id", "us", "ue", "vs", "ve", rounded("e2_cov").alias("e2_cov"), "sum_e2", "num_e2", "v1", "v2", "v3", "v4", "v5", rounded("psi").alias("psi")))


# --- the same from the counted graph: equal rows, by segment numbers ---------------------


@query(ORACLES["evidence_exon_skip"])
def quantify_exon_skip(spark, sf_dir):
    """Evidence of skipped exons from the depth of segments."""
    return evidence_exon_skip(spark, sf_dir, True)


@query(ORACLES["evidence_intron_retention"])
def quantify_intron_retention(spark, sf_dir):
    """Evidence of retained introns from the depth of segments."""
    return evidence_intron_retention(spark, sf_dir, True)


@query(ORACLES["evidence_alt_right"])
def quantify_alt_right(spark, sf_dir):
    """Evidence of alternative right ends from the depth of segments."""
    return evidence_alt_right(spark, sf_dir, True)


@query(ORACLES["evidence_alt_left"])
def quantify_alt_left(spark, sf_dir):
    """Evidence of alternative left ends from the depth of segments."""
    return evidence_alt_left(spark, sf_dir, True)


@query(ORACLES["evidence_mutex_exons"])
def quantify_mutex_exons(spark, sf_dir):
    """Evidence of mutually exclusive exons from the depth of segments."""
    return evidence_mutex_exons(spark, sf_dir, True)


@query(ORACLES["evidence_mult_exon_skip"])
def quantify_mult_exon_skip(spark, sf_dir):
    """Evidence of several skipped exons from the depth of segments."""
    return evidence_mult_exon_skip(spark, sf_dir, True)


# --- counts for testing of the other types ------------------------------------------------


def _counts_sql(evidence_of: str, columns: str, skip: str, keep: str) -> str:
    """Both forms' counts over the features of an evidence query."""
    head = ORACLES[evidence_of]
    return f"{head[: head.rindex(chr(10) + 'SELECT gene_id, sample_id')]} SELECT gene_id, sample_id, {columns}, form, CAST(floor(CASE WHEN form = 0 THEN {skip} ELSE {keep} END) AS DOUBLE) AS n FROM feat, (VALUES (0), (1)) t(form)"


def _counts(rows: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    out = verify.test_counts(kind, rows.withColumn("event_id", F.struct(*columns)).drop("sample").withColumnRenamed("sample_id", "sample"))
    return out.select("gene_id", F.col("sample").alias("sample_id"), *[F.col(f"event_id.{c}").alias(c) for c in columns], "form", "n")


@query(_counts_sql("evidence_intron_retention", "e1s, e1e, e2s, e2e", "n", "d2"))
def counts_for_test_intron_retention(spark, sf_dir):
    """Counts of both forms of retained introns."""
    e = exons(spark, sf_dir)
    return _counts(_evidence(spark, sf_dir, "intron_retention", events.intron_retention(graph.edges(e), graph.vertices(e))), "intron_retention", ["e1s", "e1e", "e2s", "e2e"])


@query(_counts_sql("evidence_alt_right", "e1s, e1e, e2s, e2e, e3s, e3e", "e1e3", "e2"))
def counts_for_test_alt_right(spark, sf_dir):
    """Counts of both forms of alternative right ends."""
    return _counts(_local(spark, sf_dir, "alt_right"), "alt_right", events.TRIPLE[1:])


@query(_counts_sql("evidence_alt_left", "e1s, e1e, e2s, e2e, e3s, e3e", "e1e3", "e2"))
def counts_for_test_alt_left(spark, sf_dir):
    """Counts of both forms of alternative left ends."""
    return _counts(_local(spark, sf_dir, "alt_left"), "alt_left", events.TRIPLE[1:])


@query(_counts_sql("evidence_mutex_exons", "e1s, e1e, e2s, e2e, e3s, e3e, e4s, e4e", "least(e1e2, e2e4)", "least(e1e3, e3e4)"))
def counts_for_test_mutex_exons(spark, sf_dir):
    """Counts of both forms of mutually exclusive exons."""
    return _counts(_local(spark, sf_dir, "mutex_exons"), "mutex_exons", [f"e{k}{x}" for k in (1, 2, 3, 4) for x in "se"])


@query(_counts_sql("evidence_mult_exon_skip", "us, ue, vs, ve", "e1e3", "least(e1e2, e2e3, sum_e2)"))
def counts_for_test_mult_exon_skip(spark, sf_dir):
    """Counts of both forms of several skipped exons."""
    return longs(_counts(_local(spark, sf_dir, "mult_exon_skip"), "mult_exon_skip", ["us", "ue", "vs", "ve"])).withColumn("form", F.col("form").cast("int"))


@query(f"""WITH {EXON}, kind AS (SELECT *, count(*) OVER (PARTITION BY transcript_id) > 1 AS spliced FROM exon),
step AS (SELECT gene_id, sample_id, pos, sum(d) FILTER (spliced) AS s, sum(d) FILTER (NOT spliced) AS u FROM (
  SELECT gene_id, sample_id, spliced, ex_start AS pos, 1 AS d FROM kind UNION ALL SELECT gene_id, sample_id, spliced, ex_end, -1 FROM kind) t GROUP BY ALL)
SELECT * FROM (SELECT gene_id, sample_id, pos AS run_start, lead(pos) OVER w AS run_end, CAST(coalesce(sum(s) OVER w, 0) AS BIGINT) AS spliced, CAST(coalesce(sum(u) OVER w, 0) AS BIGINT) AS unspliced
  FROM step WINDOW w AS (PARTITION BY gene_id, sample_id ORDER BY pos)) t WHERE run_end IS NOT NULL AND spliced + unspliced > 0""")
def coverage_tracks(spark, sf_dir):
    """Depth in two tracks in one pass: exons of spliced transcripts, and of transcripts of one exon."""
    e = exons(spark, sf_dir)
    many = F.count("*").over(Window.partitionBy("transcript_id")) > 1
    kinds = e.withColumn("spliced", many.cast("int")).withColumn("unspliced", 1 - F.col("spliced"))
    return intervals.track_runs(kinds, ["gene_id", "sample_id"], "ex_start", "ex_end", ["spliced", "unspliced"])


@query(f"""WITH {EXON}, {PAIR}, item AS (SELECT gene_id, sample_id, ex_start AS us, ex_end AS ue, NULL AS vs, NULL AS ve FROM exon UNION SELECT gene_id, sample_id, us, ue, vs, ve FROM pair),
part AS (SELECT gene_id, us, ue, vs, ve, min(sample_id) AS first, count(DISTINCT sample_id) AS n_samples FROM item GROUP BY ALL),
stop AS (SELECT gene_id, min(first) AS stop FROM part a WHERE vs IS NULL AND (SELECT count(*) FROM part b WHERE b.vs IS NULL AND b.gene_id = a.gene_id AND b.first <= a.first) > 12 GROUP BY gene_id)
SELECT gene_id, us, ue, coalesce(vs, -1) AS vs, coalesce(ve, -1) AS ve, n_samples FROM part LEFT JOIN stop USING (gene_id) WHERE stop IS NULL OR first <= stop""")
def merged_bounded(spark, sf_dir):
    """Graphs merged one sample after another; a gene with more than 12 vertices takes no more, but counts what it has.  A vertex has -1 for vs and ve."""
    rows = graph.vertices_and_edges(exons(spark, sf_dir), ["sample_id"])
    return graph.bounded_merge(rows.select("*", F.col("sample_id").alias("place"), F.lit(1).cast("long").alias("n")), 12).select("gene_id", "us", "ue", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("vs", "ve")], "n_samples")


def _as_events(df: DataFrame) -> DataFrame:
    pair = lambda *names: F.array(*[F.struct(F.col(f"{n}s").cast("int").alias("start"), F.col(f"{n}e").cast("int").alias("stop")) for n in names])
    return df.select(F.lit("exon_skip").alias("event_type"), "event_id", F.lit("c1").alias("contig"), F.lit("+").alias("strand"), F.col("gene_id").cast("string").alias("gene_id"), F.lit(3).alias("annotated"), pair("e1", "e3").alias("exons1"), pair("e1", "e2", "e3").alias("exons2"))


NUMBERED = f"{DEDUP}, ev AS (SELECT *, row_number() OVER (ORDER BY gene_id, e1e, e2s, e2e, e3s) AS event_id FROM one)"


@query(f"""{NUMBERED} SELECT event_id, concat_ws(chr(9), 'c1', e1s, e3e, 'CA-' || gene_id || '-' || event_id, '.', '+', e1s, e3e, '.', '3',
  (e1e - e1s) || ',' || (e2e - e2s) || ',' || (e3e - e3s), '0,' || (e2s - e1s) || ',' || (e3s - e1s)) AS line FROM ev""")
def event_bed(spark, sf_dir):
    return sinks.bed(_as_events(event_ids(spark, sf_dir))).select("event_id", F.col("value").alias("line"))


@query(f"""{NUMBERED} SELECT event_id, count(*) AS n_lines, min(line) AS first_line, max(line) AS last_line FROM (
  SELECT event_id, concat_ws(chr(9), 'c1', 'exon_skip', 'gene', e1s + 1, e3e, '.', '+', '.', 'ID=exon_skip.' || event_id || ';GeneName="' || gene_id || '";HasNovelJunction="N"') AS line FROM ev
  UNION ALL SELECT event_id, concat_ws(chr(9), 'c1', 'exon_skip', 'mRNA', e1s + 1, e3e, '.', '+', '.', 'ID=exon_skip.' || event_id || '_iso' || k || ';Parent=exon_skip.' || event_id || ';GeneName="' || gene_id || '"') FROM ev, (VALUES (1), (2)) t(k)
  UNION ALL SELECT event_id, concat_ws(chr(9), 'c1', 'exon_skip', 'exon', s + 1, e, '.', '+', '.', 'Parent=exon_skip.' || event_id || '_iso' || k) FROM (
    SELECT event_id, e1s s, e1e e, 1 k FROM ev UNION ALL SELECT event_id, e3s, e3e, 1 FROM ev UNION ALL SELECT event_id, e1s, e1e, 2 FROM ev
    UNION ALL SELECT event_id, e2s, e2e, 2 FROM ev UNION ALL SELECT event_id, e3s, e3e, 2 FROM ev) x) y GROUP BY event_id""")
def event_gff3(spark, sf_dir):
    out = sinks.gff3(_as_events(event_ids(spark, sf_dir)))
    return out.groupBy("event_id").agg(F.count("*").alias("n_lines"), F.min("value").alias("first_line"), F.max("value").alias("last_line"))


@query(f"""{NUMBERED} SELECT event_id, e1s || '-' || e1e || ':' || e2s || '-' || e2e || ':' || e3s || '-' || e3e AS exon_pos, '0:1:0' AS alt_usage FROM ev""")
def event_coordinates(spark, sf_dir):
    return sinks.coordinates(_as_events(event_ids(spark, sf_dir))).select("event_id", "exon_pos", "alt_usage")


@query(f"""{FEATURES} SELECT gene_id, sample_id, e1s, e1e, e2s, e2e, e3s, e3e, CASE WHEN e1e2 + e2e3 + e1e3 >= 2 AND e1e2 + e2e3 + 2 * e1e3 > 0
  THEN round(CAST(e1e2 + e2e3 AS DOUBLE) / (e1e2 + e2e3 + 2 * e1e3), 6) END AS psi FROM feat""")
def path_psi(spark, sf_dir):
    """PSI over both inclusion junctions, as one of the writers has it."""
    f = _features(spark, sf_dir)
    return f.select("gene_id", "sample_id", *events.TRIPLE[1:], rounded(sinks.tcga_psi("exon_skip", 2)).alias("psi"))


@query(f"""{FEATURES} SELECT gene_id, sample_id, e1s, e1e, e2s, e2e, e3s, e3e, form, CAST(floor(CASE WHEN form = 0 THEN e1e3 ELSE least(e1e2, e2e3) END) AS DOUBLE) AS n FROM feat, (VALUES (0), (1)) t(form)""")
def counts_for_test(spark, sf_dir):
    f = _features(spark, sf_dir).withColumn("event_id", F.struct(*events.TRIPLE[1:])).withColumnRenamed("sample_id", "sample")
    out = verify.test_counts("exon_skip", f)
    return out.select("gene_id", F.col("sample").alias("sample_id"), *[F.col(f"event_id.{c}").alias(c) for c in events.TRIPLE[1:]], "form", "n")


@query(f"{QUANT}, {FULL} SELECT gene_id, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance FROM grid GROUP BY gene_id")
def mean_variance(spark, sf_dir):
    full = quant.dense(quant.gene_expression(_cov(spark, sf_dir)), "gene_id", "sample_id", "raw_count")
    return viz_data.mean_variance(full, "gene_id", "raw_count").select("gene_id", rounded("mean").alias("mean"), rounded("variance").alias("variance"))


@query()
def differential_test(spark, sf_dir):
    """Genes as events: exons counted as one form, junctions as the other, samples 0 to 5 against 6 to 11."""
    e = exons(spark, sf_dir)
    n_exons = e.groupBy("gene_id", "sample_id").agg(F.count("*").cast("double").alias("n"))
    n_introns = graph.consecutive(e, ["sample_id"]).groupBy("gene_id", "sample_id").agg(F.count("*").cast("double").alias("n"))
    both = [quant.dense(df, "gene_id", "sample_id", "n").withColumn("form", F.lit(k)) for k, df in enumerate((n_introns, n_exons))]
    counts = both[0].unionByName(both[1]).withColumn("event_id", F.col("gene_id"))
    groups = counts.select("sample_id").distinct().withColumn("in_a", F.col("sample_id") < 6)
    sf = groups.select("sample_id", F.lit(1.0).alias("sf"))
    expression = quant.dense(quant.gene_expression(_cov(spark, sf_dir)), "gene_id", "sample_id", "raw_count")
    rows = testing.response(counts, expression, sf, sf, groups)
    return multiple_testing.adjust(testing.cut(testing.differential(rows, 10, 0.95)), "p", "bh").select("event_id", "gene_id", "form", rounded("p").alias("p"), rounded("p_adj").alias("p_adj"), rounded("disp_raw").alias("disp_raw"), rounded("disp_adj").alias("disp_adj"))


# contigs: nations in the order of their region and key; a gene lies on that of its number, on minus if it is odd
CONTIGS = "contig AS (SELECT CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS INT) AS contig_id, n_name AS contig, CAST(n_nationkey * 1000 AS BIGINT) AS length, n_nationkey FROM nation)"


@query(f"""WITH {EXON}, {PAIR}, {CONTIGS}, strand AS (SELECT * FROM (VALUES ('+', 0), ('-', 1)) t(strand, s)),
seen AS (SELECT gene_id % 25 AS n_nationkey, CASE WHEN gene_id % 2 = 1 THEN 1 ELSE 0 END AS s, ue, vs, count(*) AS n FROM pair GROUP BY ALL),
total AS (SELECT n_nationkey, s, count(*) AS n_introns, sum(n) AS n_reads FROM seen GROUP BY ALL)
SELECT 2 * contig_id + s AS region_id, contig_id, contig, strand, length, coalesce(n_introns, 0) AS n_introns, CAST(coalesce(n_reads, 0) AS BIGINT) AS n_reads
FROM contig CROSS JOIN strand LEFT JOIN total USING (n_nationkey, s)""")
def region_summary(spark, sf_dir):
    """Introns and their reads by contig and strand, contigs numbered as a header lists them."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    number = F.row_number().over(Window.orderBy("n_regionkey", "n_nationkey")) - 1  # a row a contig
    listed = nations.select(number.alias("contig_id"), F.col("n_name").alias("contig"), (F.col("n_nationkey") * 1000).cast("long").alias("length"), "n_nationkey")
    found = quant.junction_counts(exons(spark, sf_dir)).withColumn("n_nationkey", F.col("gene_id") % 25).withColumn("xs", F.when(F.col("gene_id") % 2 == 1, "-").otherwise("+"))
    return placed.region_summary(found.join(listed.select("contig", "n_nationkey"), "n_nationkey"), listed.drop("n_nationkey"))


# --- reads ---------------------------------------------------------------------------------

STRICT = reads.ReadFilter.preset(1, 300)
LOOSE = reads.ReadFilter.preset(0, 100)
PLACE = "sample_id AS sample, contig"
READS = f"WITH {EXON}, {READ}, counted AS (SELECT * FROM read WHERE flag = 0)"


def _counted(spark, sf_dir) -> DataFrame:
    return aligned(spark, sf_dir).where(reads.passes(None))


def _meets(given: reads.ReadFilter) -> str:
    return f"flag = 0 AND (n_blocks = 1 OR anchor > {given.exon_len}) AND nm <= {given.mismatch}"


def _introns_sql(given: reads.ReadFilter) -> str:
    return f"""{READS} SELECT b.sample_id AS sample, b.contig, CASE WHEN xs = '-' THEN '-' ELSE '+' END AS strand, e AS i_start, next AS i_end, count(*) AS n
FROM block b JOIN (SELECT read_id, xs FROM read WHERE {_meets(given)}) r USING (read_id) WHERE next IS NOT NULL GROUP BY ALL"""


@query(f"{READS} SELECT read_id, pos, {_meets(STRICT)} AS ok FROM read")
def read_filter(spark, sf_dir):
    """Which reads a preset lets pass: mapped, primary, anchors, mismatches."""
    return longs(aligned(spark, sf_dir).select("read_id", "pos", reads.passes(STRICT).alias("ok")))


@query(_introns_sql(STRICT))
def read_junctions(spark, sf_dir):
    """Introns of the CIGAR strings of the reads that pass."""
    return longs(reads.junctions(aligned(spark, sf_dir).where(reads.passes(STRICT))))


@query(f"""{READS} SELECT b.sample_id AS sample, b.contig, coalesce(xs, '.') AS xs, e AS i_start, next AS i_end, greatest(least(anchor, 37), {LOOSE.exon_len}) AS anchor,
  least(nm, {LOOSE.mismatch + 1}) AS wrong, count(*) AS n FROM block b JOIN (SELECT read_id, xs, anchor, nm FROM counted) r USING (read_id) WHERE next IS NOT NULL GROUP BY ALL""")
def junction_cube(spark, sf_dir):
    """Introns by shortest anchor and mismatches, of all mapped primary reads."""
    return longs(reads.junction_cube(_counted(spark, sf_dir), LOOSE, reads.mismatches()))


@query(_introns_sql(LOOSE.tightened().tightened()))
def tightened_junctions(spark, sf_dir):
    """A filter made tighter twice is a sum over the cube: the same introns as of the reads that pass it."""
    cube = reads.junction_cube(_counted(spark, sf_dir), LOOSE, reads.mismatches())
    return longs(reads.cube_junctions(cube, LOOSE.tightened().tightened()))


@query(f"""{READS}, mark AS (SELECT b.*, {_meets(STRICT)} AS ok FROM block b JOIN (SELECT read_id, flag, n_blocks, anchor, nm FROM counted) r USING (read_id)),
step AS (SELECT sample_id, contig, pos, sum(d) FILTER (ok) AS a, sum(d) AS b FROM (SELECT sample_id, contig, ok, s AS pos, 1 AS d FROM mark UNION ALL SELECT sample_id, contig, ok, e, -1 FROM mark) t GROUP BY ALL)
SELECT * FROM (SELECT {PLACE}, pos AS run_start, lead(pos) OVER w AS run_end, CAST(coalesce(sum(a) OVER w, 0) AS BIGINT) AS strict, CAST(sum(b) OVER w AS BIGINT) AS depth
  FROM step WINDOW w AS (PARTITION BY sample_id, contig ORDER BY pos)) t WHERE run_end IS NOT NULL AND depth > 0""")
def read_depth(spark, sf_dir):
    """Depth of the reads that pass a preset, and of all, in one pass over the CIGAR strings."""
    return longs(reads.tracks(_counted(spark, sf_dir), strict=reads.passes(STRICT), depth=F.lit(True)))


# --- the statistics before and after the fit -----------------------------------------------

QUERIES["hommel"], QUERIES["tsbh"] = _adjusted("hommel"), _adjusted("tsbh")
ORACLES["hommel"] = f"""{RANKED}, top AS (SELECT CAST(unnest(range(1, max(m) + 1)) AS BIGINT) AS k FROM ranked),
simes AS (SELECT k, min(k * p / (r - (m - k))) AS s FROM ranked JOIN top ON r > m - k GROUP BY k),
beyond AS (SELECT k - 1 AS h, max(s) OVER (ORDER BY k DESC) AS b FROM simes UNION ALL SELECT max(k), 0 FROM top),
each AS (SELECT event_id, p, min(greatest(h * p, b)) AS v FROM ranked CROSS JOIN beyond GROUP BY ALL)
SELECT event_id, round(p, 9) AS p, round(least(1, greatest(v, p)), 9) AS p_adj FROM each"""
ORACLES["tsbh"] = f"""{RANKED}, bh AS (SELECT *, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM ranked),
passed AS (SELECT count(*) FILTER (v <= 0.1 / 1.1) AS n FROM bh)
SELECT event_id, round(p, 9) AS p, round(least(1, v * CASE WHEN m > n THEN m - n ELSE m END / m::DOUBLE * 1.1), 9) AS p_adj FROM bh, passed"""


@query(f"""SELECT gene_id, greatest(e1s, e2s) AS e1s, e1e, greatest(e1s, e2s) AS e2s, e2e, e3s, e3e FROM ({ORACLES['alt_left']}) t
WHERE e3s > e1e AND e3s > e2e AND e1e > greatest(e1s, e2s) AND e2e > greatest(e1s, e2s)""")
def curated_alt_left(spark, sf_dir):
    """Alternative left ends with both exons from the later start on."""
    return events.curate_alt_left(events.alt_left(graph.edges(exons(spark, sf_dir))))


FORMS = """form AS (SELECT gene_id, sample_id, 1 AS form, count(*) AS n FROM exon GROUP BY ALL UNION ALL SELECT gene_id, sample_id, 0, count(*) FROM pair GROUP BY ALL),
cell AS (SELECT gene_id, sample_id, form, coalesce(n, 0)::DOUBLE AS n FROM (SELECT DISTINCT gene_id, form FROM form) g JOIN (SELECT DISTINCT sample_id, form FROM form) s USING (form) LEFT JOIN form USING (gene_id, sample_id, form)),
joined AS (SELECT c.*, round(coalesce(x, 0), 6) AS x, sf FROM cell c LEFT JOIN grid USING (gene_id, sample_id) JOIN sf USING (sample_id))"""


def _forms(spark, sf_dir) -> DataFrame:
    """Genes as events: introns are form 0, exons form 1; every sample has a count."""
    e = exons(spark, sf_dir)
    found = [df.groupBy("gene_id", "sample_id").agg(F.count("*").cast("double").alias("n")) for df in (graph.consecutive(e, ["sample_id"]), e)]
    parts = [quant.dense(df, "gene_id", "sample_id", "n").withColumn("form", F.lit(k)) for k, df in enumerate(found)]
    return parts[0].unionByName(parts[1]).withColumn("event_id", F.col("gene_id"))


def _response(spark, sf_dir) -> DataFrame:
    expr = quant.gene_expression(_cov(spark, sf_dir))
    gene_sf = quant.size_factors(expr)
    groups = gene_sf.select("sample_id", (F.col("sample_id") < 6).alias("in_a"))
    event_sf = gene_sf.select("sample_id", (1 + F.col("sample_id") / 10).alias("sf"))
    return testing.response(_forms(spark, sf_dir), expr.withColumn("raw_count", rounded("raw_count")), event_sf, gene_sf, groups)


@query(f"""{QUANT}, {FULL}, {GEO}, {FORMS}, placed AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY gene_id, form) AS half FROM joined WINDOW w AS (PARTITION BY gene_id, form ORDER BY sample_id >= 6, sample_id))
SELECT gene_id AS event_id, CAST(form AS BIGINT) AS form, k AS place, n AS y, round(1 + sample_id / 10.0, 6) AS sf, sample_id < 6 AS in_a FROM placed
UNION ALL SELECT gene_id, form, k + half, round_even(x + 0.5, 0), round(sf, 6), sample_id < 6 FROM placed""")
def response_matrix(spark, sf_dir):
    """Counts of event and gene in the order of groups and samples, as the tests get them; a row for each place."""
    packed = _response(spark, sf_dir)
    flat = packed.select("event_id", "form", "in_a", F.posexplode(F.arrays_zip("y", "sf")).alias("place", "v"))
    in_a = F.get("in_a", F.col("place") % F.size("in_a")) == 1
    return longs(flat.select("event_id", "form", "place", F.col("v.y").alias("y"), rounded("v.sf").alias("sf"), in_a.alias("in_a")))


def _mean_sql(value: str, name: str) -> str:
    a, b = (f"avg({value}) FILTER (sample_id {op} 6)" for op in ("<", ">="))
    return f"round({a}, 6) AS mean_{name}_a, round({b}, 6) AS mean_{name}_b, CASE WHEN {a} > 0 AND {b} > 0 THEN round(log2({a}) - log2({b}), 6) END AS log2fc_{name}"


@query(f"""{QUANT}, {FULL}, {GEO}, {FORMS} SELECT gene_id AS event_id, CAST(form AS BIGINT) AS form, {_mean_sql('n / (1 + sample_id / 10.0)', 'event_count')}, {_mean_sql('round_even(x + 0.5, 0) / sf', 'gene_exp')}
FROM joined GROUP BY gene_id, form""")
def report_means(spark, sf_dir):
    """Means and log fold changes of a report's rows, of events and genes."""
    out = testing.means(_response(spark, sf_dir))
    named = {f"mean_{x}_{g}": f"mean_{x}_{g.lower()}" for x in ("event_count", "gene_exp") for g in "AB"} | {f"log2FC_{x}": f"log2fc_{x}" for x in ("event_count", "gene_exp")}
    return longs(out.select("event_id", "form", *[rounded(c).alias(n) for c, n in named.items()]))


@query(f"""{WITH}, sf AS (SELECT DISTINCT sample_id, 1.0 AS sf FROM exon), grid AS (SELECT gene_id, sample_id, 0.0 AS x FROM exon WHERE false), {FORMS}, lg AS (SELECT *, log2(n + 1) AS l FROM joined),
q AS (SELECT gene_id, form, quantile_cont(l, 0.25) AS p25, quantile_cont(l, 0.75) AS p75 FROM lg GROUP BY gene_id, form)
SELECT gene_id, CAST(form AS BIGINT) AS form, sample_id, round(CASE WHEN p75 > p25 AND l > p75 + 3 * (p75 - p25) THEN pow(2, p75 + 3 * (p75 - p25)) - 1 ELSE n END, 6) AS capped FROM lg JOIN q USING (gene_id, form)""")
def cap_event_counts(spark, sf_dir):
    """Counts of events far above their form's quartiles come down."""
    rows = _forms(spark, sf_dir).withColumn("row", F.struct("event_id", "form"))
    return longs(testing.cap_outliers(rows, "row", "n", None, 3.0).select("gene_id", "form", "sample_id", rounded("capped").alias("capped")))


@query(f"""{WITH}, {RUNS}, {SEGS}, {COV} SELECT gene_id, seg_start, seg_end, sample_id % 2 AS half, round(avg(mean_cov), 6) AS mean, round(stddev_samp(mean_cov) / sqrt(count(*)), 6) AS sem FROM cov GROUP BY ALL""")
def segment_means(spark, sf_dir):
    """Mean depth of segments by group of samples, with its standard error."""
    depth = _cov(spark, sf_dir).withColumnRenamed("sample_id", "sample")
    groups = exons(spark, sf_dir).select(F.col("sample_id").alias("sample"), (F.col("sample_id") % 2).alias("group")).distinct()
    out = viz_data.segment_means(depth, groups)
    return out.select("gene_id", "seg_start", "seg_end", F.col("group").alias("half"), rounded("mean").alias("mean"), rounded("sem").alias("sem"))
