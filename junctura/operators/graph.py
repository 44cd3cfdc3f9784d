"""Splice graphs as tables: vertices are exons, edges are introns between consecutive exons.

exons: gene_id, transcript_id, ex_start, ex_end.  vertices: gene_id, v_start,
v_end.  edges: gene_id, us, ue, vs, ve with the left exon first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.operators import intervals

EDGE = ["gene_id", "us", "ue", "vs", "ve"]


def vertices(exons: DataFrame) -> DataFrame:
    return exons.select("gene_id", F.col("ex_start").alias("v_start"), F.col("ex_end").alias("v_end")).distinct()


def followed(exons: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Each exon (us, ue) with the next one of its transcript (vs, ve; null after the last)."""
    by = Window.partitionBy("gene_id", "transcript_id").orderBy("ex_start", "ex_end")
    return exons.select("gene_id", "transcript_id", *keep, F.col("ex_start").alias("us"), F.col("ex_end").alias("ue"), F.lead("ex_start").over(by).alias("vs"), F.lead("ex_end").over(by).alias("ve"))


def consecutive(exons: DataFrame, keep: list[str] = ()) -> DataFrame:
    """A row for each pair of consecutive exons of a transcript with an intron between."""
    return followed(exons, keep).where("vs IS NOT NULL AND vs > ue")


def edges(exons: DataFrame) -> DataFrame:
    return consecutive(exons).select(*EDGE).distinct()


def vertices_and_edges(exons: DataFrame, keep: list[str] = ()) -> DataFrame:
    """gene_id, keep, us, ue, vs, ve without doubles (a vertex has no vs and ve), from one pass over the exons."""
    none = F.lit(None).cast("long")
    alone, edge = F.struct(none.alias("vs"), none.alias("ve")), F.struct(F.col("vs").cast("long").alias("vs"), F.col("ve").cast("long").alias("ve"))
    each = F.when(F.col("vs") > F.col("ue"), F.array(alone, edge)).otherwise(F.array(alone))
    return followed(exons, keep).withColumn("each", each).select("gene_id", *keep, "us", "ue", F.inline("each")).distinct()


def introns(exons: DataFrame) -> DataFrame:
    """Distinct introns: gene_id, i_start, i_end."""
    return consecutive(exons).select("gene_id", F.col("ue").alias("i_start"), F.col("vs").alias("i_end")).distinct()


def terminals(verts: DataFrame, edge: DataFrame) -> DataFrame:
    """Vertices with is_start (nothing leads to it) and is_end (it leads nowhere)."""
    right = edge.select("gene_id", F.col("vs").alias("v_start"), F.col("ve").alias("v_end"), F.lit(1).alias("r"), F.lit(0).alias("l"))
    left = edge.select("gene_id", F.col("us").alias("v_start"), F.col("ue").alias("v_end"), F.lit(0).alias("r"), F.lit(1).alias("l"))
    marks = verts.select("gene_id", "v_start", "v_end", F.lit(0).alias("r"), F.lit(0).alias("l")).unionByName(right).unionByName(left)
    return marks.groupBy("gene_id", "v_start", "v_end").agg((F.max("r") == 0).alias("is_start"), (F.max("l") == 0).alias("is_end"))


def exon_terminals(exons: DataFrame) -> DataFrame:
    """:func:`terminals` of the graph of ``exons``, from one pass over them."""
    mark = lambda s, e, r, l: F.struct(F.col(s).alias("v_start"), F.col(e).alias("v_end"), F.lit(r).alias("r"), F.lit(l).alias("l"))
    marks = F.when(F.col("vs") > F.col("ue"), F.array(mark("us", "ue", 0, 1), mark("vs", "ve", 1, 0))).otherwise(F.array(mark("us", "ue", 0, 0)))
    return followed(exons).select("gene_id", F.inline(marks)).groupBy("gene_id", "v_start", "v_end").agg((F.max("r") == 0).alias("is_start"), (F.max("l") == 0).alias("is_end"))


def edge_support(exons: DataFrame) -> DataFrame:
    """How many samples have each edge: the merge of the samples' graphs in one aggregation."""
    return consecutive(exons, ["sample_id"]).groupBy(*EDGE).agg(F.countDistinct("sample_id").alias("n_samples"))


def validated(support: DataFrame, least: int) -> DataFrame:
    return support.where(F.col("n_samples") >= least)


def validated_vertices(verts: DataFrame, all_edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Vertices that had no edge at all, or still have one."""
    ends = lambda e: e.select("gene_id", F.col("us").alias("v_start"), F.col("ue").alias("v_end")).unionByName(e.select("gene_id", F.col("vs").alias("v_start"), F.col("ve").alias("v_end"))).distinct()
    key = ["gene_id", "v_start", "v_end"]
    lost = ends(all_edges).join(ends(kept), key, "left_anti")
    return verts.join(lost, key, "left_anti")


def segments(verts: DataFrame) -> DataFrame:
    return intervals.segments(verts, ["gene_id"])


def vertex_segments(verts: DataFrame, segs: DataFrame) -> DataFrame:
    """Which segments make up each vertex."""
    return verts.join(segs, "gene_id").where("v_start <= seg_start AND seg_end <= v_end")


def segment_edges(edge: DataFrame, segs: DataFrame) -> DataFrame:
    """The last segment of the left exon and the first of the right one, for each edge.

    Segments end where vertices end, so two equality joins find them."""
    donor = segs.select("gene_id", F.col("seg_start").alias("d_start"), F.col("seg_end").alias("ue"))
    acceptor = segs.select("gene_id", F.col("seg_start").alias("vs"), F.col("seg_end").alias("a_end"))
    out = edge.select("gene_id", "ue", "vs").distinct().join(donor, ["gene_id", "ue"]).join(acceptor, ["gene_id", "vs"])
    return out.select("gene_id", "d_start", F.col("ue").alias("d_end"), F.col("vs").alias("a_start"), "a_end")


def label_alt(verts: DataFrame, edge: DataFrame) -> DataFrame:
    """Genes in which some position is covered more than once by exons and introns."""
    spans = verts.select("gene_id", F.col("v_start").alias("s"), F.col("v_end").alias("e")).unionByName(edge.select("gene_id", F.col("ue").alias("s"), F.col("vs").alias("e")).distinct())
    return intervals.max_depth(spans, ["gene_id"], "s", "e").select("gene_id", F.col("max_depth").cast("long").alias("max_depth"), (F.col("max_depth") > 1).alias("is_alt"))


def simple_terminals(verts: DataFrame, edge: DataFrame) -> DataFrame:
    """Terminal exons that are mere alternatives: gene_id, v_start, v_end.

    A first exon is one if others have its end, all of them have its successors, and
    none has a predecessor that ends after it starts.  A last exon is one if others have
    its start, all of them have its predecessors, and for each of their successors the
    exon just before it, in the gene's order, does not start before it ends."""
    order = Window.partitionBy("gene_id").orderBy("v_start", "v_end")
    v = verts.select("gene_id", "v_start", "v_end").withColumn("k", F.row_number().over(order))
    left = v.select("gene_id", F.col("v_start").alias("us"), F.col("v_end").alias("ue"), F.col("k").alias("u"))
    right = v.select("gene_id", F.col("v_start").alias("vs"), F.col("v_end").alias("ve"), F.col("k").alias("v"))
    e = edge.select(*EDGE).join(left, ["gene_id", "us", "ue"]).join(right, ["gene_id", "vs", "ve"])
    start_before = v.select("gene_id", (F.col("k") + 1).alias("v"), F.col("v_start").alias("near"))
    after = e.join(start_before, ["gene_id", "v"], "left").groupBy("gene_id", F.col("u").alias("k")).agg(F.sort_array(F.collect_set("v")).alias("next"), F.min("near").alias("near"))
    before = e.groupBy("gene_id", F.col("v").alias("k")).agg(F.sort_array(F.collect_set("u")).alias("last"), F.max("ue").alias("end_before"))
    full = v.join(after, ["gene_id", "k"], "left").join(before, ["gene_id", "k"], "left")
    other = full.select("gene_id", *[F.col(c).alias(f"o_{c}") for c in full.columns if c != "gene_id"])
    c = F.col
    same_end = full.where("last IS NULL").join(other.withColumn("v_end", c("o_v_end")), ["gene_id", "v_end"]).where("k <> o_k")
    bad_end = ~c("next").eqNullSafe(c("o_next")) | F.coalesce(c("o_end_before") > c("v_start"), F.lit(False))
    same_start = full.where("next IS NULL").join(other.withColumn("v_start", c("o_v_start")), ["gene_id", "v_start"]).where("k <> o_k")
    bad_start = ~c("last").eqNullSafe(c("o_last")) | F.coalesce(c("o_near") < c("v_end"), F.lit(False))
    key = ["gene_id", "v_start", "v_end"]
    first = same_end.groupBy(*key).agg(F.max(bad_end).alias("bad")).where("NOT bad")
    last = same_start.groupBy(*key).agg(F.max(bad_start).alias("bad")).where("NOT bad")
    return first.select(*key).unionByName(last.select(*key)).distinct()


def label_alt_full(verts: DataFrame, edge: DataFrame) -> DataFrame:
    """gene_id, is_alt_spliced and is_alt of each gene.

    Alternatively spliced: without its simple alternative terminals, some position is
    covered more than once by exons and introns.  Alternative: that, or there are such terminals."""
    simple = simple_terminals(verts, edge)
    key = ["gene_id", "v_start", "v_end"]
    left, right = (simple.toDF("gene_id", *names) for names in (("us", "ue"), ("vs", "ve")))
    rest = verts.select(*key).join(simple, key, "left_anti")
    kept = edge.join(left, ["gene_id", "us", "ue"], "left_anti").join(right, ["gene_id", "vs", "ve"], "left_anti")
    deep = label_alt(rest, kept).select("gene_id", F.col("is_alt").alias("deep"))
    some = simple.select("gene_id").distinct().withColumn("some", F.lit(True))
    genes = verts.groupBy("gene_id").agg(F.count("*").alias("n")).join(deep, "gene_id", "left").join(some, "gene_id", "left")
    spliced = (F.col("n") > 1) & F.coalesce("deep", F.lit(False))
    return genes.select("gene_id", spliced.alias("is_alt_spliced"), ((F.col("n") > 1) & (F.coalesce("deep", F.lit(False)) | F.coalesce("some", F.lit(False)))).alias("is_alt"))


def unambiguous(candidates: DataFrame, genes: DataFrame, pad: int = 200, width: int | None = None) -> DataFrame:
    """Introns (contig, i_start, i_end) that, padded, overlap exactly one gene (contig, g_start, g_end)."""
    key = ["contig", "i_start", "i_end"]
    padded = candidates.select(*key).distinct().withColumn("__s", F.col("i_start") - pad).withColumn("__e", F.col("i_end") + pad)
    pairs = intervals.interval_join(padded, genes, ["contig"], ("__s", "__e"), ("g_start", "g_end"), width)
    return pairs.groupBy(*key).agg(F.count("*").alias("n")).where("n = 1").select(*key)


def single_cover(segs: DataFrame, seg_edges: DataFrame) -> DataFrame:
    """Segments that no edge spans: from after its donor up to its acceptor, which counts as spanned."""
    e = seg_edges.select("gene_id", F.col("d_end").alias("__d"), F.col("a_start").alias("__a")).distinct()
    spanned = (F.col("seg_start") >= F.col("__d")) & (F.col("seg_start") <= F.col("__a"))
    return segs.join(e, (segs["gene_id"] == e["gene_id"]) & spanned, "left_anti")


def bounded_merge(rows: DataFrame, limit: int) -> DataFrame:
    """gene_id, us, ue, vs, ve, n_samples of all samples' graphs, merged one sample after another.

    rows: gene_id, us, ue, vs, ve (a vertex has no vs), place (the sample's place in the
    order) and n (how many samples the row stands for).  Once a gene has more than ``limit``
    vertices it takes no more vertices and edges; those it has are still counted in all
    samples.  Where a gene stops follows from the running number of vertices by the place
    they are first seen at; ``place`` is a whole number.  Rows are used once, so what makes them runs once."""
    each = rows.groupBy("gene_id", "us", "ue", "vs", "ve").agg(F.min("place").alias("first"), F.sum("n").alias("n_samples"))
    earlier = Window.partitionBy("gene_id").orderBy("first").rangeBetween(Window.unboundedPreceding, -1)
    had = F.coalesce(F.sum(F.col("vs").isNull().cast("long")).over(earlier), F.lit(0))
    return each.withColumn("had", had).where(F.col("gene_id").isNull() | (F.col("had") <= limit)).drop("first", "had")
