"""Gene annotation: GTF and GFF3 as tables of genes and exons, 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GENE_FEATURES = ["gene", "pseudogene", "unprocessed_pseudogene", "transposable_element_gene"]
COLUMNS = ["contig", "source", "feature", "start", "end", "score", "strand", "frame", "attributes"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a nine-column file; comments and the sequences after ##FASTA are left out, start is shifted to 0."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & ~F.col("value").startswith(">") & (F.size(parts) >= 9))
    out = rows.select(*[parts[i].alias(c) for i, c in enumerate(COLUMNS)])
    return out.withColumn("start", F.col("start").cast("int") - 1).withColumn("end", F.col("end").cast("int"))


def gtf_tag(name: str) -> Column:
    """The value of ``name "value";`` (null: absent)."""
    found = F.regexp_extract("attributes", rf'(?:^|;)\s*{name}\s+"?([^";]*)"?', 1)
    return F.when(found != "", found)


def gff_tag(name: str) -> Column:
    found = F.regexp_extract("attributes", rf"(?:^|;)\s*{name}=([^;]*)", 1)
    return F.when(found != "", found)


def read_gtf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(genes, exons).  An exon needs gene_id and transcript_id.  If a gene has no row
    of its own, all genes' bounds come from their exons."""
    rows = lines(spark, path)
    kind = F.coalesce(gtf_tag("gene_type"), gtf_tag("gene_biotype"))
    tagged = rows.withColumns({"gene_id": gtf_tag("gene_id"), "transcript_id": gtf_tag("transcript_id"), "gene_type": kind, "gene_symbol": F.coalesce(gtf_tag("gene_name"), gtf_tag("gene_id"))})
    exons = tagged.where("feature = 'exon'")
    if not exons.where("gene_id IS NULL OR transcript_id IS NULL").isEmpty():
        raise ValueError("an exon row has no gene_id or transcript_id")
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    own = tagged.where(F.col("feature").isin(GENE_FEATURES)).groupBy("gene_id").agg(F.min("start").alias("g_start"), F.max("end").alias("g_end"), *map(first, ("contig", "strand", "gene_type", "gene_symbol", "source")))
    seen = exons.groupBy("gene_id").agg(F.min("start").alias("s"), F.max("end").alias("e"), *[F.first(c, ignorenulls=True).alias(f"x_{c}") for c in ("contig", "strand", "gene_type", "gene_symbol", "source")])
    both = own.join(seen, "gene_id", "full")
    inferred = not both.where("g_start IS NULL").isEmpty()
    start, end = ("s", "e") if inferred else ("g_start", "g_end")
    genes = both.where("s IS NOT NULL").select("gene_id", *[F.coalesce(c, f"x_{c}").alias(c) for c in ("contig", "strand", "gene_type", "gene_symbol", "source")], F.col(start).alias("g_start"), F.col(end).alias("g_end"))
    return genes, exons.select("gene_id", "transcript_id", "contig", "strand", F.col("start").alias("ex_start"), F.col("end").alias("ex_end"))


def read_gff3(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(genes, exons): rows with ID and Parent are transcripts, with ID alone genes; exons name their transcripts."""
    rows = lines(spark, path).where(~F.col("feature").isin("chromosome", "contig", "supercontig"))
    tagged = rows.withColumns({"id": gff_tag("ID"), "parent": gff_tag("Parent")})
    exon = F.col("feature").isin("exon", "pseudogenic_exon")
    tx = tagged.where(~exon & F.col("id").isNotNull() & F.col("parent").isNotNull()).select(F.col("id").alias("transcript_id"), F.col("parent").alias("gene_id")).distinct()
    genes = tagged.where(~exon & F.col("id").isNotNull() & F.col("parent").isNull())
    parts = tagged.where(exon).select("contig", "strand", F.col("start").alias("ex_start"), F.col("end").alias("ex_end"), F.explode(F.split("parent", ",")).alias("transcript_id"))
    exons = parts.join(tx, "transcript_id").join(genes.select(F.col("id").alias("gene_id")).distinct(), "gene_id", "left_semi")
    out = genes.select(F.col("id").alias("gene_id"), "contig", "strand", F.col("feature").alias("gene_type"), F.coalesce(gff_tag("Name"), F.col("id")).alias("gene_symbol"), "source", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    return out, exons.select("gene_id", "transcript_id", "contig", "strand", "ex_start", "ex_end")


def checked(genes: DataFrame, exons: DataFrame, drop_overlapping_genes: bool = False, drop_shared_exons: bool = False, drop_overlapping_exons: bool = False) -> tuple[DataFrame, DataFrame]:
    """Leave out genes without exons and, if asked for, those that overlap another gene,
    share an exact exon with one, or have a transcript whose exons overlap."""
    from pyspark.sql import Window

    from junctura.operators import intervals

    genes = genes.join(exons.select("gene_id").distinct(), "gene_id", "left_semi")
    if drop_overlapping_genes:
        closed = genes.select("gene_id", "contig", "strand", F.col("g_start").alias("s"), (F.col("g_end") + 1).alias("e"))
        other = closed.select(F.col("gene_id").alias("o"), "contig", "strand", F.col("s").alias("os"), F.col("e").alias("oe"))
        bad = intervals.interval_join(closed, other, ["contig", "strand"], ("s", "e"), ("os", "oe"), 1 << 16).where("gene_id <> o").select("gene_id").distinct()
        genes = genes.join(bad, "gene_id", "left_anti")
    if drop_shared_exons:
        by = ["contig", "strand", "ex_start", "ex_end"]
        shared = exons.groupBy(*by).agg(F.countDistinct("gene_id").alias("n")).where("n > 1").drop("n")
        genes = genes.join(exons.join(shared, by).select("gene_id").distinct(), "gene_id", "left_anti")
    if drop_overlapping_exons:
        by = Window.partitionBy("gene_id", "transcript_id").orderBy("ex_start", "ex_end")
        bad = exons.withColumn("__next", F.lead("ex_start").over(by)).where("__next < ex_end").select("gene_id").distinct()
        genes = genes.join(bad, "gene_id", "left_anti")
    return genes, exons.join(genes.select("gene_id"), "gene_id", "left_semi")
