"""Tables by place: numbers of contigs in the headers' order, and files sorted by contig and position.

The statistics of such files say which row groups hold a stretch of a contig, so the reads
of a gene's or a plot's window skip the others; nothing but Parquet is needed for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.sources import alignments

ROW_GROUP = 16 << 20
WRITE = {"parquet.block.size": str(ROW_GROUP)}  # options of the writer
NOT_LISTED = (1 << 31) - 1  # the number of contigs that no header lists; they come last, by name


def contigs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """contig_id, contig, length: numbered from 0 as the files' headers list them, those of later files after the first file's.

    Parquet files and texts without a header list none.  A table of as many rows as there
    are contigs, which is why one window may number it."""
    listed = [(k, p) for k, p in enumerate(paths) if not p.endswith(".parquet")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, i, c, n) for k, p in zip(pdf["file"], pdf["path"]) for i, (c, n) in enumerate(alignments.header(p))]
            yield pd.DataFrame(rows, columns=["file", "place", "contig", "length"])

    files = spark.createDataFrame(listed, "file int, path string").repartition(max(1, min(len(listed), 200)))
    each = files.mapInPandas(run, "file int, place int, contig string, length long")
    first = each.groupBy("contig").agg(F.min(F.struct("file", "place", "length")).alias("f"))
    number = F.row_number().over(Window.orderBy("f.file", "f.place")) - 1
    return first.select(number.alias("contig_id"), "contig", F.col("f.length").alias("length"))


def regions(contigs: DataFrame) -> DataFrame:
    """region_id, contig_id, contig, strand, length: each strand of each contig, two numbers a contig."""
    both = contigs.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    return both.select((2 * F.col("contig_id") + (F.col("strand") == "-").cast("int")).alias("region_id"), "contig_id", "contig", "strand", "length")


def region_summary(junctions: DataFrame, contigs: DataFrame) -> DataFrame:
    """The :func:`regions` with how many introns and spliced reads they have, none included; an intron without a strand counts as plus.

    junctions: contig, xs, i_start, i_end, n.  Contigs that no header lists have no region."""
    strand = F.when(F.col("xs") == "-", "-").otherwise("+")
    introns = junctions.groupBy("contig", strand.alias("strand"), "i_start", "i_end").agg(F.sum("n").alias("n"))
    seen = introns.groupBy("contig", "strand").agg(F.count("*").alias("n_introns"), F.sum("n").alias("n_reads"))
    zero = F.lit(0).cast("long")
    return regions(contigs).join(seen, ["contig", "strand"], "left").select("region_id", "contig_id", "contig", "strand", "length", F.coalesce("n_introns", zero).alias("n_introns"), F.coalesce("n_reads", zero).alias("n_reads"))


def clustered(df: DataFrame, contigs: DataFrame, start: str, *rest: str) -> DataFrame:
    """``df`` with contig_id, in ranges of contig and ``start``, each sorted.

    ``rest`` completes the order, so that a place that very many samples share can be cut
    between ranges.  ``contigs`` is small where it comes from a written table, and then
    Spark broadcasts it by its size on its own."""
    numbered = df.join(contigs.select("contig", "contig_id"), "contig", "left").withColumn("contig_id", F.coalesce("contig_id", F.lit(NOT_LISTED)))
    order = ["contig_id", "contig", start, *rest]
    return numbered.repartitionByRange(*order).sortWithinPartitions(*order)


def window(df: DataFrame, contig: str, start: int, stop: int, first: str, last: str) -> DataFrame:
    """The rows of a clustered table that overlap [start, stop) of a contig; all three conditions reach the files' statistics."""
    return df.where((F.col("contig") == contig) & (F.col(first) < stop) & (F.col(last) > start))
