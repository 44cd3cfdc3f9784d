"""Junction counts over a stream of alignment files: an extension, the batch build does not use it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from junctura.functions import cigar
from junctura.operators import reads
from junctura.sources import alignments


def read_alignments(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of alignments as they arrive."""
    return spark.readStream.schema(alignments.SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def junction_counts(rows: DataFrame, given: reads.ReadFilter | None = None) -> DataFrame:
    """Running counts of sample, contig, strand, i_start, i_end; state is one row a junction."""
    kept = rows.where(reads.passes(given) & cigar.is_spliced(F.col("cigar")))
    strand = F.when(F.col("xs") == "-", "-").otherwise("+").alias("strand")
    each = kept.select("sample", "contig", strand, F.explode(cigar.junctions(F.col("pos"), F.col("cigar"))).alias("j"))
    return each.groupBy("sample", "contig", "strand", F.col("j.start").alias("i_start"), F.col("j.stop").alias("i_end")).agg(F.count("*").alias("n"))


def write(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch replaces the table of counts: a batch that is run again writes the same."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
