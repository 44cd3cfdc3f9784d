"""The driver's tables seen as exons.

An order is a transcript, its customer a gene and a sample, its line items exons.
The same text of SQL serves DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXON = """
exon AS (
SELECT gene_id, transcript_id, sample_id, ex_start, ex_end FROM (
  SELECT o.o_custkey % 1000 AS gene_id, l.l_orderkey AS transcript_id, o.o_custkey % 12 AS sample_id,
         (l.l_partkey % 10) * 100 + (l.l_suppkey % 3) * 10 AS ex_start,
         (l.l_partkey % 10) * 100 + 50 + (CAST(l.l_quantity AS INT) % 2) * 20
           + CASE WHEN CAST(l.l_quantity AS INT) % 11 = 0 THEN 100 ELSE 0 END AS ex_end,
         row_number() OVER (PARTITION BY l.l_orderkey, l.l_partkey % 10
                            ORDER BY l.l_suppkey, l.l_quantity, l.l_partkey, l.l_linenumber) AS rn
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey) t
WHERE rn = 1)"""
PAIR = """
pair AS (
SELECT * FROM (
  SELECT gene_id, transcript_id, sample_id, ex_start us, ex_end ue,
         lead(ex_start) OVER (PARTITION BY transcript_id ORDER BY ex_start, ex_end) vs,
         lead(ex_end)   OVER (PARTITION BY transcript_id ORDER BY ex_start, ex_end) ve
  FROM exon) t
WHERE vs IS NOT NULL AND vs > ue)"""
EDGE = "edge AS (SELECT DISTINCT gene_id, us, ue, vs, ve FROM pair)"
# reads: an order is one, its blocks are the exons cut where the next hundred begins
READ = """
block AS (SELECT transcript_id AS read_id, sample_id, gene_id % 4 AS contig, ex_start AS s, least(ex_end, ex_start // 100 * 100 + 90) AS e,
  lead(ex_start) OVER (PARTITION BY transcript_id ORDER BY ex_start) AS next FROM exon),
read AS (SELECT read_id, sample_id, contig, min(s) AS pos, min(e - s) AS anchor, count(*) AS n_blocks, read_id % 9 AS nm,
  CASE WHEN read_id % 11 = 0 THEN 4 WHEN read_id % 7 = 0 THEN 256 ELSE 0 END AS flag, CASE read_id % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' END AS xs FROM block GROUP BY ALL)"""
VERTEX = "vertex AS (SELECT DISTINCT gene_id, ex_start AS v_start, ex_end AS v_end FROM exon)"


ROWS = 500_000  # line items a task


def _dealt(spark: SparkSession, line: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both by order, in as many partitions as the line items need, whatever the session's number: a task sorts no more of a larger table."""
    n = -(-line.count() // ROWS)  # from the files' footers
    if n <= 1:
        return line, order
    n = max(n, spark.sparkContext.defaultParallelism)
    return line.repartition(n, "l_orderkey"), order.repartition(n, "o_orderkey")


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_id, transcript_id, sample_id, ex_start, ex_end."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    order = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    line, order = _dealt(spark, line, order)
    q = F.col("l_quantity").cast("int")
    rows = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") % 1000).alias("gene_id"),
        F.col("l_orderkey").alias("transcript_id"),
        (F.col("o_custkey") % 12).alias("sample_id"),
        ((F.col("l_partkey") % 10) * 100 + (F.col("l_suppkey") % 3) * 10).alias("ex_start"),
        ((F.col("l_partkey") % 10) * 100 + 50 + (q % 2) * 20 + F.when(q % 11 == 0, 100).otherwise(0)).alias("ex_end"),
        (F.col("l_partkey") % 10).alias("bucket"),
        "l_suppkey", "l_quantity", "l_partkey", "l_linenumber",
    )
    by = Window.partitionBy("transcript_id", "bucket").orderBy("l_suppkey", "l_quantity", "l_partkey", "l_linenumber")
    return rows.withColumn("rn", F.row_number().over(by)).where("rn = 1").select("gene_id", "transcript_id", "sample_id", "ex_start", "ex_end")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, sample, contig, pos, flag, cigar, nm, xs: a read for each order, with a CIGAR string."""
    block = F.struct(F.col("ex_start").alias("s"), F.least("ex_end", F.floor(F.col("ex_start") / 100) * 100 + 90).alias("e"))
    rows = exons(spark, sf_dir).groupBy("transcript_id", "sample_id", "gene_id").agg(F.array_sort(F.collect_list(block)).alias("b"))  # an order has few items
    gap = lambda x, i: F.coalesce(F.concat((x["s"] - F.get("b", i - 1)["e"]).cast("string"), F.lit("N")), F.lit(""))
    steps = F.transform("b", lambda x, i: F.concat(gap(x, i), (x["e"] - x["s"]).cast("string"), F.lit("M")))
    k = F.col("transcript_id")
    return rows.select(
        k.alias("read_id"), F.col("sample_id").alias("sample"), (F.col("gene_id") % 4).alias("contig"), F.get("b", F.lit(0))["s"].cast("int").alias("pos"),
        F.when(k % 11 == 0, 4).when(k % 7 == 0, 256).otherwise(0).alias("flag"),
        F.concat(F.when(k % 5 == 0, "3S").otherwise(""), F.array_join(steps, "")).alias("cigar"),
        (k % 9).cast("int").alias("nm"), F.when(k % 3 == 0, "-").when(k % 3 == 1, "+").alias("xs"),
    )
