"""Queries that work on all rows of their tables."""

from pyspark.sql import functions as F

from junctura.plans import catalogue


def test_all_transcripts(spark, sf):
    # each order with line items is a transcript
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct()
    genes = spark.read.parquet(f"{sf}/orders.parquet").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    want = {r.half: (r.n, r.genes) for r in genes.groupBy((F.col("o_orderkey") % 2).alias("half")).agg(F.count("*").alias("n"), F.countDistinct(F.col("o_custkey") % 1000).alias("genes")).collect()}
    got = {r.half: (r.transcripts, r.genes) for r in catalogue.QUERIES["transcript_counts_all"](spark, sf).collect()}
    assert got == want
