"""FASTA files as (contig, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record; the name ends at the first white space."""
    records = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    text = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(text, r"^(\S*)", 1)
    return records.select(head.alias("contig"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def pieces(seq: DataFrame, width: int = 1 << 16) -> DataFrame:
    """contig, piece, at, bases: each sequence in pieces of ``width`` bases, with the first one of the next piece."""
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(width))).alias("at")
    return seq.select("contig", cut, "seq").select("contig", (F.col("at") / width).cast("int").alias("piece"), "at", F.expr(f"substring(seq, at + 1, {width + 1})").alias("bases"))


def pairs_at(seq: DataFrame, spots: DataFrame, width: int = 1 << 16) -> DataFrame:
    """contig, pos, pair: the two bases from each distinct position (contig, pos) on; whole sequences meet nothing."""
    wanted = spots.select("contig", "pos").where("pos >= 0").distinct().withColumn("piece", F.floor(F.col("pos") / width).cast("int"))
    return wanted.join(pieces(seq, width), ["contig", "piece"]).select("contig", "pos", F.expr("upper(substring(bases, pos - at + 1, 2))").alias("pair"))
