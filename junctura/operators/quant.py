"""Quantification: junction counts, expression, size factors, PSI and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.operators import graph


def junction_counts(exons: DataFrame) -> DataFrame:
    """sample_id, gene_id, i_start, i_end, n: how many transcripts or reads have the intron."""
    return graph.consecutive(exons, ["sample_id"]).groupBy("sample_id", "gene_id", F.col("ue").alias("i_start"), F.col("vs").alias("i_end")).agg(F.count("*").alias("n"))


def gene_expression(seg_cov: DataFrame, read_length: int = 50) -> DataFrame:
    """Sum of mean depth times length over the segments, in reads."""
    area = F.sum(F.col("mean_cov") * (F.col("seg_end") - F.col("seg_start")))
    return seg_cov.groupBy("gene_id", "sample_id").agg((area / read_length).alias("raw_count"))


def dense(counts: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Every row for every column, 0 where nothing was counted; columns are few (samples).

    A row's counts become a map once, from which it takes one for each column."""
    cols = counts.agg(F.sort_array(F.collect_set(col)).alias("c")).scalar()
    held = counts.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(col, value))).alias("__m"))
    each = held.select(row, "__m", F.explode(cols).alias(col))
    return each.select(row, col, F.coalesce(F.col("__m")[F.col(col)], F.lit(0.0)).alias(value))


def size_factors(counts: DataFrame, row: str = "gene_id", col: str = "sample_id", value: str = "raw_count") -> DataFrame:
    """Median over rows with a count of count / geometric mean, for each column.

    A row's mean of log(1 + x) is its sum over what was counted, divided by the number of
    columns; zeros add nothing, so they are never made."""
    n = counts.agg(F.count_distinct(col)).scalar()
    means = counts.groupBy(row).agg(F.sum(F.log1p(value)).alias("g")).select(row, F.exp(F.col("g") / n).alias("g"))
    return counts.where(F.col(value) > 0).join(means, row).groupBy(col).agg(F.percentile(F.col(value) / F.col("g"), F.lit(0.5)).alias("sf"))


def total_count_factors(counts: DataFrame, col: str = "sample_id", value: str = "raw_count") -> DataFrame:
    return counts.groupBy(col).agg((F.sum(value) / 1e8).alias("sf"))


def upper_quartile_factors(counts: DataFrame, row: str = "gene_id", col: str = "sample_id", value: str = "raw_count") -> DataFrame:
    """One more than the upper quartile over all rows, for each column; what was not counted is one zero with its frequency."""
    n = counts.agg(F.count_distinct(row)).scalar()
    seen = counts.groupBy(col).agg(F.count("*").alias("seen"))
    zeros = seen.select(col, F.lit(0.0).alias(value), (n - F.col("seen")).alias("times")).where("times > 0")
    both = counts.select(col, F.col(value).cast("double").alias(value), F.lit(1).cast("long").alias("times")).unionByName(zeros)
    return both.groupBy(col).agg((F.percentile(value, F.lit(0.75), F.col("times")) + 1).alias("sf"))


def with_junctions(events: DataFrame, counts: DataFrame, introns: dict[str, tuple[str, str]]) -> DataFrame:
    """Each event for each sample of its gene, with the counts of the named introns (0 if none)."""
    samples = counts.select("gene_id", "sample_id").distinct()
    out = events.join(samples, "gene_id")
    for name, (s, e) in introns.items():
        n = counts.select("gene_id", "sample_id", F.col("i_start").alias(s), F.col("i_end").alias(e), F.col("n").alias(name))
        out = out.join(n, ["gene_id", "sample_id", s, e], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def psi(a: Column, b: Column, min_reads: int) -> Column:
    """a / (a + b); null below ``min_reads``."""
    return F.when(a + b >= min_reads, F.try_divide(a.cast("double"), a + b))


def psi_terms(kind: str) -> tuple[Column, Column]:
    """(inclusion, exclusion) of an event type over its feature columns."""
    c = F.col
    return {
        "exon_skip": (F.least(c("e1e2"), c("e2e3")), c("e1e3")),
        "intron_retention": (c("e2_cov"), c("e1e3")),
        "alt_prime": (c("e2"), c("e1e3")),
        "mutex_exons": (c("e1e3") + c("e3e4"), c("e1e2") + c("e2e4")),
        "mult_exon_skip": (c("e1e2") + c("e2e3") + c("sum_e2"), (c("num_e2") + 1) * c("e1e3")),
    }[kind]


def confirmed(verified: DataFrame, keys: list[str], criteria: list[str]) -> DataFrame:
    """Samples that meet each criterion, and the least of them."""
    sums = [F.sum(F.col(c).cast("long")).alias(f"n_{c}") for c in criteria]
    out = verified.groupBy(*keys).agg(*sums)
    least = F.least(*[F.col(f"n_{c}") for c in criteria]) if len(criteria) > 1 else F.col(f"n_{criteria[0]}")
    return out.withColumn("confirmed", least)


def mean_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) / len(cols)
