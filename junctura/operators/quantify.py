"""Quantification of events from the counted graph, without the depth runs.

A region of an event begins and ends where segments of its gene do, so it is a stretch of
segment numbers; its depth follows from the depth of those segments by equality joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(segs: DataFrame) -> DataFrame:
    """gene_id, seg_no, seg_start, seg_end: a gene's segments from left to right."""
    by = Window.partitionBy("gene_id").orderBy("seg_start")
    return segs.select("gene_id", F.row_number().over(by).alias("seg_no"), "seg_start", "seg_end")


def segment_index(regions: DataFrame, segs: DataFrame) -> DataFrame:
    """gene_id, seg_start, seg_end of each region and the numbers of its segments; ``segs`` as :func:`numbered`.

    Regions that do not begin and end with segments have none and are left out."""
    first = segs.select("gene_id", "seg_start", F.col("seg_no").alias("first"))
    last = segs.select("gene_id", "seg_end", F.col("seg_no").alias("last"))
    found = regions.select("gene_id", "seg_start", "seg_end").distinct().join(first, ["gene_id", "seg_start"]).join(last, ["gene_id", "seg_end"])
    return found.where("first <= last").select("gene_id", "seg_start", "seg_end", F.sequence("first", "last").alias("segments"))


def from_segments(segs: DataFrame, depth: DataFrame, per: str = "sample") -> Callable[[DataFrame], DataFrame]:
    """What gives regions (gene_id, seg_start, seg_end) their mean depth and covered bases in each sample.

    depth: gene_id, ``per``, seg_start, seg_end, mean_cov, covered of the counted graph."""
    own = numbered(segs)
    counted = depth.join(own, ["gene_id", "seg_start", "seg_end"]).select("gene_id", "seg_no", per, (F.col("mean_cov") * (F.col("seg_end") - F.col("seg_start"))).alias("area"), "covered")

    def of(regions: DataFrame) -> DataFrame:
        each = segment_index(regions, own).select("gene_id", "seg_start", "seg_end", F.explode("segments").alias("seg_no"))
        sums = each.join(counted, ["gene_id", "seg_no"]).groupBy("gene_id", per, "seg_start", "seg_end").agg(F.sum("area").alias("area"), F.sum("covered").alias("covered"))
        return sums.select("gene_id", per, "seg_start", "seg_end", (F.col("area") / (F.col("seg_end") - F.col("seg_start"))).alias("mean_cov"), "covered")

    return of
