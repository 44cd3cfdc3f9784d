"""Interval operators.  Intervals are half-open; every overlap join has an equality key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def coverage_runs(df: DataFrame, keys: list[str], start: str, end: str, weight: str | None = None) -> DataFrame:
    """Runs of equal depth above 0: keys, run_start, run_end, depth.

    Intervals become +w and -w at their ends; equal positions are summed before the
    shuffle, so no row stands for a base and a hot position costs one row a task."""
    w = F.col(weight) if weight else F.lit(1)
    ends = F.explode(F.array(F.struct(F.col(start).alias("pos"), w.cast("long").alias("d")), F.struct(F.col(end).alias("pos"), (-w).cast("long").alias("d"))))
    steps = df.where(F.col(end) > F.col(start)).select(*keys, ends.alias("x")).select(*keys, "x.pos", "x.d").groupBy(*keys, "pos").agg(F.sum("d").alias("d"))
    by = Window.partitionBy(*keys).orderBy("pos")
    runs = steps.select(*keys, F.col("pos").alias("run_start"), F.lead("pos").over(by).alias("run_end"), F.sum("d").over(by).alias("depth"))
    return runs.where((F.col("depth") > 0) & F.col("run_end").isNotNull())


def track_runs(df: DataFrame, keys: list[str], start: str, end: str, tracks: list[str]) -> DataFrame:
    """Runs of equal depth in all of several tracks at once: keys, run_start, run_end, and the depth in each track.

    ``tracks`` are columns with the weight of an interval in each; a run has depth in one of them at least."""
    up, down = ([F.col(t).cast("long").alias(t) for t in tracks], [(-F.col(t)).cast("long").alias(t) for t in tracks])
    ends = F.explode(F.array(F.struct(F.col(start).alias("pos"), *up), F.struct(F.col(end).alias("pos"), *down)))
    steps = df.where(F.col(end) > F.col(start)).select(*keys, ends.alias("x")).groupBy(*keys, F.col("x.pos").alias("pos")).agg(*[F.sum(f"x.{t}").alias(t) for t in tracks])
    by = Window.partitionBy(*keys).orderBy("pos")
    runs = steps.select(*keys, F.col("pos").alias("run_start"), F.lead("pos").over(by).alias("run_end"), *[F.sum(t).over(by).alias(t) for t in tracks])
    return runs.where((F.greatest(*tracks) if len(tracks) > 1 else F.col(tracks[0])) > 0).where("run_end IS NOT NULL")


def segments(vertices: DataFrame, keys: list[str], start: str = "v_start", end: str = "v_end") -> DataFrame:
    """Pieces between neighbouring ends that some interval covers: keys, seg_start, seg_end.

    A running sum of starts minus ends says where something is covered, so no join is needed."""
    points = F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d"))))
    steps = vertices.select(*keys, points.alias("x")).groupBy(*keys, F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d"))
    by = Window.partitionBy(*keys).orderBy("pos")
    out = steps.select(*keys, F.col("pos").alias("seg_start"), F.lead("pos").over(by).alias("seg_end"), F.sum("d").over(by).alias("open"))
    return out.where((F.col("open") > 0) & F.col("seg_end").isNotNull()).drop("open")


def bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))


def interval_join(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], width: int | None = None) -> DataFrame:
    """Pairs of overlapping rows with equal keys.

    With ``width``, both sides are dealt out by bins of that many bases, for keys as
    coarse as a contig; a pair is kept only in the first bin that both touch."""
    (s, e), (x, y) = a_range, b_range
    on = overlap(F.col(s), F.col(e), F.col(x), F.col(y))
    if width is None:
        return a.join(b, keys).where(on)
    a = a.withColumn("__bin", F.explode(bins(F.col(s), F.col(e), width)))
    b = b.withColumn("__bin", F.explode(bins(F.col(x), F.col(y), width)))
    first = F.col("__bin") == F.floor(F.greatest(F.col(s), F.col(x)) / width)
    return a.join(b, [*keys, "__bin"]).where(on & first).drop("__bin")


def segment_coverage(segs: DataFrame, runs: DataFrame, keys: list[str], per: list[str], width: int = 1 << 13) -> DataFrame:
    """Mean depth and covered bases of each segment, for each value of ``per`` that covers some of it.

    Both meet within bins of ``width`` bases, so a long gene costs its length, not the product of both sides."""
    part = F.least("seg_end", "run_end") - F.greatest("seg_start", "run_start")
    pairs = interval_join(segs, runs, keys, ("seg_start", "seg_end"), ("run_start", "run_end"), width)
    grouped = pairs.groupBy(*keys, *per, "seg_start", "seg_end").agg(F.sum(part * F.col("depth")).alias("area"), F.sum(part).cast("long").alias("covered"))
    return grouped.select(*keys, *per, "seg_start", "seg_end", (F.col("area") / (F.col("seg_end") - F.col("seg_start"))).alias("mean_cov"), "covered")


def nearest_before(points: DataFrame, marks: DataFrame, keys: list[str], point: str, mark: str) -> DataFrame:
    """For each distinct point the largest mark that is not above it (null: none), by one window over both."""
    both = points.select(*keys, F.col(point).alias("pos"), F.lit(1).alias("kind")).distinct().unionByName(marks.select(*keys, F.col(mark).alias("pos"), F.lit(0).alias("kind")).distinct())
    by = Window.partitionBy(*keys).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("before", F.max(F.when(F.col("kind") == 0, F.col("pos"))).over(by))
    return out.where("kind = 1").select(*keys, F.col("pos").alias(point), "before")


def max_depth(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    return coverage_runs(df, keys, start, end).groupBy(*keys).agg(F.max("depth").alias("max_depth"))
