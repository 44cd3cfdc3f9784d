"""Tables behind plots: ranges, coverage bins, segment means, diagnostics.  Drawing is left to the reader."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.functions import multiple_testing
from junctura.sources import placed

MAX_RANGE = 1_000_000


def plot_range(df: DataFrame, start: str, end: str, margin: float = 0.05) -> tuple[int, int]:
    """Bounds with 5 % (at least 10 bases) on either side; more than MAX_RANGE is an error."""
    low, high = df.agg(F.min(start), F.max(end)).collect()[0]
    pad = max(10, int((high - low) * margin))
    if high - low > MAX_RANGE:
        raise ValueError("the range is too long to plot")
    return max(0, low - pad), high + pad


def coverage_bins(runs: DataFrame, start: int, end: int, bins: int = 500, log: bool = False) -> DataFrame:
    """sample, bin, depth: mean depth of equal bins, from runs."""
    width = max(1, -(-(end - start) // bins))
    cut = runs.where((F.col("run_end") > start) & (F.col("run_start") < end)).withColumn("s", F.greatest("run_start", F.lit(start)) - start).withColumn("e", F.least("run_end", F.lit(end)) - start)
    each = cut.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))
    part = F.least("e", (F.col("bin") + 1) * width) - F.greatest("s", F.col("bin") * width)
    out = each.groupBy("sample", "bin").agg((F.sum(part * F.col("depth")) / width).alias("depth"))
    return out.withColumn("depth", F.log10(F.col("depth") + 1)) if log else out


def normalised(bins: DataFrame, size_factors: DataFrame) -> DataFrame:
    """``depth`` of each sample over its size factor (sample, sf); a sample without one stays as it is."""
    return bins.join(F.broadcast(size_factors.select("sample", "sf")), "sample", "left").withColumn("depth", F.col("depth") / F.coalesce("sf", F.lit(1.0))).drop("sf")  # a row a sample


def mean_coverage(bins: DataFrame, groups: DataFrame, n_bins: int) -> DataFrame:
    """group, bin, depth: the mean of a group's samples (sample, group); bins and samples without reads count as 0."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"))
    grid = sizes.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    sums = bins.join(F.broadcast(groups), "sample").groupBy("group", F.col("bin").cast("long").alias("bin")).agg(F.sum("depth").alias("s"))
    return grid.join(sums, ["group", "bin"], "left").select("group", "bin", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("depth"))


def heatmap(bins: DataFrame, samples: list[str], n_bins: int, log: bool = True) -> DataFrame:
    """sample, depths: a row of a picture for each sample, an array over the bins."""
    value = F.log10(F.col("depth") + 1) if log else F.col("depth")
    rows = bins.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("int").alias("b"), value.alias("v")))).alias("m"))
    every = bins.sparkSession.createDataFrame([(s,) for s in samples], "sample string").join(rows, "sample", "left")
    return every.select("sample", F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("depths"))


def some_samples(samples: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` of the samples, by the order of a hash with the seed: the same ones in every run."""
    return samples.orderBy(F.xxhash64("sample", F.lit(seed)), "sample").limit(n)


def event_rows(spark: SparkSession, root: str, event: str) -> tuple[DataFrame, tuple[int, int]]:
    """The evidence of one event ("exon_skip.3") in each sample with depth or reads for it, and the range to plot."""
    from junctura.plans.report import event_type

    kind, number = event.rsplit(".", 1)
    patterns = ("alt_right", "alt_left") if kind.startswith("alt_") else (kind,)
    found = None
    for pattern in patterns:
        here = (event_type(pattern) == kind) & (F.col("event_id") == int(number))
        own = spark.read.parquet(f"{root}/events/{pattern}").where(here)
        if found is None and not own.isEmpty():
            found, placed = spark.read.parquet(f"{root}/psi/{pattern}").where(here), own
    if found is None:
        raise ValueError(f"there is no event {event}")
    low, high = ("us", "ve") if kind == "mult_exon_skip" else ("e1s", f"e{4 if kind == 'mutex_exons' else 2 if kind == 'intron_retention' else 3}e")
    return found, plot_range(placed, low, high)


def top_tracks(spark: SparkSession, root: str, results: DataFrame, kind: str, k: int) -> list[tuple[str, tuple[int, int]]]:
    """The k events of a test with the smallest p and their ranges, for one plot each."""
    best = results.orderBy("p", "event_id").limit(k).select("event_id").collect()
    return [(f"{kind}.{r.event_id}", event_rows(spark, root, f"{kind}.{r.event_id}")[1]) for r in best]


def segment_means(depth: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean and standard error of each segment's depth in each group."""
    rows = depth.join(F.broadcast(groups), "sample")
    return rows.groupBy("gene_id", "seg_start", "seg_end", "group").agg(F.avg("mean_cov").alias("mean"), (F.stddev_samp("mean_cov") / F.sqrt(F.count("*"))).alias("sem"))


def mean_variance(counts: DataFrame, row: str, value: str) -> DataFrame:
    return counts.groupBy(row).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def qq(tests: DataFrame, p: str = "p") -> DataFrame:
    """-log10 of the expected and observed p-values; ranks are taken range by range of p."""
    ranked = multiple_testing.ranks(tests, p).select(p, "m", F.explode(F.sequence("first", "last")).alias("r"))
    return ranked.select((-F.log10(F.col("r") / (F.col("m") + 1))).alias("expected"), (-F.log10(F.col(p))).alias("observed"))


def histogram(counts: DataFrame, value: str, bins: int = 50) -> DataFrame:
    low, high = counts.agg(F.min(value), F.max(value)).collect()[0]
    if low is None or low == high:
        return counts.groupBy(F.lit(1).alias("bin")).agg(F.count(value).alias("n"))
    return counts.where(F.col(value).isNotNull()).groupBy(F.least(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def ma(means: DataFrame, a: str, b: str) -> DataFrame:
    """log mean and log fold change where both groups have reads."""
    return means.where((F.col(a) > 0) & (F.col(b) > 0)).withColumn("m", F.log2(a) - F.log2(b)).withColumn("a", (F.log2(a) + F.log2(b)) / 2)


def levels(intervals_df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``level``: the lowest line on which an interval overlaps none before it; a gene's exons are few."""
    import pandas as pd

    schema = intervals_df.withColumn("level", F.lit(0)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, end])
        free: list[int] = []
        out = []
        for s, e in zip(pdf[start], pdf[end]):
            k = next((i for i, x in enumerate(free) if x <= s), len(free))
            free[k : k + 1] = [e]
            out.append(k)
        return pdf.assign(level=out).astype({"level": "int32"})

    return intervals_df.groupBy(*keys).applyInPandas(run, schema)


STAGES = ("exons", "merged", "counts/segments", "counts/segment_depth", "counts/junctions", "expression")


def _write(spark: SparkSession, outdir: str, name: str, genes: DataFrame) -> dict[str, DataFrame]:
    """The stages' rows of some genes (gene_id), and their confirmed events, written below viz/<name>."""
    base, out = outdir.rstrip("/"), {}
    for stage in STAGES:
        out[stage] = spark.read.parquet(f"{base}/{stage}").join(F.broadcast(genes), "gene_id", "left_semi")
    for pattern in ("exon_skip", "intron_retention", "alt_right", "alt_left", "mutex_exons", "mult_exon_skip"):
        try:
            sure = spark.read.parquet(f"{base}/confirmed/{pattern}").where("confirmed >= 1")
        except AnalysisException:  # a pattern that was not looked for
            continue
        out[f"events/{pattern}"] = spark.read.parquet(f"{base}/events/{pattern}").join(F.broadcast(genes), "gene_id", "left_semi").join(sure.select("event_id", "gene_id"), ["event_id", "gene_id"], "left_semi")
    for stage, df in out.items():
        df.write.mode("overwrite").parquet(f"{base}/viz/{name}/{stage.replace('/', '_')}")
    return out


def gene_tables(spark: SparkSession, outdir: str, gene: str) -> dict[str, DataFrame]:
    """The stages' rows of one gene (its name up to the first point) and its confirmed events, written below viz/."""
    genes = spark.read.parquet(f"{outdir.rstrip('/')}/genes").where(F.substring_index("gene_id", ".", 1) == gene.split(".")[0]).select("gene_id")
    return _write(spark, outdir, gene, genes)


def range_tables(spark: SparkSession, outdir: str, place: str) -> dict[str, DataFrame]:
    """The same for the genes that overlap a range (contig:start-stop), with depth and introns of every sample in it.

    Depth and introns are read from the row groups of that range only."""
    contig, _, ends = place.rpartition(":")
    start, stop = map(int, ends.split("-"))
    if stop - start > MAX_RANGE:
        raise ValueError("the range is too long to plot")
    genes = spark.read.parquet(f"{outdir.rstrip('/')}/genes").where((F.col("contig") == contig) & (F.col("g_start") < stop) & (F.col("g_end") > start)).select("gene_id")
    read = lambda table: spark.read.parquet(f"{outdir.rstrip('/')}/prep/{table}").drop("contig_id")
    out = {
        "coverage": placed.window(read("tracks"), contig, start, stop, "run_start", "run_end").select("sample", "contig", F.greatest("run_start", F.lit(start)).alias("run_start"), F.least("run_end", F.lit(stop)).alias("run_end"), "depth"),
        "introns": placed.window(read("all_junctions"), contig, start, stop, "i_start", "i_end"),
    }
    name = place.replace(":", "_")
    for table, df in out.items():
        df.write.mode("overwrite").parquet(f"{outdir.rstrip('/')}/viz/{name}/{table}")
    return {**_write(spark, outdir, name, genes), **out}


def event_tables(spark: SparkSession, outdir: str, event: str) -> dict[str, DataFrame]:
    """The same for the gene of one event, with the event's evidence by sample."""
    rows, (low, high) = event_rows(spark, outdir, event)
    kind, number = event.rsplit(".", 1)
    out = {"evidence": rows, "range": spark.createDataFrame([(event, low, high)], "event string, low int, high int")}
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{outdir.rstrip('/')}/viz/{event}/{name}")
    return {**_write(spark, outdir, event, event_genes(spark, outdir, event)), **out}


def event_genes(spark: SparkSession, outdir: str, event: str) -> DataFrame:
    from junctura.plans.report import event_type

    kind, number = event.rsplit(".", 1)
    patterns = ("alt_right", "alt_left") if kind.startswith("alt_") else (kind,)
    own = [spark.read.parquet(f"{outdir.rstrip('/')}/events/{p}").where((event_type(p) == kind) & (F.col("event_id") == int(number))).select("gene_id") for p in patterns]
    return reduce(DataFrame.unionByName, own)


def top_tables(spark: SparkSession, outdir: str, confidence: int, kind: str, k: int) -> list[str]:
    """Tables of the ``k`` events with the smallest p in the written results of a test; their names."""
    results = spark.read.option("header", True).option("sep", "\t").csv(f"{outdir.rstrip('/')}/testing/test_results_C{confidence}_{kind}.tsv")
    p, number = F.col("p_val").cast("double"), F.substring_index("event_id", ".", -1).cast("long")
    names = [r.event_id for r in results.orderBy(p, number).limit(k).select("event_id").collect()]  # k rows
    for name in names:
        event_tables(spark, outdir, name)
    return names
