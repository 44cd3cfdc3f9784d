"""Reports of a finished build: GFF3, BED, and tables with a column for each sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.config import Config
from junctura.operators import testing
from junctura.sources import sinks

# Patterns and the exons of their two isoforms.
ISOFORMS = {
    "exon_skip": (("e1", "e3"), ("e1", "e2", "e3")),
    "intron_retention": (("e1", "e2"), None),
    "alt_right": (("e1", "e2"), ("e1", "e3")),
    "alt_left": (("e1", "e3"), ("e2", "e3")),
    "mutex_exons": (("e1", "e2", "e4"), ("e1", "e3", "e4")),
}
FEATURES = {
    "exon_skip": ["e1_cov", "e2_cov", "e3_cov", "e1e2", "e2e3", "e1e3"],
    "intron_retention": ["e1_cov", "e2_cov", "e3_cov", "e2_region", "e1e3"],
    "alt_right": ["e1_cov", "e2_cov", "e3_cov", "e2", "e1e3"],
    "alt_left": ["e1_cov", "e2_cov", "e3_cov", "e2", "e1e3"],
    "mutex_exons": ["e1_cov", "e2_cov", "e3_cov", "e4_cov", "e1e2", "e1e3", "e2e4", "e3e4"],
    "mult_exon_skip": ["e1_cov", "e2_cov", "e3_cov", "e1e2", "e2e3", "sum_e2", "num_e2", "e1e3"],
}


def _exon(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("start"), e.cast("int").alias("stop"))


def _length(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0), lambda a, x: a + x["stop"] - x["start"])


def event_type(kind: str) -> Column:
    """alt_right is 3' on plus and 5' on minus, alt_left the other way round."""
    if kind not in ("alt_right", "alt_left"):
        return F.lit(kind)
    plus, minus = ("alt_3prime", "alt_5prime") if kind == "alt_right" else ("alt_5prime", "alt_3prime")
    return F.when(F.col("strand") == "+", plus).otherwise(minus)


def as_events(kind: str, df: DataFrame) -> DataFrame:
    """The writers' form: event_type, event_id, contig, strand, gene_id, annotated, exons1, exons2 with isoform 1 the shorter."""
    c = F.col
    if kind == "mult_exon_skip":
        ends = [F.array(_exon(c("us"), c("ue"))), F.array(_exon(c("vs"), c("ve")))]
        middle = F.transform("inner", lambda x: _exon(x["start"], x["stop"]))
        one, two = F.concat(*ends), F.concat(ends[0], middle, ends[1])
    else:
        pair = [None if names is None else F.array(*[_exon(c(f"{n}s"), c(f"{n}e")) for n in names]) for names in ISOFORMS[kind]]
        one, two = pair[0], F.array(_exon(c("e1s"), c("e2e"))) if pair[1] is None else pair[1]
    out = df.withColumn("__1", one).withColumn("__2", two)
    swap = _length(c("__1")) > _length(c("__2"))
    return out.select(
        event_type(kind).alias("event_type"), c("event_id").cast("int").alias("event_id"), "contig", "strand", "gene_id", "annotated",
        F.when(swap, c("__2")).otherwise(c("__1")).alias("exons1"), F.when(swap, c("__1")).otherwise(c("__2")).alias("exons2"),
    )


def write(spark: SparkSession, cfg: Config) -> None:
    """Reports of every pattern below ``cfg.root/reports``: all events, confirmed ones, tables by sample."""
    from junctura.plans.build import Build

    base = cfg.root
    samples = sorted(r["sample"] for r in spark.read.parquet(f"{base}/size_factors").select("sample").collect())
    for kind in cfg.patterns:
        found = spark.read.parquet(f"{base}/events/{kind}")
        good = spark.read.parquet(f"{base}/confirmed/{kind}").where("confirmed >= 1").select("event_id", "gene_id")
        every, sure = as_events(kind, found), as_events(kind, found.join(good, ["event_id", "gene_id"], "left_semi"))
        rows = Build(spark, cfg).all_samples(kind, found.join(good, ["event_id", "gene_id"], "left_semi"), samples)
        for name, events in (("all", every), ("confirmed", sure)):
            sinks.write_lines(sinks.gff3(events), f"{base}/reports/{kind}.{name}.gff3")
            sinks.write_lines(sinks.bed(events), f"{base}/reports/{kind}.{name}.bed")
        by = rows.withColumn("event_type", event_type(kind)).withColumn("event_id", F.col("event_id").cast("int"))
        if kind != "mult_exon_skip":
            sinks.write_lines(sinks.structured(sure, by, samples), f"{base}/reports/{kind}.struc")
        sinks.write_tsv(sinks.wide(sure, by, [*FEATURES[kind], "psi"], samples), f"{base}/reports/{kind}.tsv", ["event_type", "event_id"])
        sinks.write_tsv(sinks.icgc(sure, by, samples), f"{base}/reports/{kind}.icgc.tsv", ["event_type", "number"], ["number"])
        sinks.write_tsv(sinks.tcga(kind, sure, by, samples), f"{base}/reports/{kind}.tcga.tsv", ["eventtype", "number"], ["number"])


def test_table(spark: SparkSession, cfg: Config, results: DataFrame, kind: str) -> DataFrame:
    """The fifteen columns of the results of :meth:`Build.test`, and with them event_counts, gene_counts and the dispersions."""
    patterns = ("alt_right", "alt_left") if kind.startswith("alt_") else (kind,)
    events = [as_events(p, spark.read.parquet(f"{cfg.root}/events/{p}")).where(F.col("event_type") == kind) for p in patterns]
    placed = sinks.coordinates(reduce(DataFrame.unionByName, events)).select(F.col("event_id").cast("long").alias("event_id"), "gene_id", F.col("contig").alias("chrm"), "exon_pos", "alt_usage")
    names = spark.read.parquet(f"{cfg.root}/genes").select("gene_id", F.col("gene_symbol").alias("gene_name"))
    rows = results.join(placed, ["event_id", "gene_id"]).join(names, "gene_id", "left")
    a, b = cfg.label_a, cfg.label_b
    return rows.select(
        F.concat(F.lit(f"{kind}."), F.col("event_id").cast("string")).alias("event_id"), "chrm", "exon_pos", "alt_usage", "gene_id", "gene_name",
        F.col("p").alias("p_val"), F.col("p_adj").alias("p_val_adj"), F.col("dpsi").alias("dPSI"),
        F.col("mean_event_count_A").alias(f"mean_event_count_{a}"), F.col("mean_event_count_B").alias(f"mean_event_count_{b}"), "log2FC_event_count",
        F.col("mean_gene_exp_A").alias(f"mean_gene_exp_{a}"), F.col("mean_gene_exp_B").alias(f"mean_gene_exp_{b}"), "log2FC_gene_exp",
        "event_counts", "gene_counts", "disp_raw", "disp_adj", F.col("event_id").alias("number"),
    )


def write_test(spark: SparkSession, cfg: Config, results: DataFrame, kind: str, a: list[str], b: list[str]) -> None:
    """The results by p, the extended table with each sample's counts, and the first row of each gene."""
    base = f"{cfg.root}/testing/test_results_C{cfg.confidence}_{kind}"
    table = testing.cut(test_table(spark, cfg, results, kind))
    extra = ["event_counts", "gene_counts", "disp_raw", "disp_adj", "number"]
    short = table.drop(*extra[:-1])
    samples = [*sorted(a), *sorted(b)]
    each = [F.get(c, F.lit(i)).alias(f"{name}:{s}") for c, name in (("event_counts", "event_count"), ("gene_counts", "gene_exp")) for i, s in enumerate(samples)]
    sinks.write_tsv(short, f"{base}.tsv", ["p_val", "number"], ["number"])
    sinks.write_tsv(table.select(*[c for c in table.columns if c not in extra], *each, "disp_raw", "disp_adj", "number"), f"{base}.extended.tsv", ["p_val", "number"], ["number"])
    columns = [c for c in short.columns if c not in ("p_val", "number")]
    best = short.groupBy("gene_id").agg(F.min(F.struct("p_val", "number", *columns)).alias("b")).select("b.*").select(*short.columns)
    sinks.write_tsv(best, f"{base}.gene_unique.tsv", ["p_val", "number"], ["number"])
