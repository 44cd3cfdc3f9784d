"""Evidence for events: depth of regions, junction counts, criteria, PSI.

events have flat coordinate columns e1s, e1e, e2s, ... besides gene_id and event_id.
Evidence is sparse: an event has a row in a sample that has depth or reads for it.  In
all other samples it is the same, so counts of samples are completed by their number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.config import Evidence, Retention
from junctura.operators import intervals, quant


def _c(name: str) -> Column:
    return F.col(name)


def regions_of(kind: str) -> dict[str, tuple[Column, Column]]:
    """The named regions whose depth an event of this kind needs."""
    span = lambda n: (_c(f"e{n}s"), _c(f"e{n}e"))
    return {
        "exon_skip": lambda: {f"e{n}": span(n) for n in (1, 2, 3)},
        "intron_retention": lambda: {"e1": span(1), "e2": (_c("e1e"), _c("e2s")), "e3": span(2)},
        # the longer isoform's additional part is e2, what both have on its side e3 or e1
        "alt_right": lambda: {"e1": span(1), "e2": (F.least("e2s", "e3s"), F.greatest("e2s", "e3s")), "e3": (F.greatest("e2s", "e3s"), F.least("e2e", "e3e"))},
        "alt_left": lambda: {"e1": (F.greatest("e1s", "e2s"), F.least("e1e", "e2e")), "e2": (F.least("e1e", "e2e"), F.greatest("e1e", "e2e")), "e3": span(3)},
        "mutex_exons": lambda: {f"e{n}": span(n) for n in (1, 2, 3, 4)},
        "mult_exon_skip": lambda: {"e1": (_c("us"), _c("ue")), "e3": (_c("vs"), _c("ve"))},
    }[kind]()


def introns_of(kind: str) -> dict[str, tuple[Column, Column]]:
    """The named introns whose reads an event of this kind needs."""
    return {
        "exon_skip": lambda: {"e1e2": (_c("e1e"), _c("e2s")), "e2e3": (_c("e2e"), _c("e3s")), "e1e3": (_c("e1e"), _c("e3s"))},
        "intron_retention": lambda: {"e1e3": (_c("e1e"), _c("e2s"))},
        "alt_right": lambda: {"__a": (_c("e1e"), _c("e2s")), "__b": (_c("e1e"), _c("e3s"))},
        "alt_left": lambda: {"__a": (_c("e1e"), _c("e3s")), "__b": (_c("e2e"), _c("e3s"))},
        "mutex_exons": lambda: {"e1e2": (_c("e1e"), _c("e2s")), "e1e3": (_c("e1e"), _c("e3s")), "e2e4": (_c("e2e"), _c("e4s")), "e3e4": (_c("e3e"), _c("e4s"))},
        "mult_exon_skip": lambda: {"e1e2": (_c("ue"), F.element_at("inner", 1)["start"]), "e2e3": (F.element_at("inner", -1)["stop"], _c("vs")), "e1e3": (_c("ue"), _c("vs"))},
    }[kind]()


def _spans(named: dict[str, tuple[Column, Column]], more: Column | None = None) -> Column:
    each = F.array(*[F.struct(F.lit(n).alias("name"), s.cast("int").alias("s"), e.cast("int").alias("e")) for n, (s, e) in named.items()])
    return F.explode(each if more is None else F.concat(each, more)).alias("x")


def ids(events: DataFrame) -> list[str]:
    """The columns that tell events apart."""
    return ["gene_id", "event_id"] if "event_id" in events.columns else events.columns


def feature_names(kind: str) -> list[str]:
    names = [f"{r}_{x}" for r in regions_of(kind) for x in ("cov", "region")] + list(introns_of(kind))
    return [*names, "e2_cov", "sum_e2"] if kind == "mult_exon_skip" else names


def features(kind: str, events: DataFrame, runs: DataFrame | Callable[[DataFrame], DataFrame], junctions: DataFrame) -> DataFrame:
    """Ids, sample and the features that are not zero, of the events in the samples with any depth or reads for them.

    The distinct regions of all events meet the runs once, the introns meet the counts by
    equality, and one aggregation makes a row for an event in a sample."""
    key = ids(events)
    many = kind == "mult_exon_skip"
    inner = F.transform("inner", lambda x: F.struct(F.lit("x").alias("name"), x["start"].cast("int").alias("s"), x["stop"].cast("int").alias("e"))) if many else None
    following = F.slice("inner", 2, F.greatest(F.size("inner") - 1, F.lit(0))) if many else None
    steps = F.zip_with(F.slice("inner", 1, F.greatest(F.size("inner") - 1, F.lit(0))), following, lambda x, y: F.struct(F.lit("m").alias("name"), x["stop"].cast("int").alias("s"), y["start"].cast("int").alias("e"))) if many else None
    spans = events.select(*key, _spans(regions_of(kind), inner)).select(*key, "x.name", F.col("x.s").alias("seg_start"), F.col("x.e").alias("seg_end")).where("seg_end > seg_start")
    wanted = spans.select("gene_id", "seg_start", "seg_end").distinct()
    found = (runs(wanted) if callable(runs) else intervals.segment_coverage(wanted, runs, ["gene_id"], ["sample"])).select("gene_id", "sample", "seg_start", "seg_end", "mean_cov", "covered")
    size = F.col("seg_end") - F.col("seg_start")
    none = F.lit(None)
    depth = spans.join(found, ["gene_id", "seg_start", "seg_end"]).select(*key, "sample", "name", F.col("mean_cov").alias("cov"), (F.col("covered") / size).alias("region"), (F.col("mean_cov") * size).alias("area"), none.cast("long").alias("n"))
    gaps = events.select(*key, _spans(introns_of(kind), steps)).select(*key, "x.name", F.col("x.s").alias("i_start"), F.col("x.e").alias("i_end"))
    reads = junctions.select("gene_id", "sample", "i_start", "i_end", F.col("n").cast("long").alias("n"))
    counts = gaps.join(reads, ["gene_id", "i_start", "i_end"]).select(*key, "sample", "name", *[none.cast("double").alias(c) for c in ("cov", "region", "area")], "n")
    of = lambda name, value: F.when(F.col("name") == name, F.col(value))
    sums = [F.max(of(r, x)).alias(f"{r}_{x}") for r in regions_of(kind) for x in ("cov", "region")] + [F.max(of(i, "n")).alias(i) for i in introns_of(kind)]
    if many:
        sums += [F.sum(of("x", "area")).alias("area"), F.sum(of("m", "n")).alias("sum_e2")]
    out = depth.unionByName(counts).groupBy(*key, "sample").agg(*sums)
    if many:
        bases = F.aggregate("inner", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
        out = out.join(events.select(*key, bases.alias("bases")), key).withColumn("e2_cov", F.col("area") / F.col("bases")).drop("area", "bases")
    return out


def _with_known(kind: str, events: DataFrame, known: DataFrame | None) -> DataFrame:
    """``__known``: the names of the event's introns that are annotated."""
    if known is None:
        return events.withColumn("__known", F.array().cast("array<string>"))
    key = ids(events)
    gaps = events.select(*key, _spans(introns_of(kind))).select(*key, "x.name", F.col("x.s").alias("i_start"), F.col("x.e").alias("i_end"))
    own = known.select("gene_id", F.col("i_start").cast("int").alias("i_start"), F.col("i_end").cast("int").alias("i_end")).distinct()
    names = gaps.join(own, ["gene_id", "i_start", "i_end"]).groupBy(*key).agg(F.collect_set("name").alias("__known"))
    return events.join(names, key, "left").withColumn("__known", F.coalesce("__known", F.array().cast("array<string>")))


def judged(kind: str, rows: DataFrame, ev: Evidence, ir: Retention, min_reads: int) -> DataFrame:
    """Criteria v1, v2, ..., psi, iso1 and iso2 over the features; missing ones are zero."""
    zero = {c: F.coalesce(c, F.lit(0.0 if c.endswith(("_cov", "_region")) else 0)) for c in feature_names(kind)}
    rows = rows.withColumns(zero)
    flank = lambda a, b: (_c(f"{a}_cov") + _c(f"{b}_cov")) / 2

    def enough(*names: str, least: int = ev.junction) -> Column:
        return reduce(lambda a, b: a & b, [(_c(n) >= least) | F.array_contains("__known", n) for n in names])

    if kind == "exon_skip":
        criteria = [_c("e2_cov") >= ev.rel_cov * flank("e1", "e3"), enough("e1e2"), enough("e2e3"), enough("e1e3")]
    elif kind == "intron_retention":
        criteria = [(_c("e2_cov") > ir.min_cov) & (_c("e2_region") > ir.min_region) & (_c("e2_cov") >= ir.rel_low * flank("e1", "e3")), enough("e1e3")]
    elif kind in ("alt_right", "alt_left"):
        (s1, t1), _, (s3, t3) = regions_of(kind).values()
        size = t1 - s1, t3 - s3
        longer = F.when(_c("e2s") < _c("e3s") if kind == "alt_right" else _c("e1e") > _c("e2e"), _c("__a")).otherwise(_c("__b"))
        rows = rows.withColumn("e2", longer).withColumn("e1e3", _c("__a") + _c("__b") - _c("e2"))
        fixed = (_c("e1_cov") * size[0] + _c("e3_cov") * size[1]) / (size[0] + size[1])
        criteria = [_c("e2_cov") >= ev.rel_cov * fixed, enough("__a", "__b")]
    elif kind == "mutex_exons":
        level = ev.rel_cov * flank("e1", "e4")
        criteria = [_c("e2_cov") >= level, _c("e3_cov") >= level, enough("e1e2", "e2e4", least=ev.mutex_junction), enough("e1e3", "e3e4", least=ev.mutex_junction)]
    elif kind == "mult_exon_skip":
        rows = rows.withColumn("num_e2", F.size("inner"))
        criteria = [_c("e2_cov") >= ev.rel_cov * flank("e1", "e3"), enough("e1e2"), enough("e2e3"), _c("sum_e2") / _c("num_e2") >= ev.junction, enough("e1e3")]
    else:
        raise ValueError(kind)
    for i, c in enumerate(criteria, 1):
        rows = rows.withColumn(f"v{i}", c)
    a, b = quant.psi_terms("alt_prime" if kind.startswith("alt") else kind)
    return rows.drop("__known", "__a", "__b").withColumns({"psi": quant.psi(a, b, min_reads), "iso2": a.cast("int"), "iso1": b.cast("int")})


def sparse(kind: str, events: DataFrame, runs: DataFrame | Callable[[DataFrame], DataFrame], junctions: DataFrame, ev: Evidence = Evidence(), ir: Retention = Retention.preset(3), min_reads: int = 10, known: DataFrame | None = None) -> DataFrame:
    """Each event in each sample that has depth or reads for it: features, criteria, psi, iso1 and iso2.

    What the other samples have is :func:`without_reads`.  runs: gene_id, sample,
    run_start, run_end, depth, or what gives the depth of regions (see
    :func:`junctura.operators.quantify.from_segments`).  junctions: gene_id, sample, i_start, i_end, n.  With
    ``known`` introns (gene_id, i_start, i_end), an annotated junction needs no reads."""
    rows = _with_known(kind, events, known).join(features(kind, events, runs, junctions), ids(events))
    return judged(kind, rows, ev, ir, min_reads)


def without_reads(kind: str, events: DataFrame, ev: Evidence = Evidence(), ir: Retention = Retention.preset(3), min_reads: int = 10, known: DataFrame | None = None) -> DataFrame:
    """Each event as it is in a sample without depth and reads for it."""
    nothing = {c: F.lit(None).cast("double" if c.endswith(("_cov", "_region")) else "long") for c in feature_names(kind)}
    return judged(kind, _with_known(kind, events, known).withColumns(nothing), ev, ir, min_reads)


def completed(events: DataFrame, rows: DataFrame, zeros: DataFrame, samples: DataFrame | list[str]) -> DataFrame:
    """A row for each event in each sample, where a table of all is asked for: that of ``rows`` (sparse), else that of ``zeros``.

    ``samples`` are names, or a table of gene_id and sample where genes differ in theirs."""
    key = ids(events)
    values = [c for c in zeros.columns if c not in events.columns]
    kind = rows.select(F.struct(*values)).schema[0].dataType
    rest = zeros.select(*events.columns, F.struct(*values).cast(kind).alias("z"))
    wanted = rest.join(samples, "gene_id") if isinstance(samples, DataFrame) else rest.withColumn("sample", F.explode(F.lit(samples)))
    found = rows.select(*key, "sample", F.struct(*values).alias("r"))
    return wanted.join(found, [*key, "sample"], "left").select(*events.columns, "sample", F.coalesce("r", "z").alias("r")).select(*events.columns, "sample", "r.*")


def evidence(kind: str, events: DataFrame, samples: DataFrame, runs: DataFrame | Callable[[DataFrame], DataFrame], junctions: DataFrame, ev: Evidence = Evidence(), ir: Retention = Retention.preset(3), min_reads: int = 10, known: DataFrame | None = None) -> DataFrame:
    """:func:`sparse` with a row for each event in each sample (a column, or with gene_id)."""
    given = samples if "gene_id" in samples.columns else sorted(r["sample"] for r in samples.select("sample").distinct().collect())
    return completed(events, sparse(kind, events, runs, junctions, ev, ir, min_reads, known), without_reads(kind, events, ev, ir, min_reads, known), given)


def confirmed(events: DataFrame, rows: DataFrame, zeros: DataFrame, n_samples: int) -> DataFrame:
    """Samples that meet each criterion, and the least of them; those without a row count as in ``zeros``."""
    key = ids(events)
    criteria = [c for c in zeros.columns if c[0] == "v" and c[1:].isdigit()]
    seen = rows.groupBy(*key).agg(F.count("*").alias("seen"), *[F.sum(F.col(c).cast("long")).alias(f"n_{c}") for c in criteria])
    both = zeros.select(*key, *criteria).join(seen, key, "left")
    unseen = n_samples - F.coalesce("seen", F.lit(0))
    out = both.select(*key, *[(F.coalesce(f"n_{c}", F.lit(0)) + F.when(F.col(c), unseen).otherwise(0)).alias(f"n_{c}") for c in criteria])
    least = F.least(*[F.col(f"n_{c}") for c in criteria])
    return out.withColumn("confirmed", least)


def test_forms(kind: str) -> Column:
    """Both forms of an event as an array of (form, n): 0 skipping, 1 inclusion."""
    skip, keep = {
        "exon_skip": (_c("e1e3"), F.least("e1e2", "e2e3")),
        "intron_retention": (_c("e1e3"), _c("e2_cov")),
        "alt_right": (_c("e1e3"), _c("e2")),
        "alt_left": (_c("e1e3"), _c("e2")),
        "mutex_exons": (F.least("e1e2", "e2e4"), F.least("e1e3", "e3e4")),
        "mult_exon_skip": (_c("e1e3"), F.least("e1e2", "e2e3", "sum_e2")),
    }[kind]
    form = lambda k, n: F.struct(F.lit(k).alias("form"), F.floor(n).cast("double").alias("n"))
    return F.array(form(0, skip), form(1, keep))


def test_counts(kind: str, rows: DataFrame) -> DataFrame:
    """Long counts for testing: event_id, gene_id, form, sample, n."""
    return rows.select("event_id", "gene_id", "sample", F.explode(test_forms(kind)).alias("f")).select("event_id", "gene_id", "sample", "f.form", "f.n")


test_counts.__test__ = test_forms.__test__ = False
