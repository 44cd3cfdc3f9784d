"""Event writers: GFF3, BED and tables of text.

events: event_type, event_id, contig, strand, gene_id, annotated, exons1, exons2
(arrays of start and stop, isoform 1 the shorter).  Lines come in event order; the
number of events of one type bounds the one file that is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BED_CODES = {"exon_skip": "CA", "intron_retention": "IR", "alt_3prime": "AA", "alt_5prime": "AD"}
ICGC_CODES = {"intron_retention": "IR", "exon_skip": "ES", "mult_exon_skip": "MES", "alt_3prime": "A3", "alt_5prime": "A5", "mutex_exons": "MEX"}


def _id() -> Column:
    return F.concat_ws(".", "event_type", F.col("event_id").cast("string"))


def _bounds() -> tuple[Column, Column]:
    both = F.concat("exons1", "exons2")
    return F.array_min(F.transform(both, lambda x: x["start"])), F.array_max(F.transform(both, lambda x: x["stop"]))


def gff3(events: DataFrame) -> DataFrame:
    """event_id, line_no, value: a gene with two mRNAs for each event."""
    low, high = _bounds()
    row = lambda kind, s, e, tag: F.concat_ws("\t", "contig", "event_type", F.lit(kind), (s + 1).cast("string"), e.cast("string"), F.lit("."), "strand", F.lit("."), tag)
    novel = F.when(F.col("annotated") == 3, "N").otherwise("Y")

    def mrna(k: int) -> Column:
        exons = F.array_sort(f"exons{k}")
        name = F.concat(_id(), F.lit(f"_iso{k}"))
        start, stop = F.array_min(F.transform(exons, lambda x: x["start"])), F.array_max(F.transform(exons, lambda x: x["stop"]))
        head = row("mRNA", start, stop, F.concat(F.lit("ID="), name, F.lit(";Parent="), _id(), F.lit(';GeneName="'), "gene_id", F.lit('"')))
        parts = F.transform(exons, lambda x, i: row("exon", x["start"], x["stop"], F.concat(F.lit("Parent="), name)))
        return F.concat(F.array(head), parts)

    gene = row("gene", low, high, F.concat(F.lit("ID="), _id(), F.lit(';GeneName="'), "gene_id", F.lit('";HasNovelJunction="'), novel, F.lit('"')))
    return events.select("event_type", "event_id", F.posexplode(F.concat(F.array(gene), mrna(1), mrna(2))).alias("line_no", "value"))


def bed(events: DataFrame) -> DataFrame:
    """Twelve columns, three blocks; event types without a code give no line."""
    low, high = _bounds()
    code = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in BED_CODES.items()])
    longer = F.array_sort(F.array_distinct(F.concat("exons1", "exons2")))
    blocks = F.slice(longer, 1, 3)
    sizes = F.array_join(F.transform(blocks, lambda x: (x["stop"] - x["start"]).cast("string")), ",")
    starts = F.array_join(F.transform(blocks, lambda x: (x["start"] - low).cast("string")), ",")
    value = F.concat_ws("\t", "contig", low.cast("string"), high.cast("string"), F.concat_ws("-", code, "gene_id", F.col("event_id").cast("string")), F.lit("."), "strand", low.cast("string"), high.cast("string"), F.lit("."), F.size(blocks).cast("string"), sizes, starts)
    return events.where(code.isNotNull()).select("event_type", "event_id", F.lit(0).alias("line_no"), value.alias("value"))


def coordinates(events: DataFrame) -> DataFrame:
    """exon_pos (start-stop of the distinct exons, by start) and alt_usage (1: not in both isoforms)."""
    both = F.array_sort(F.array_distinct(F.concat("exons1", "exons2")))
    text = F.array_join(F.transform(both, lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), ":")
    usage = F.array_join(F.transform(both, lambda x: F.when(F.array_contains("exons1", x) & F.array_contains("exons2", x), "0").otherwise("1")), ":")
    return events.withColumn("exon_pos", text).withColumn("alt_usage", usage)


def wide(events: DataFrame, counts: DataFrame, features: list[str], samples: list[str]) -> DataFrame:
    """One row for each event with ``<sample>:<feature>`` columns; samples are given, so no pass finds them."""
    pivot = counts.groupBy("event_type", "event_id").pivot("sample", samples).agg(*[F.first(f).alias(f) for f in features])
    pivot = pivot.withColumnsRenamed({f"{s}_{f}": f"{s}:{f}" for s in samples for f in features} if len(features) > 1 else {s: f"{s}:{features[0]}" for s in samples})
    return coordinates(events).drop("exons1", "exons2").join(pivot, ["event_type", "event_id"], "left")


def tcga_psi(kind: str, min_reads: int = 10) -> Column:
    """The ratio of the third writer, which differs from :func:`junctura.operators.quant.psi`."""
    c = F.col
    ratio = lambda a, b, support: F.when(support >= min_reads, F.try_divide(a.cast("double"), b))
    skip = c("e1e2") + c("e2e3")
    return {
        "exon_skip": lambda: ratio(skip, skip + 2 * c("e1e3"), skip + c("e1e3")),
        "mult_exon_skip": lambda: ratio(skip + c("sum_e2"), skip + c("sum_e2") + (2 + c("num_e2")) * c("e1e3"), skip + c("sum_e2") + c("e1e3")),
        "mutex_exons": lambda: ratio(c("e1e2") + c("e1e3"), c("e1e2") + c("e2e4") + c("e1e3") + c("e3e4"), c("e1e2") + c("e2e4") + c("e1e3") + c("e3e4")),
        "alt_prime": lambda: ratio(c("e2"), c("e2") + c("e1e3"), c("e2") + c("e1e3")),
    }[kind]()


def _shown(events: DataFrame) -> tuple[Column, Column]:
    """The exons that the ICGC and TCGA files show, and the alternative region's (start, stop) pairs."""
    one, two = (lambda i: F.element_at("exons1", i)), (lambda i: F.element_at("exons2", i))
    kind, left = F.col("event_type"), F.element_at("exons1", 1) == F.element_at("exons2", 1)
    region = lambda a, b: F.array(F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("stop")))
    inner = F.slice("exons2", F.lit(2), F.greatest(F.size("exons2") - 2, F.lit(0)))
    shown = (
        F.when(kind == "intron_retention", F.col("exons1"))
        .when(kind.startswith("alt_") & left, F.array(one(1), one(-1), two(-1)))
        .when(kind.startswith("alt_"), F.array(one(-1), one(1), two(1)))
        .when(kind == "mutex_exons", F.array(one(1), one(2), two(2), one(-1)))
        .otherwise(F.col("exons2"))
    )
    part = (
        F.when(kind == "intron_retention", region(one(1)["stop"], one(-1)["start"]))
        .when(kind.startswith("alt_") & left, region(one(-1)["start"], two(-1)["start"]))
        .when(kind.startswith("alt_"), region(one(1)["stop"], two(1)["stop"]))
        .when(kind == "mutex_exons", F.array(one(2), two(2)))
        .otherwise(inner)
    )
    return shown, part


def _joined(exons: Column, within: str, between: str) -> Column:
    return F.array_join(F.transform(exons, lambda x: F.concat_ws(within, x["start"].cast("string"), x["stop"].cast("string"))), between)


def icgc(events: DataFrame, psi: DataFrame, samples: list[str]) -> DataFrame:
    """Id, type code, contig, annotated bits, coordinates, alternative region, gene and PSI (%.6f) of each sample.

    Events without any PSI are left out; the region of several exons begins with a colon."""
    code = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in ICGC_CODES.items()])
    pivot = psi.groupBy("event_type", "event_id").pivot("sample", samples).agg(F.first("psi"))
    table = events.join(pivot, ["event_type", "event_id"])
    some = F.coalesce(*[F.col(f"`{s}`") for s in samples]).isNotNull()
    shown, part = _shown(events)
    mark = F.when(F.col("event_type") == "mult_exon_skip", ":").otherwise("")
    values = [F.when(F.col(f"`{s}`").isNull(), "nan").otherwise(F.format_string("%.6f", F.col(f"`{s}`"))).alias(s) for s in samples]
    return table.where(some).select(
        _id().alias("event_id"), code.alias("event_type"), F.col("contig").alias("event_chr"), F.col("annotated").alias("is_annotated"), _joined(shown, ":", ":").alias("event_coordinates"),
        F.concat(mark, _joined(part, ":", ":")).alias("alt_region_coordinates"), F.col("gene_id").alias("gene_name"), *values, F.col("event_id").alias("number"),
    )


def tcga(kind: str, events: DataFrame, features: DataFrame, samples: list[str], min_reads: int = 10) -> DataFrame:
    """gene, eventtype, coordinates and each sample's ratio with one decimal, NA below ``min_reads``.

    ``features`` are the rows of :func:`junctura.operators.verify.evidence` of the pattern
    ``kind``; ratios are those of :func:`tcga_psi`."""
    shown, _ = _shown(events)
    ends = [F.element_at(shown, 1), F.element_at(shown, -1)]
    one = lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))
    inner = F.array_join(F.transform(F.slice(shown, F.lit(2), F.greatest(F.size(shown) - 2, F.lit(0))), lambda x: F.concat(F.lit(":"), one(x), F.lit(":"))), "")
    place = F.when(F.col("event_type") == "mult_exon_skip", F.concat(one(ends[0]), inner, F.lit(":"), one(ends[1]))).otherwise(_joined(shown, "-", ":"))
    head = events.select("event_type", "event_id", F.col("gene_id").alias("gene"), F.col("event_type").alias("eventtype"), F.concat(F.col("contig"), F.lit("::"), place).alias("coordinates"), (F.element_at("exons1", 2)["start"] - F.element_at("exons1", 1)["stop"] < F.element_at("exons2", 2)["start"] - F.element_at("exons2", 1)["stop"]).alias("__near"))
    if kind.startswith("alt"):
        support = F.col("e2") + F.col("e1e3")
        ratio = F.when(support >= min_reads, F.when(F.col("__near"), F.col("e2")).otherwise(F.col("e1e3")).cast("double") / support)
    elif kind == "intron_retention":
        ratio = F.when(F.col("e1e3") >= min_reads, F.col("e1e3").cast("double"))
    else:
        ratio = tcga_psi(kind, min_reads)
    rows = features.join(head.select("event_type", "event_id", "__near"), ["event_type", "event_id"]).withColumn("__r", F.coalesce(F.format_string("%1.1f", ratio), F.lit("NA")))
    rows = rows.withColumn("__r", F.when(ratio.isNull(), "NA").otherwise(F.col("__r")))
    pivot = rows.groupBy("event_type", "event_id").pivot("sample", samples).agg(F.first("__r"))
    out = head.join(pivot, ["event_type", "event_id"])
    return out.select("gene", "eventtype", "coordinates", *[F.coalesce(F.col(f"`{s}`"), F.lit("NA")).alias(s) for s in samples], F.col("event_id").alias("number"))


def structured(events: DataFrame, psi: DataFrame, samples: list[str]) -> DataFrame:
    """One attribute line an event: flanks, structure and splice chain, sites in transcript order.

    A donor is marked ^, an acceptor -.  On the plus strand an exon's end is its donor
    and its start (from 1) its acceptor; on the minus strand it is the other way round
    and sites are read from right to left.  Events of several skipped exons give no line."""
    plus = F.col("strand") == "+"
    exon = lambda k, i: F.element_at(f"exons{k}", i)
    end = lambda x: x["stop"].cast("string")
    start = lambda x: (x["start"] + 1).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    a, z, b = exon(1, 1), exon(1, -1), exon(2, 2)
    outer = F.when(plus, text(end(a), "^,", start(z), "-")).otherwise(text(start(z), "^,", end(a), "-"))
    inner = lambda x: F.when(plus, text(start(x), "-", end(x), "^")).otherwise(text(end(x), "-", start(x), "^"))
    y = exon(2, -1)
    first = exon(2, 1)
    left = a == first  # the alternative exons are the right ones
    near, far = F.least(z["start"], y["start"]) + 1, F.greatest(z["start"], y["start"]) + 1
    near_plus = F.least(z["start"] + 1, y["start"]) + 1  # as the format's writers count it
    low, high = F.least(a["stop"], first["stop"]), F.greatest(a["stop"], first["stop"])
    stop, begin = F.least(z["stop"], y["stop"]), F.greatest(a["start"], first["start"]) + 1
    whole = exon(2, 1)
    kinds = {
        "exon_skip": (outer, F.lit("0,1-2^"), text(",", inner(b))),
        "mutex_exons": (outer, F.lit("1-2^,3-4^"), text(inner(exon(1, 2)), ",", inner(b))),
        "intron_retention": (
            F.when(plus, text(whole["stop"] + 1, "-,", end(whole), "^")).otherwise(text(end(whole), "-,", start(whole), "^")),
            F.lit("0,1^2-"),
            F.when(plus, text(",", end(a), "^", start(z), "-")).otherwise(text(",", start(z), "^", end(a), "-")),
        ),
        "alt": (
            F.when(left & plus, text(end(a), "^,", stop, "^")).when(left, text(stop, "-,", end(a), "-")).when(plus, text(begin, "-,", start(z), "-")).otherwise(text(start(z), "^,", begin, "^")),
            F.when(left == plus, F.lit("1-,2-")).otherwise(F.lit("1^,2^")),
            F.when(left & plus, text(near_plus, "-,", far, "-")).when(left, text(far, "^,", near, "^")).when(plus, text(low, "^,", high, "^")).otherwise(text(high, "-,", low, "-")),
        ),
    }
    kind = F.when(F.col("event_type").startswith("alt_"), "alt").otherwise(F.col("event_type"))
    pick = lambda j: F.coalesce(*[F.when(kind == k, v[j]) for k, v in kinds.items()])
    by = psi.groupBy("event_type", "event_id").pivot("sample", samples).agg(F.first("psi"))
    rows = events.where(F.col("event_type") != "mult_exon_skip").join(by, ["event_type", "event_id"], "left")
    tags = F.concat_ws(";", *[text(f' psi_{s} "', F.when(F.col(f"`{s}`").isNull(), "nan").otherwise(F.format_string("%.6f", F.col(f"`{s}`"))), '"') for s in samples])
    head = F.concat_ws("\t", "contig", F.lit("undefined"), "event_type", a["start"].cast("string"), end(z), F.lit("."), "strand", F.lit("."))
    line = F.concat(head, text("\tgene_id \"", _id(), "\"; transcript_id \"", _id(), "\"; gene_name \"", F.col("gene_id"), "\"; is_annotated \"", F.col("annotated"), "\"; flanks \"", pick(0), "\"; structure \"", pick(1), "\"; splice_chain \"", pick(2), "\";", tags, ";"))
    return rows.select("event_type", "event_id", F.lit(0).alias("line_no"), line.alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Ordered text files: ranges of events, in the order of the files' names."""
    by = ["event_type", "event_id", "line_no"]
    lines.repartitionByRange(*by).sortWithinPartitions(*by).select("value").write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str, order: list[str], leave_out: list[str] = ()) -> None:
    """Ordered tables with a header in each file; ``leave_out`` are columns that only order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*leave_out).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
