"""The build: annotation and alignments to graphs, counts, events and PSI.

Stages are written below ``cfg.root``; one that is complete, and was made with the same
settings, is read, not made again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.config import Config
from junctura.functions import sequence
from junctura.operators import augment, events, graph, intervals, quant, reads, verify
from junctura.sources import alignments, annotation, fasta, placed

MAX_INTRONS, MAX_ROUNDS = 200, 12
MERGED = "merged"


class Build:
    def __init__(self, spark: SparkSession, cfg: Config):
        self.spark, self.cfg = spark, cfg

    def stage(self, name: str, make: Callable[[], DataFrame], **options: str) -> DataFrame:
        """The table ``name`` below ``cfg.root``; made anew unless it is complete and of the same settings and input files."""
        path = f"{self.cfg.root}/{name}"
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        done, told = (jvm.org.apache.hadoop.fs.Path(f"{path}/{f}") for f in ("_SUCCESS", f"_settings-{self.cfg.digest(name, self.stamps)}"))
        files = done.getFileSystem(conf)
        if not (files.exists(done) and files.exists(told)):
            make().write.mode("overwrite").options(**options).parquet(path)
            files.create(told, True).close()
        return self.spark.read.parquet(path)

    @cached_property
    def stamps(self) -> dict[str, str]:
        """Size and time of each input file (of a folder, of all files in it)."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        out = {}
        for name in filter(None, (self.cfg.annotation, self.cfg.reference, *self.cfg.samples)):
            p = jvm.org.apache.hadoop.fs.Path(name)
            files = p.getFileSystem(conf)
            status = files.listStatus(p) if files.exists(p) else []
            out[name] = " ".join(sorted(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()}" for x in status))
        return out

    # --- inputs ------------------------------------------------------------------

    def annotation(self) -> tuple[DataFrame, DataFrame]:
        cfg = self.cfg
        read = annotation.read_gff3 if cfg.annotation.endswith((".gff", ".gff3")) else annotation.read_gtf
        genes, exons = annotation.checked(*read(self.spark, cfg.annotation), cfg.drop_overlapping_genes, cfg.drop_shared_exons, cfg.drop_overlapping_exons)
        return self.stage("genes", lambda: genes), self.stage("exons", lambda: exons)

    def alignments(self) -> DataFrame:
        cfg = self.cfg
        by: dict[str, list[str]] = {}
        for s in cfg.samples:
            by.setdefault(s.rsplit(".", 1)[-1], []).append(s)
        parts = []
        if "bam" in by:
            parts.append(alignments.read_bam(self.spark, by.pop("bam")))
        if "parquet" in by:
            parts.append(self.spark.read.parquet(*by.pop("parquet")))
        parts += [alignments.read_sam(self.spark, path) for paths in by.values() for path in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def reads(self) -> DataFrame:
        """All alignments that count, before any filter."""
        return self.alignments().where((F.col("contig") != alignments.LEFT_OUT) & reads.passes(None, self.cfg.primary_only))

    def graph_rows(self, rows: DataFrame) -> DataFrame:
        """Reads by sample that graphs are built from: where samples are merged as reads, MERGED is all of them as one."""
        merge = self.cfg.merge
        if merge in ("merge_graphs", "single"):
            return rows
        one = rows.withColumn("sample", F.lit(MERGED))
        return one if merge == "merge_bams" else rows.unionByName(one)

    def graph_samples(self, prep: dict[str, DataFrame]) -> DataFrame:
        """The samples that have a graph of their own: in the mode single the first one."""
        own = sorted(r["sample"] for r in prep["all_coverage"].select("sample").distinct().collect())
        first = alignments.sample_of(self.cfg.samples[0])
        names = {"merge_graphs": own, "single": [first] if first in own else own[:1], "merge_bams": [MERGED], "merge_all": [*own, MERGED]}[self.cfg.merge]
        return self.spark.createDataFrame([(s,) for s in names], "sample string")

    def prepare(self) -> dict[str, DataFrame]:
        """The sparse summaries: junctions and coverage, filtered for graphs and full for counts.

        The alignments are read for two tables only, the cube of junctions and the depth in two tracks.
        Depth and junctions of all reads lie by contig and position, so windows of them are read alone."""
        cfg = self.cfg
        full = self.reads()
        strict = reads.passes(self.filter, cfg.primary_only, cfg.var_aware, not cfg.ignore_mismatches)
        cube = self.stage("prep/junction_cube", lambda: reads.junction_cube(full, self.filter, reads.mismatches(cfg.var_aware)))
        contigs = self.stage("prep/contigs", lambda: placed.contigs(self.spark, list(cfg.samples)))
        by_place = lambda df, start, *rest: placed.clustered(df, contigs, start, *rest)
        depth = self.stage("prep/tracks", lambda: by_place(reads.tracks(full, strict=strict, depth=F.lit(True)), "run_start", "run_end", "sample"), **placed.WRITE)
        introns = self.stage("prep/all_junctions", lambda: by_place(reads.all_junctions(cube), "i_start", "i_end", "sample"), **placed.WRITE).drop("contig_id")
        place = ["sample", "contig", "run_start", "run_end"]

        def graph_depth() -> DataFrame:
            own = depth.where("strict > 0").select(*place, F.col("strict").alias("depth"))
            if cfg.merge in ("merge_graphs", "single"):
                return own
            return intervals.coverage_runs(self.graph_rows(own), ["sample", "contig"], "run_start", "run_end", "depth")

        return {
            "cube": cube,
            "junctions": self.stage("prep/junctions", lambda: self.filtered(cube, self.filter)),
            "coverage": self.stage("prep/coverage", graph_depth),
            "all_junctions": introns,
            "regions": self.stage("prep/regions", lambda: placed.region_summary(introns, contigs)),
            "all_coverage": depth.select(*place, "depth"),
        }

    @property
    def filter(self) -> reads.ReadFilter:
        return reads.ReadFilter.preset(self.cfg.confidence, self.cfg.read_length)

    def filtered(self, cube: DataFrame, given: reads.ReadFilter) -> DataFrame:
        return reads.cube_junctions(self.graph_rows(cube), given, not self.cfg.ignore_mismatches)

    # --- graph --------------------------------------------------------------------

    def introns(self, genes: DataFrame, prep: dict[str, DataFrame]) -> DataFrame:
        """The introns of each gene in each sample.

        Genes with more than MAX_INTRONS in a sample get a tighter filter, round by round;
        the others keep theirs.  Every round is a sum over the cube of junctions."""
        given = self.filter
        found = self.stage("prep/introns-0", lambda: self._introns(genes, prep["junctions"], given))
        for k in range(1, MAX_ROUNDS):
            many = found.groupBy("sample", "gene_id").agg(F.count("*").alias("n")).where(F.col("n") > MAX_INTRONS).select("gene_id").distinct()
            if many.isEmpty():
                break
            given = given.tightened()
            again = self._introns(genes.join(many, "gene_id", "left_semi"), self.filtered(prep["cube"], given), given)
            last = found.join(many, "gene_id", "left_anti").unionByName(again)
            found = self.stage(f"prep/introns-{k}", lambda last=last: last)
        return found

    def _introns(self, genes: DataFrame, junctions: DataFrame, given: reads.ReadFilter) -> DataFrame:
        cfg = self.cfg
        if cfg.filter_consensus:
            first, last = F.col("i_start").alias("pos"), (F.col("i_end") - 2).alias("pos")
            spots = junctions.select("contig", first).unionByName(junctions.select("contig", last))
            pairs = fasta.pairs_at(fasta.read_fasta(self.spark, cfg.reference), spots)
            left, right = (pairs.select("contig", F.col("pos").alias(f"__{n}"), F.col("pair").alias(f"__{n}_pair")) for n in ("l", "r"))
            placed = junctions.withColumns({"__l": F.col("i_start"), "__r": F.col("i_end") - 2}).join(left, ["contig", "__l"]).join(right, ["contig", "__r"])
            junctions = placed.where(sequence.consensus_pairs(F.col("__l_pair"), F.col("__r_pair"), F.col("strand"), cfg.filter_consensus)).drop("__l", "__r", "__l_pair", "__r_pair")
        if cfg.filter_ambiguous:
            placed = genes.select(F.concat_ws(" ", "contig", "strand").alias("contig"), "g_start", "g_end")
            marked = junctions.withColumn("__c", F.concat_ws(" ", "contig", "strand"))
            clear = graph.unambiguous(marked.select(F.col("__c").alias("contig"), "i_start", "i_end"), placed, 200, 1 << 16)
            junctions = marked.join(clear.withColumnRenamed("contig", "__c"), ["__c", "i_start", "i_end"], "left_semi").drop("__c")
        return reads.gene_introns(junctions, genes, given.mincount).select("sample", "gene_id", "i_start", "i_end", "n")

    def graph(self, genes: DataFrame, exons: DataFrame, prep: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(vertices, edges with n_samples) of the merged graph."""
        cfg = self.cfg
        v, e = graph.vertices(exons), graph.edges(exons)
        samples = self.graph_samples(prep)

        def make() -> DataFrame:
            wanted = F.broadcast(samples)  # a row a sample
            introns = self.introns(genes, prep).select("sample", "gene_id", "i_start", "i_end").join(wanted, "sample", "left_semi")
            runs = gene_runs(prep["coverage"].join(wanted, "sample", "left_semi"), genes, 5000)
            return augment.augmented(v, e, introns, runs, augment.neighbour_ends(genes, v), cfg)

        each = self.stage("graphs", make)
        merged = self.stage("merged", lambda: augment.merged(each, augment.untouched(v, e, cfg), [r["sample"] for r in samples.collect()]))
        return merged_parts(merged, cfg)

    # --- counts --------------------------------------------------------------------

    def counts(self, genes: DataFrame, vertices: DataFrame, edges: DataFrame, prep: dict[str, DataFrame]) -> dict[str, DataFrame]:
        kept = {"runs": "counts/runs", "junctions": "counts/junctions", "depth": "counts/segment_depth", "expression": "expression"}
        segs = self.stage("counts/segments", lambda: graph.segments(vertices))
        out = count_tables(genes, vertices, edges, segs, prep["all_coverage"], prep["all_junctions"], self.cfg.read_length, lambda name, df: self.stage(kept[name], lambda: df))
        factors = self.stage("size_factors", lambda: quant.size_factors(out["expression"], "gene_id", "sample", "raw_count"))
        return {**out, "segments": segs, "size_factors": factors}

    # --- events ---------------------------------------------------------------------

    def detect(self, genes: DataFrame, exons: DataFrame, vertices: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
        """Events of the wanted types by pattern; alt_right is 3' on plus and 5' on minus, alt_left the reverse.

        Events are made unique and numbered within their type; alternative ends are
        trimmed after that, so that dropped events leave their numbers unused."""
        cfg = self.cfg
        alt = graph.label_alt_full(vertices, edges).where("is_alt").select("gene_id")
        few = events.small_genes(edges.select(*graph.EDGE), vertices, cfg.edge_limit).join(alt, "gene_id", "left_semi")
        known = graph.introns(exons)
        place = genes.select("gene_id", "contig", "strand")
        flags = {
            "exon_skip": ([("e1e", "e3s")], [("e1e", "e2s"), ("e2e", "e3s")]),
            "intron_retention": ([("e1e", "e2s")], []),
            "alt_right": ([("e1e", "e2s")], [("e1e", "e3s")]),
            "alt_left": ([("e1e", "e3s")], [("e2e", "e3s")]),
            "mutex_exons": ([("e1e", "e2s"), ("e2e", "e4s")], [("e1e", "e3s"), ("e3e", "e4s")]),
        }
        inner = {
            "exon_skip": ["e1e", "e2s", "e2e", "e3s"],
            "intron_retention": ["e1e", "e2s"],
            "alt_right": ["e1e", "e2s", "e3s"],
            "alt_left": ["e1e", "e2e", "e3s"],
            "mutex_exons": ["e1e", "e2s", "e2e", "e3s", "e3e", "e4s"],
        }
        make = {
            "exon_skip": lambda: events.exon_skip(few),
            "intron_retention": lambda: events.intron_retention(few, vertices),
            "alt_right": lambda: events.alt_right(few),
            "alt_left": lambda: events.alt_left(few),
            "mutex_exons": lambda: events.mutex_exons(few),
        }
        # of each pattern the whole span; of alternative right ends it ends with the longer exon
        span = {"exon_skip": (F.col("e1s"), F.col("e3e")), "intron_retention": (F.col("e1s"), F.col("e2e")), "mutex_exons": (F.col("e1s"), F.col("e4e"))}
        span |= {"alt_right": (F.col("e1s"), F.greatest("e2e", "e3e")), "alt_left": (F.least("e1s", "e2s"), F.col("e3e"))}

        def unique(kind: str) -> DataFrame:
            df = make[kind]().join(place, "gene_id")
            positive = F.least(*[F.col(c) for c in df.columns if c[0] == "e" and c[1].isdigit()]) > 0
            low, high = span[kind]
            df = df.where(positive).withColumn("__low", low).withColumn("__high", high)
            rest = [c for c in df.columns if c[0] == "e" and c[1].isdigit() and c not in inner[kind]]
            one = events.deduplicated(df, ["contig", "strand"], inner[kind], ("__low", "__high"), [*rest, "gene_id"]).drop("__low", "__high")
            return events.annotated(one, known, *flags[kind])

        out = {}
        for kind in ("exon_skip", "intron_retention", "mutex_exons"):
            if kind in cfg.event_types:
                out[kind] = self.stage(f"events/{kind}", lambda kind=kind: events.numbered(unique(kind), ["contig", "strand", *inner[kind], "gene_id"], 2))
        if "alt_right" in cfg.patterns:
            curate = {"alt_right": events.curate_alt, "alt_left": events.curate_alt_left}
            plus = {"alt_right": "alt_3prime", "alt_left": "alt_5prime"}

            def both() -> DataFrame:
                """The alternative ends of both patterns, numbered within their type: on one strand a type has one pattern."""
                parts = []
                for kind in ("alt_right", "alt_left"):
                    type_of = F.when((F.col("strand") == "-") == (plus[kind] == "alt_3prime"), "alt_5prime").otherwise("alt_3prime")
                    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(inner[kind])]
                    parts.append(unique(kind).select("*", F.lit(kind).alias("pattern"), type_of.alias("type"), *keys))
                rows = parts[0].unionByName(parts[1])
                order = ["contig", "strand", "k0", "k1", "k2", "gene_id"]
                each = [events.numbered(rows.where(F.col("type") == t), order, 2) for t in sorted(cfg.event_types) if t.startswith("alt_")]
                return reduce(DataFrame.unionByName, each).drop("k0", "k1", "k2", "type")

            ends = self.stage("events/alternative_ends", both)
            for kind in ("alt_right", "alt_left"):
                out[kind] = self.stage(f"events/{kind}", lambda kind=kind: curate[kind](ends.where(F.col("pattern") == kind).drop("pattern")))
        if "mult_exon_skip" in cfg.event_types:

            def paths() -> DataFrame:
                named = events.mult_exon_skip(few, cfg.edge_limit)
                named = named.select("gene_id", *[F.col(c).cast("int").alias(c) for c in ("us", "ue", "vs", "ve")], "inner").where("us > 0").join(place, "gene_id")
                one = events.deduplicated(events.path_inner(named), ["contig", "strand"], ["inner_coords"], ("us", "ve"), ["us", "ve", "ue", "vs", "gene_id"])
                return events.numbered(events.annotated_paths(one, known), ["contig", "strand", "inner_coords", "gene_id"], 2).drop("inner_coords")

            out["mult_exon_skip"] = self.stage("events/mult_exon_skip", paths)
        return out

    def _judging(self) -> dict:
        """What evidence is judged by."""
        cfg = self.cfg
        known = graph.introns(self.spark.read.parquet(f"{cfg.root}/exons")) if cfg.use_annotated_support else None
        return {"ev": cfg.evidence, "ir": cfg.retention, "min_reads": cfg.psi_min_reads, "known": known}

    def analyze(self, found: dict[str, DataFrame], counts: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, DataFrame]]:
        """For each pattern (features, criteria and PSI by sample with depth or reads; confirmed samples by event)."""
        out, how = {}, self._judging()
        n_samples = counts["runs"].select("sample").distinct().count()
        for kind, df in found.items():
            rows = self.stage(f"psi/{kind}", lambda df=df, kind=kind: verify.sparse(kind, df, counts["runs"], counts["junctions"], **how))
            out[kind] = rows, self.stage(f"confirmed/{kind}", lambda df=df, rows=rows, kind=kind: verify.confirmed(df, rows, verify.without_reads(kind, df, **how), n_samples))
        return out

    def all_samples(self, kind: str, events: DataFrame, samples: list[str]) -> DataFrame:
        """The evidence of some events of a finished build in each of the samples, zeros where it has no row."""
        return verify.completed(events, self.spark.read.parquet(f"{self.cfg.root}/psi/{kind}"), verify.without_reads(kind, events, **self._judging()), samples)

    def run(self, collected: bool = False) -> dict[str, tuple[DataFrame, DataFrame]]:
        """The whole build; ``collected``: with the counts that :class:`SampleCounts` has of the samples, none is made anew."""
        genes, exons = self.annotation()
        if collected:
            store = SampleCounts(self.spark, self.cfg)
            vertices, edges = store.graph()
            counts = store.collect()
        else:
            prep = self.prepare()
            vertices, edges = self.graph(genes, exons, prep)
            counts = self.counts(genes, vertices, edges, prep)
        return self.analyze(self.detect(genes, exons, vertices, edges), counts)

    def test(self, kind: str, a: list[str], b: list[str]) -> DataFrame:
        """Differential test of one event type between two groups of samples, on the results of :meth:`run`.

        A row for each confirmed event that has enough reads in a form: event_id, p,
        p_adj, dpsi, the means of the reported form's counts and of the gene's expression
        over their size factors in either group, log2 fold changes, the counts of each
        sample, and both dispersions.  Events whose PSI hardly differs are not tested: p = 1."""
        from junctura.functions import multiple_testing
        from junctura.operators import testing
        from junctura.plans.report import event_type

        cfg = self.cfg
        read = lambda name: self.spark.read.parquet(f"{cfg.root}/{name}")
        groups = self.spark.createDataFrame([(s, True) for s in a] + [(s, False) for s in b], "sample string, in_a boolean")

        def confirmed(pattern: str) -> DataFrame:
            sure = read(f"confirmed/{pattern}").where("confirmed >= 1").select("event_id", "gene_id")
            sure = read(f"events/{pattern}").where(event_type(pattern) == kind).join(sure, ["event_id", "gene_id"], "left_semi")
            own = self.all_samples(pattern, sure, sorted([*a, *b])).join(F.broadcast(groups), "sample")
            return own.select("event_id", "gene_id", "sample", "in_a", "psi", verify.test_forms(pattern).alias("forms"))

        patterns = ("alt_right", "alt_left") if kind.startswith("alt_") else (kind,)
        rows = reduce(DataFrame.unionByName, map(confirmed, patterns))
        gene_sf = read("size_factors")
        expression = read("expression").join(F.broadcast(groups), "sample").join(F.broadcast(gene_sf), "sample")
        if cfg.cap_expression:
            expression = testing.cap_outliers(expression, "gene_id", "raw_count", "sf", 1.5).drop("raw_count").withColumnRenamed("capped", "raw_count")
        counts = rows.select("event_id", "gene_id", "sample", F.explode("forms").alias("f")).select("event_id", "gene_id", "sample", "f.form", "f.n")
        if cfg.cap_counts:
            row = counts.withColumn("row", F.struct("event_id", "form"))
            counts = testing.cap_outliers(row, "row", "n", None, 3.0).drop("n", "row").withColumnRenamed("capped", "n")
        counts = testing.cut(counts)
        event_sf = quant.size_factors(counts.withColumn("row", F.struct("event_id", "form")).select("row", "sample", "n"), "row", "sample", "n")
        low = lambda in_a: F.avg(F.when(F.col("in_a") == in_a, (F.col("n") <= 1).cast("int")))
        form_ok = counts.join(F.broadcast(groups), "sample").groupBy("event_id", "form").agg(low(True).alias("za"), low(False).alias("zb")).where((F.col("za") <= cfg.max_zero) | (F.col("zb") <= cfg.max_zero))
        mean = lambda in_a: F.avg(F.when(F.col("in_a") == in_a, F.col("psi")))
        dpsi = rows.groupBy("event_id", "gene_id").agg(F.coalesce(mean(True) - mean(False), F.lit(0.0)).alias("dpsi")).join(form_ok.select("event_id").distinct(), "event_id", "left_semi")
        ids = lambda df: df.withColumnRenamed("sample", "sample_id")
        packed = testing.response(ids(counts.join(dpsi.select("event_id"), "event_id", "left_semi")), ids(expression.select("gene_id", "sample", "raw_count")), ids(event_sf), ids(gene_sf), ids(groups))
        wanted = packed.join(dpsi.where(F.abs("dpsi") >= cfg.min_dpsi).select("event_id"), "event_id", "left_semi").join(form_ok.select("event_id", "form"), ["event_id", "form"], "left_semi")
        tested = testing.differential(wanted, cfg.min_count, cfg.max_zero)
        all_events = dpsi.join(tested.drop("gene_id"), "event_id", "left").withColumn("form", F.coalesce("form", F.lit(0))).withColumn("p", F.coalesce("p", F.lit(1.0)))
        adjusted = multiple_testing.adjust(testing.cut(all_events), "p", cfg.correction)
        return adjusted.join(testing.means(packed), ["event_id", "gene_id", "form"])


def merged_parts(merged: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges with n_samples) of the merged graph, validated if that is wanted."""
    vertices = merged.where("vs IS NULL").select("gene_id", F.col("us").alias("v_start"), F.col("ue").alias("v_end"))
    edges = merged.where("vs IS NOT NULL")
    if cfg.validate:
        kept = graph.validated(edges, cfg.support)
        vertices, edges = graph.validated_vertices(vertices, edges, kept), kept
    return vertices, edges


def count_tables(genes: DataFrame, vertices: DataFrame, edges: DataFrame, segs: DataFrame, coverage: DataFrame, junctions: DataFrame, read_length: int, keep: Callable[[str, DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """Depth runs, junctions, segment depth and expression of the merged graph in the given samples; ``keep`` writes a table and reads it again."""
    bounds = vertices.groupBy("gene_id").agg(F.min("v_start").alias("g_start"), F.max("v_end").alias("g_end")).join(genes.select("gene_id", "contig", "strand"), "gene_id")
    runs = keep("runs", gene_runs(coverage, bounds, 0))
    near = intervals.interval_join(junctions, bounds, ["contig"], ("i_start", "i_end"), ("g_start", "g_end"), 1 << 16)
    own = keep("junctions", near.where("xs = '.' OR xs = strand").groupBy("gene_id", "sample", "i_start", "i_end").agg(F.sum("n").alias("n")))
    cov = keep("depth", intervals.segment_coverage(segs, runs, ["gene_id"], ["sample"]))
    area = F.sum(F.col("mean_cov") * (F.col("seg_end") - F.col("seg_start"))) / read_length
    alone = graph.single_cover(segs, graph.segment_edges(edges, segs))
    raw = cov.groupBy("gene_id", "sample").agg(area.alias("raw_count"))
    flat = cov.join(alone, ["gene_id", "seg_start", "seg_end"], "left_semi").groupBy("gene_id", "sample").agg(area.alias("raw_count_non_alt"))
    return {"runs": runs, "junctions": own, "depth": cov, "expression": keep("expression", raw.join(flat, ["gene_id", "sample"], "left"))}


class SampleCounts:
    """Counts over the merged graph of a finished build, one partition a sample below ``by_sample``.

    Samples are added one or some at a time, later ones too; only their own partitions are
    written.  A mark for each sample names the graph that it was counted over and comes
    after its tables, so a sample whose job was lost is simply not there."""

    def __init__(self, spark: SparkSession, cfg: Config):
        self.spark, self.cfg, self.base = spark, cfg, f"{cfg.root}/by_sample"

    def _files(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(conf)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return merged_parts(self.spark.read.parquet(f"{self.cfg.root}/merged"), self.cfg)

    def version(self) -> str:
        """What tells graphs apart: the settings that the merged one was made with."""
        p, files = self._files(f"{self.cfg.root}/merged")
        names = sorted(x.getPath().getName() for x in files.listStatus(p) if x.getPath().getName().startswith("_settings-")) if files.exists(p) else []
        if not names:
            raise ValueError("there is no merged graph to count over")
        return f"{hashlib.sha256(' '.join(names).encode()).hexdigest()[:16]}{'-validated' if self.cfg.validate else ''}"

    def _mark(self, sample: str) -> str:
        return f"{self.base}/_counted/{sample}-{self.version()}"

    def add(self, paths: list[str]) -> None:
        """Count the samples of some alignment files; a sample that is there is counted anew."""
        job = Build(self.spark, replace(self.cfg, samples=tuple(paths)))
        vertices, edges = self.graph()
        genes, full = self.spark.read.parquet(f"{self.cfg.root}/genes"), job.reads()
        names = sorted({alignments.sample_of(p) for p in paths})
        for name in names:
            p, files = self._files(self._mark(name))
            files.delete(p, False)

        def keep(table: str, df: DataFrame) -> DataFrame:
            path = f"{self.base}/{table}"
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path).where(F.col("sample").isin(names))

        segs = graph.segments(vertices)
        count_tables(genes, vertices, edges, segs, reads.tracks(full, depth=F.lit(True)), reads.all_junctions(reads.junction_cube(full, job.filter, F.lit(0))), self.cfg.read_length, keep)
        for name in names:
            p, files = self._files(self._mark(name))
            files.create(p, True).close()

    def collect(self) -> dict[str, DataFrame]:
        """The tables of all samples of the settings, nothing counted anew; samples that were not counted over this graph are an error."""
        names = sorted({alignments.sample_of(p) for p in self.cfg.samples})
        missing = []
        for name in names:
            p, files = self._files(self._mark(name))
            if not files.exists(p):
                missing.append(name)
        if missing:
            raise ValueError(f"not counted over this graph: {', '.join(missing)}")
        out = {t: self.spark.read.option("mergeSchema", "false").schema(COUNTS[t]).parquet(f"{self.base}/{t}").where(F.col("sample").isin(names)) for t in COUNTS}
        return {**out, "segments": graph.segments(self.graph()[0]), "size_factors": quant.size_factors(out["expression"], "gene_id", "sample", "raw_count")}


# The tables of :class:`SampleCounts`; a sample's name stays a text, whatever it looks like.
COUNTS = {
    "runs": "gene_id string, run_start int, run_end int, depth int, sample string",
    "junctions": "gene_id string, i_start int, i_end int, n long, sample string",
    "depth": "gene_id string, seg_start int, seg_end int, mean_cov double, covered long, sample string",
    "expression": "gene_id string, raw_count double, raw_count_non_alt double, sample string",
}


def gene_runs(coverage: DataFrame, genes: DataFrame, pad: int) -> DataFrame:
    """gene_id, sample, run_start, run_end, depth: the contig's runs, cut to each gene."""
    wide = genes.select("gene_id", "contig", (F.col("g_start") - pad).alias("__s"), (F.col("g_end") + pad).alias("__e"))
    pairs = intervals.interval_join(coverage, wide, ["contig"], ("run_start", "run_end"), ("__s", "__e"), 1 << 16)
    return pairs.select("gene_id", "sample", F.greatest("run_start", "__s").alias("run_start"), F.least("run_end", "__e").alias("run_end"), F.col("depth").cast("int").alias("depth"))
