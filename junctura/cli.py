"""Command line: prep, build, test and viz-data."""

from __future__ import annotations

import argparse

from junctura.config import EVENT_TYPES, MERGES, Config
from junctura.functions.multiple_testing import METHODS


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="junctura", description="Alternative splicing on Spark")
    sub = top.add_subparsers(dest="mode", required=True)
    for mode in ("prep", "build", "test", "viz-data"):
        p = sub.add_parser(mode)
        p.add_argument("-o", "--outdir", required=True)
        p.add_argument("-c", "--confidence", type=int, default=3)
        p.add_argument("-n", "--readlen", type=int, default=50)
        p.add_argument("-M", "--merge-strat", default="merge_graphs", choices=MERGES)
        p.add_argument("--validate-sg", action="store_true")
        p.add_argument("--event-types", default=",".join(EVENT_TYPES))
        if mode in ("prep", "build"):
            p.add_argument("-a", "--annotation", required=True)
            p.add_argument("-b", "--bams", required=True, help="alignment files, comma-separated, or a .txt list")
            p.add_argument("--primary-only", action=argparse.BooleanOptionalAction, default=True)
            p.add_argument("--var-aware", action="store_true")
            p.add_argument("--ignore-mismatches", action="store_true")
            p.add_argument("--filter-overlap-genes", action="store_true", help="leave out genes that overlap another one")
            p.add_argument("--filter-overlap-exons", action="store_true", help="leave out genes that share an exon with another one")
            p.add_argument("--filter-overlap-transcripts", action="store_true", help="leave out genes with a transcript whose exons overlap")
        if mode == "build":
            p.add_argument("--filter-consensus", default="", choices=["", "strict", "lenient"])
            p.add_argument("--reference", default="")
            p.add_argument("--validate-sg-count", type=int, default=10)
            p.add_argument("-I", "--iterations", type=int, default=5)
            p.add_argument("--ase-edge-limit", type=int, default=500)
            p.add_argument("--psi-min-reads", type=int, default=10)
            for name in ("es", "ir", "ni"):
                p.add_argument(f"--insert-{name}", action=argparse.BooleanOptionalAction, default=True)
            p.add_argument("--remove-se", action="store_true")
            p.add_argument("--filter-ambiguous", action="store_true")
            p.add_argument("--use-anno-support", action="store_true")
            p.add_argument("--qmode", default="all", choices=["all", "single", "collect"], help="all: count all samples; single: count the given ones over a finished graph, each in a partition of its own; collect: go on with the counts of those")
        if mode == "test":
            p.add_argument("--condition-a", required=True)
            p.add_argument("--condition-b", required=True)
            p.add_argument("--label-a", default="A")
            p.add_argument("--label-b", default="B")
            p.add_argument("--correction", default="bh", choices=METHODS)
            p.add_argument("--max-zero-frac", type=float, default=0.5)
            p.add_argument("--dpsi", type=float, default=0.05)
            p.add_argument("--min-count", type=int, default=10)
            p.add_argument("--cap-exp-outliers", action=argparse.BooleanOptionalAction, default=True)
            p.add_argument("--cap-outliers", action="store_true")
        if mode == "viz-data":
            what = p.add_mutually_exclusive_group(required=True)
            what.add_argument("--gene")
            what.add_argument("--event", help="type and number, as exon_skip.3")
            what.add_argument("--range", help="contig:start-stop")
            what.add_argument("--top", help="the best events of a test: type:number of events, as exon_skip:5")
    return top


def names(text: str) -> tuple[str, ...]:
    """A comma-separated list, or the lines of a .txt file."""
    if text.endswith(".txt"):
        with open(text) as f:
            return tuple(line.strip() for line in f if line.strip())
    return tuple(x for x in text.split(",") if x)


def config(args: argparse.Namespace) -> Config:
    given = vars(args)
    keys = {
        "outdir": "outdir", "confidence": "confidence", "readlen": "read_length", "annotation": "annotation", "primary_only": "primary_only", "var_aware": "var_aware",
        "ignore_mismatches": "ignore_mismatches", "filter_consensus": "filter_consensus", "reference": "reference", "validate_sg": "validate", "validate_sg_count": "validate_min",
        "iterations": "iterations", "ase_edge_limit": "edge_limit", "psi_min_reads": "psi_min_reads", "insert_es": "insert_cassettes", "insert_ir": "insert_retentions",
        "insert_ni": "insert_edges", "remove_se": "remove_short", "filter_ambiguous": "filter_ambiguous", "use_anno_support": "use_annotated_support", "correction": "correction", "max_zero_frac": "max_zero",
        "merge_strat": "merge", "filter_overlap_genes": "drop_overlapping_genes", "filter_overlap_exons": "drop_shared_exons", "filter_overlap_transcripts": "drop_overlapping_exons", "label_a": "label_a", "label_b": "label_b", "dpsi": "min_dpsi", "min_count": "min_count", "cap_exp_outliers": "cap_expression", "cap_outliers": "cap_counts",
    }
    found = {new: given[old] for old, new in keys.items() if old in given}
    return Config(**found, samples=names(given["bams"]) if "bams" in given else (), event_types=names(given["event_types"]))


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from junctura.plans.build import Build, SampleCounts

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("junctura").getOrCreate()
    job = Build(spark, config(args))
    if args.mode == "prep":
        job.annotation()
        job.prepare()
    elif args.mode == "build":
        from junctura.plans import report

        if args.qmode == "single":
            SampleCounts(spark, job.cfg).add(list(job.cfg.samples))
            return
        job.run(collected=args.qmode == "collect")
        report.write(spark, job.cfg)
    elif args.mode == "test":
        from junctura.plans import report

        a, b = list(names(args.condition_a)), list(names(args.condition_b))
        for kind in job.cfg.event_types:
            report.write_test(spark, job.cfg, job.test(kind, a, b), kind, a, b)
    else:
        from junctura.plans import viz_data

        root = job.cfg.root
        if args.gene:
            viz_data.gene_tables(spark, root, args.gene)
        elif args.event:
            viz_data.event_tables(spark, root, args.event)
        elif args.range:
            viz_data.range_tables(spark, root, args.range)
        else:
            kind, _, k = args.top.partition(":")
            viz_data.top_tables(spark, root, job.cfg.confidence, kind, int(k or 1))


if __name__ == "__main__":
    main()
