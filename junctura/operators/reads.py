"""From alignments to junctions and coverage.

alignments: sample, contig, pos, flag, cigar, nm, xs (strand tag or null), xm, xg.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.functions import cigar
from junctura.operators import intervals


@dataclass(frozen=True)
class ReadFilter:
    """What a read needs: a spliced one an anchor longer than ``exon_len``, any at most ``mismatch``."""

    exon_len: int
    mismatch: int
    mincount: int

    @classmethod
    def preset(cls, confidence: int, read_length: int) -> "ReadFilter":
        share = (0.10, 0.15, 0.20, 0.25)[confidence]
        wrong = (max(2, math.floor(0.03 * read_length)), max(1, math.floor(0.02 * read_length)), max(1, math.floor(0.01 * read_length)), 0)[confidence]
        return cls(math.ceil(read_length * share), wrong, (1, 2, 2, 2)[confidence])

    def tightened(self) -> "ReadFilter":
        return ReadFilter(min(36, self.exon_len + 4), max(0, self.mismatch - 1), 2 * self.mincount)


def passes(given: ReadFilter | None, primary_only: bool = True, var_aware: bool = False, use_mismatches: bool = True, strand: Column | None = None) -> Column:
    """Whether an alignment counts; a missing mismatch tag raises an error where it is needed."""
    flag = F.col("flag")
    ok = flag.bitwiseAND(4) == 0
    if primary_only:
        ok = ok & (flag.bitwiseAND(256) == 0)
    if given is not None:
        spliced = cigar.is_spliced(F.col("cigar"))
        ok = ok & (~spliced | (cigar.min_anchor(F.col("cigar")) > given.exon_len))
        if use_mismatches:
            count = mismatches(var_aware)
            wrong = F.when(flag.bitwiseAND(4) != 0, F.lit(0)).when(count.isNull(), F.raise_error(F.lit("an alignment has no mismatch tag")).cast("int")).otherwise(count)
            ok = ok & (wrong <= given.mismatch)
    if strand is not None:
        ok = ok & (F.col("xs").isNull() | (F.col("xs") == strand))
    return ok


def mismatches(var_aware: bool = False) -> Column:
    return F.col("xm") + F.col("xg") if var_aware else F.col("nm")


def junctions(alignments: DataFrame) -> DataFrame:
    """sample, contig, strand, i_start, i_end, n; a read without a strand tag counts as plus."""
    each = alignments.where(cigar.is_spliced(F.col("cigar"))).select("sample", "contig", _strand().alias("strand"), F.explode(cigar.junctions(F.col("pos"), F.col("cigar"))).alias("j"))
    return each.groupBy("sample", "contig", "strand", F.col("j.start").alias("i_start"), F.col("j.stop").alias("i_end")).agg(F.count("*").alias("n"))


def _strand() -> Column:
    return F.when(F.col("xs") == "-", "-").otherwise("+")


JUNCTION = ["sample", "contig", "xs", "i_start", "i_end"]
MAX_ANCHOR = 37  # one more than any filter asks for


def junction_cube(alignments: DataFrame, loosest: ReadFilter, wrong: Column) -> DataFrame:
    """JUNCTION, anchor, wrong, n: how many reads have a junction with each shortest anchor and number of mismatches.

    Every filter that is no looser than ``loosest`` is a sum over this table, so the reads
    are read once, however often filters are tightened.  Both numbers stop where no filter
    tells them apart; a missing number of mismatches stays null, a missing strand is "."."""
    anchor = F.greatest(F.least(cigar.min_anchor(F.col("cigar")), F.lit(MAX_ANCHOR)), F.lit(loosest.exon_len))
    most = F.when(wrong.isNotNull(), F.least(wrong, F.lit(loosest.mismatch + 1)))
    each = alignments.where(cigar.is_spliced(F.col("cigar"))).select("sample", "contig", F.coalesce("xs", F.lit(".")).alias("xs"), anchor.alias("anchor"), most.alias("wrong"), F.explode(cigar.junctions(F.col("pos"), F.col("cigar"))).alias("j"))
    return each.groupBy("sample", "contig", "xs", F.col("j.start").alias("i_start"), F.col("j.stop").alias("i_end"), "anchor", "wrong").agg(F.count("*").alias("n"))


def cube_junctions(cube: DataFrame, given: ReadFilter, use_mismatches: bool = True) -> DataFrame:
    """The :func:`junctions` of the reads that pass a filter."""
    ok = F.col("anchor") > given.exon_len
    if use_mismatches:
        wrong = F.when(F.col("wrong").isNull(), F.raise_error(F.lit("an alignment has no mismatch tag")).cast("int")).otherwise(F.col("wrong"))
        ok = (wrong <= given.mismatch) & ok
    return cube.where(ok).groupBy("sample", "contig", _strand().alias("strand"), "i_start", "i_end").agg(F.sum("n").alias("n"))


def all_junctions(cube: DataFrame) -> DataFrame:
    """JUNCTION, n of all reads of the cube."""
    return cube.groupBy(*JUNCTION).agg(F.sum("n").alias("n"))


def coverage(alignments: DataFrame) -> DataFrame:
    """sample, contig, run_start, run_end, depth."""
    each = alignments.select("sample", "contig", F.explode(cigar.blocks(F.col("pos"), F.col("cigar"))).alias("b"))
    return intervals.coverage_runs(each.select("sample", "contig", F.col("b.start").alias("s"), F.col("b.stop").alias("e")), ["sample", "contig"], "s", "e")


def tracks(alignments: DataFrame, **chosen: Column) -> DataFrame:
    """sample, contig, run_start, run_end and the depth of the reads that meet each of the named conditions, in one pass."""
    own = [F.coalesce(c.cast("int"), F.lit(0)).alias(name) for name, c in chosen.items()]
    each = alignments.select("sample", "contig", *own, F.explode(cigar.blocks(F.col("pos"), F.col("cigar"))).alias("b"))
    return intervals.track_runs(each.select("sample", "contig", *chosen, F.col("b.start").alias("s"), F.col("b.stop").alias("e")), ["sample", "contig"], "s", "e", list(chosen))


def gene_introns(junction: DataFrame, genes: DataFrame, mincount: int, window: int = 5000, width: int = 1 << 16) -> DataFrame:
    """The junctions strictly inside each gene's window and on its strand, seen ``mincount`` times or more."""
    wide = genes.select("gene_id", "contig", "strand", F.greatest(F.col("g_start") - window, F.lit(1)).alias("__s"), (F.col("g_end") + window).alias("__e"))
    pairs = intervals.interval_join(junction.where(F.col("n") >= mincount), wide, ["contig", "strand"], ("i_start", "i_end"), ("__s", "__e"), width)
    return pairs.where("i_start > __s AND i_end < __e").drop("__s", "__e")
