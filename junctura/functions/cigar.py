"""Columns over CIGAR strings.  Positions are 0-based, intervals half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operations that move along the reference, that cover it, that count as anchor.
MOVES, COVERS = ["M", "D", "N", "=", "X"], ["M", "D", "=", "X"]


def operations(cigar: Column) -> Column:
    """array<struct<op, len>>; null or * gives an empty array."""
    text = F.coalesce(cigar, F.lit(""))
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(2)).alias("op"),
        F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(1)), lambda x: x.cast("int")).alias("len"),
    )


def _placed(pos: Column, cigar: Column) -> Column:
    """array<struct<op, start, stop>> of the operations that move along the reference."""
    step = lambda a, x: F.struct(
        (a["at"] + x["len"]).alias("at"), F.concat(a["out"], F.array(F.struct(x["op"].alias("op"), a["at"].alias("start"), (a["at"] + x["len"]).alias("stop")))).alias("out")
    )
    ops = F.filter(operations(cigar), lambda x: x["op"].isin(MOVES))
    empty = F.expr("CAST(array() AS array<struct<op:string,start:int,stop:int>>)")
    return F.aggregate(ops, F.struct(pos.cast("int").alias("at"), empty.alias("out")), step, lambda a: a["out"])


def blocks(pos: Column, cigar: Column) -> Column:
    """Covered stretches: deletions count as covered, introns do not."""
    return F.transform(F.filter(_placed(pos, cigar), lambda x: x["op"].isin(COVERS)), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))


def junctions(pos: Column, cigar: Column) -> Column:
    return F.transform(F.filter(_placed(pos, cigar), lambda x: x["op"] == "N"), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))


def is_spliced(cigar: Column) -> Column:
    return F.coalesce(cigar, F.lit("")).contains("N")


def min_anchor(cigar: Column) -> Column:
    """The least number of bases in M, D, = and X between introns and at the ends."""
    anchors = F.transform(F.split(F.regexp_replace(cigar, "[0-9]+[HSIP]", ""), "[0-9]+N"), lambda part: F.aggregate(F.regexp_extract_all(part, F.lit("([0-9]+)[MDX=]"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int")))
    return F.array_min(anchors)
