"""Columns over nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Donor and acceptor dinucleotides of the two consensus modes.
DONORS = {"strict": ["GT"], "lenient": ["GT", "GC"]}
ACCEPTOR = "AG"


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def consensus_pairs(left: Column, right: Column, strand: Column, mode: str) -> Column:
    """Whether the first and last two bases of an intron, as on the plus strand, are a donor and an acceptor on its own."""
    plus = strand == "+"
    donor, acceptor = F.when(plus, left).otherwise(reverse_complement(right)), F.when(plus, right).otherwise(reverse_complement(left))
    return donor.isin(DONORS[mode]) & (acceptor == ACCEPTOR)


def consensus(seq: Column, strand: Column, start: Column, end: Column, mode: str) -> Column:
    """The same for an intron [start, end) of a sequence that is at hand."""
    left, right = F.upper(F.substring(seq, start + 1, F.lit(2))), F.upper(F.substring(seq, end - 1, F.lit(2)))
    return consensus_pairs(left, right, strand, mode)
