"""Settings of a run.  Immutable: steps that tighten a setting return a new one."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

EVENT_TYPES = ("exon_skip", "intron_retention", "alt_3prime", "alt_5prime", "mult_exon_skip", "mutex_exons")

LAYOUT = 2  # of the stages' tables; stages of another one are made anew
MERGES = ("merge_graphs", "merge_bams", "merge_all", "single")
# For each group of a build's stages, by the beginning of their names: the groups it is made from, and the settings it depends on besides.
STAGE_SETTINGS: dict[str, tuple[list[str], list[str]]] = {
    "genes": ([], ["annotation", "drop_overlapping_genes", "drop_shared_exons", "drop_overlapping_exons"]),
    "exons": (["genes"], []),
    "prep/introns": (["prep", "genes"], ["filter_consensus", "filter_ambiguous", "reference"]),
    "prep": ([], ["samples", "confidence", "read_length", "primary_only", "var_aware", "ignore_mismatches", "merge"]),
    "graphs": (["prep/introns"], ["iterations", "insert_cassettes", "insert_retentions", "insert_edges", "remove_short", "retention", "cassette", "edges"]),
    "merged": (["graphs"], []),
    "counts": (["merged"], ["validate", "validate_min"]),
    "expression": (["counts"], []),
    "size_factors": (["counts"], []),
    "events": (["merged"], ["validate", "validate_min", "edge_limit", "event_types"]),
    "psi": (["events", "counts"], ["psi_min_reads", "evidence", "use_annotated_support"]),
    "confirmed": (["psi"], []),
}


@dataclass(frozen=True)
class Retention:
    """When an intron counts as retained: median depth, covered share, and depth against its flanks."""

    min_cov: float
    min_region: float
    rel_low: float
    rel_high: float
    fold: float = 4.0

    @classmethod
    def preset(cls, confidence: int) -> "Retention":
        return (cls(1, 0.75, 0.1, 2), cls(2, 0.75, 0.1, 1.2), cls(5, 0.9, 0.2, 1.2), cls(10, 0.9, 0.2, 1.2))[confidence]


@dataclass(frozen=True)
class Cassette:
    min_cov: float = 5
    min_region: float = 0.9
    rel_diff: float = 0.5


@dataclass(frozen=True)
class IntronEdges:
    min_exon: int = 50
    vicinity: int = 40
    gap_cov: float = 10
    gap_region: float = 0.9
    max_terminal: int = 200
    max_copies: int = 20


@dataclass(frozen=True)
class Evidence:
    """Least counts and relative depth that confirm an event in a sample."""

    junction: int = 3
    mutex_junction: int = 2
    rel_cov: float = 0.05


@dataclass(frozen=True)
class Config:
    outdir: str
    annotation: str = ""
    samples: tuple[str, ...] = ()
    reference: str = ""
    confidence: int = 3
    read_length: int = 50
    iterations: int = 5
    insert_cassettes: bool = True
    insert_retentions: bool = True
    insert_edges: bool = True
    remove_short: bool = False
    merge: str = "merge_graphs"
    validate: bool = False
    validate_min: int = 10
    edge_limit: int = 500
    psi_min_reads: int = 10
    filter_consensus: str = ""
    filter_ambiguous: bool = False
    drop_overlapping_genes: bool = False
    drop_shared_exons: bool = False
    drop_overlapping_exons: bool = False
    primary_only: bool = True
    var_aware: bool = False
    ignore_mismatches: bool = False
    use_annotated_support: bool = False
    event_types: tuple[str, ...] = EVENT_TYPES
    max_zero: float = 0.5
    min_dpsi: float = 0.05
    min_count: int = 10
    correction: str = "bh"
    label_a: str = "A"
    label_b: str = "B"
    cap_expression: bool = True
    cap_counts: bool = False
    retention: Retention | None = None
    cassette: Cassette = field(default_factory=Cassette)
    edges: IntronEdges = field(default_factory=IntronEdges)
    evidence: Evidence = field(default_factory=Evidence)

    def __post_init__(self):
        if not 0 <= self.confidence <= 3:
            raise ValueError("confidence is 0 to 3")
        if self.filter_consensus not in ("", "strict", "lenient"):
            raise ValueError("filter_consensus is strict or lenient")
        if self.filter_consensus and not self.reference:
            raise ValueError("filter_consensus needs a reference")
        if self.merge not in MERGES:
            raise ValueError(f"merge is one of {', '.join(MERGES)}")
        unknown = set(self.event_types) - set(EVENT_TYPES)
        if unknown:
            raise ValueError(f"unknown event types: {sorted(unknown)}")
        if self.retention is None:
            object.__setattr__(self, "retention", Retention.preset(self.confidence))

    @property
    def root(self) -> str:
        """The folder of a build, named by confidence, merge mode and validation."""
        return f"{self.outdir.rstrip('/')}/conf{self.confidence}.{self.merge}{'.validated' if self.validate else ''}"

    def digest(self, stage: str, stamps: dict[str, str]) -> str:
        """A hash of the settings and input files that a stage of a build depends on."""
        group = next(g for g in STAGE_SETTINGS if stage.startswith(g))
        names, todo = set(), [group]
        while todo:
            before, own = STAGE_SETTINGS[todo.pop()]
            names |= set(own)
            todo += before
        given = asdict(self)
        files = [p for n in ("annotation", "reference", "samples") if n in names for p in ([given[n]] if isinstance(given[n], str) else given[n])]
        told = {n: given[n] for n in sorted(names)}, [(p, stamps.get(p, "")) for p in files], LAYOUT
        return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()

    @property
    def patterns(self) -> tuple[str, ...]:
        """The patterns to look for: alt_right and alt_left stand for both alternative ends, one on either strand."""
        found = [("alt_right", "alt_left") if t.startswith("alt_") else (t,) for t in self.event_types]
        return tuple(sorted({p for some in found for p in some}))

    @property
    def support(self) -> int:
        """Samples that an edge needs when graphs are validated."""
        return min(self.validate_min, len(self.samples)) if self.samples else self.validate_min
