"""Options of the mapper and the chunk-wise decisions."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class MapOptions:
    """e events a seed, minimizers over w seeds (0: every seed), the least change from one event to the next (None: any), chaining
    limits, and how chains are scored and judged. prune: chain ends need least_score and half of the read's best score so far.
    Alignments go from anchor to anchor (sparse) or from a chain's first to its last one, in a band of ``share`` of the events
    (banded) or over the whole matrix."""

    e: int = 6
    w: int = 0
    least_change: float | None = 0.3
    band: int = 5000
    gap: int = 2000
    far: int = 5000
    skips: int = 25
    least_anchors: int = 2
    least_score: float = 10.0
    best_chains: int = 3
    prune: bool = True
    ratio: float = 1.2
    over_mean: float = 5.0
    bonus: float = 0.4
    share: float = 0.1
    sparse: bool = True
    banded: bool = True
    least_aligned: float | None = 20.0
    least_events: int = 50
    most_chunks: int = 30

    def __post_init__(self):
        if self.e < 1 or self.w < 0:
            raise ValueError("e must be positive and w not negative")
        if not 0 < self.share <= 1:
            raise ValueError("share must be in (0, 1]")


#: What each preset changes.
PRESETS = {
    "sensitive": {"e": 6},
    "fast": {"e": 7},
    "faster": {"e": 7, "w": 5},
    "viral": {"e": 5},
    "sequence-until": {"e": 7},
}


def options(preset: str | None = None, **changes) -> MapOptions:
    """A preset's options; single changes take precedence, whatever their order was on the command line."""
    return replace(MapOptions(), **{**PRESETS[preset], **changes} if preset else changes)


def amount(text: str) -> int:
    """A number with an optional K, M or G, powers of 1000."""
    power = {"K": 3, "M": 6, "G": 9}.get(text[-1:].upper(), 0)
    return int(float(text[:-1] if power else text) * 10**power)
