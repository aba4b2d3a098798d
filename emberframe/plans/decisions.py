"""What ran and why.  Catalyst and AQE choose the physical plan; these record the engine's own choices."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from enum import Enum


class Reason(Enum):
    HOT_CACHED = "Hot_Cached"
    COLD_SCAN = "Cold_Scan"
    BROADCAST_BUILD = "Broadcast_Build"
    SORTED_BUILD = "Sorted_Build"
    SHUFFLE_HASH = "Shuffle_Hash"
    CATALYST = "Catalyst"


@dataclass
class Decision:
    op: str
    reason: Reason
    wall_ms: float = 0.0
    counts: dict[str, int] = field(default_factory=dict)

    def __str__(self) -> str:
        counts = "".join(f" {k}={v}" for k, v in self.counts.items())
        return f"op={self.op} backend=spark reason={self.reason.value}{counts} wall_ms={self.wall_ms:.3f}"


#: Build keys that may be broadcast: 16 bytes each, 32 MB at most.
BROADCAST_KEYS = 2_000_000


def choose_reduce(resident: bool) -> Reason:
    """Follows where the data are: a resident column is read where it is kept, anything else is scanned."""
    return Reason.HOT_CACHED if resident else Reason.COLD_SCAN


def choose_join(build_rows: int, hint: str | None = None) -> Reason:
    """The build side's size decides; EMBERFRAME_JOIN or `hint` (broadcast, shuffle_hash, merge) overrides."""
    hint = hint or os.environ.get("EMBERFRAME_JOIN")
    if hint:
        return {"broadcast": Reason.BROADCAST_BUILD, "shuffle_hash": Reason.SHUFFLE_HASH, "merge": Reason.SORTED_BUILD}[hint]
    return Reason.BROADCAST_BUILD if build_rows <= BROADCAST_KEYS else Reason.SORTED_BUILD
