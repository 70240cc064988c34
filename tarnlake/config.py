"""Settings that change results, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 8
    candidate_multiplier: int = 3
    candidate_k: int | None = None
    leaf_level: int = 3
    auto_merge: bool = True
    merge_threshold: int = 2
    rerank_min_score: float = 0.0
    rrf_k: int = 60

    def pool(self) -> tuple[int, str]:
        """RT-05: size of the candidate pool and where it comes from; never below ``top_k``."""
        if self.candidate_k is not None:
            return max(self.candidate_k, self.top_k), "explicit"
        return max(self.top_k * self.candidate_multiplier, self.top_k), "multiplier"


@dataclass(frozen=True)
class ChunkingConfig:
    size: int = 800
    overlap: int = 100

    def levels(self) -> dict[int, tuple[int, int]]:
        """(size, overlap) by level."""
        c, o = self.size, self.overlap
        return {1: (max(2000, 3 * c), max(400, 3 * o)), 2: (max(1000, 2 * c), max(200, 2 * o)), 3: (max(600, c), max(100, o))}


@dataclass(frozen=True)
class SemanticConfig:
    window: int = 3
    least_chars: int = 300
    percentile: float = 20.0
    paragraph_chars: int = 800
    most_chars: int = 800


#: Rows up to which a side of a join may be broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 200_000
#: Bytes that it may have as well, as far as its rows have a known width.
BROADCAST_BYTES = 64 << 20
