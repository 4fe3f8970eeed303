"""Search settings with their limits."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class SearchConfig:
    mode: str = "hybrid"  # hybrid, bm25 or vector
    top_k: int = 8
    chunk_top_k: int = 3
    candidate_size: int = 80
    rerank: bool = False
    rerank_top_n: int = 50
    rerank_weight: float = 0.25
    rank_safe: int = 20
    route_weights: dict[str, float] = field(default_factory=dict)
    profiles: bool = True  # else only the raw routes, no rewrites and no bonus
    bonus: bool = True  # of the profile on every hit's score

    def validate(self) -> SearchConfig:
        if self.mode not in ("hybrid", "bm25", "vector"):
            raise ValueError(f"unknown mode {self.mode!r}")
        for name in ("top_k", "chunk_top_k", "candidate_size", "rerank_top_n"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.candidate_size < self.top_k:
            raise ValueError("candidate_size must not be under top_k")
        return replace(self, rerank_weight=min(1.0, max(0.0, self.rerank_weight)))


#: The callers' own defaults.
CLI = SearchConfig()
WEB = SearchConfig(rerank=True, rerank_top_n=30)
ADVISOR = SearchConfig(rerank=True, rerank_top_n=20, rerank_weight=0.35)
BENCHMARK = SearchConfig(top_k=100, chunk_top_k=2, candidate_size=300, rerank_top_n=100)

#: What a benchmark compares, by name.
METHODS = {"hybrid": BENCHMARK, "hybrid_rerank": replace(BENCHMARK, rerank=True)}


def chosen_methods(value: object = None) -> list[str]:
    """The known methods among those asked for, each once, in that order; both if nothing is given, reranking if none is known."""
    asked = [value] if isinstance(value, str) else [str(x) for x in value] if isinstance(value, list) else list(METHODS)
    return [m for m in dict.fromkeys(asked) if m in METHODS] or ["hybrid_rerank"]
