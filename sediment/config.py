"""Options that decide results, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    rrf_k: int = 60
    axis_limit: int = 50
    max_top_k: int = 20
    max_candidates: int = 100
    rerank_min_score: float = 0.05
    dedup_similarity: float = 0.85
    trigram_min_similarity: float = 0.3
    neighbor_window: int = 1
    result_max_chars: int = 1500
    classify_batch: int = 12
    classify_concurrency: int = 4
    history_max_chars: int = 8000
    embed_max_chars: int = 4000
    embed_dim: int = 1024
    embed_model: str = "bge-m3"
    embed_batch: int = 32
    publish_window: int = 200
    cache_ttl_seconds: int = 86400
    recent_turns: int = 8
    memory_top_k: int = 5
    summarize_every: int = 12
    memory_ttl_days: int = 180
    chart_max_points: int = 200
    chunk_chars: int = 1500
    chunk_overlap: int = 200
    clean_policy_version: int = 2
    #: A query set is broadcast; this bounds it.
    max_queries: int = 4096

    def top_k(self, k: int) -> int:
        return max(1, min(k, self.max_top_k))

    def candidates(self, k: int) -> int:
        """Recall floor of a search for k results, within the cap."""
        return max(1, min(max(5 * k, 25), self.max_candidates))


DEFAULT = Options()
