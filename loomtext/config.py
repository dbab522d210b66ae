"""Settings of retrieval and context assembly."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class RetrievalConfig:
    """Defaults, overlaid by ``with_stored``."""

    heading_level: str = "h1"
    target_words: int = 500
    overlap_words: int = 100
    excerpt_chars: int = 2500
    context_tokens: int = 128_000
    sliding_words: int = 20_000
    query_terms: int = 24
    metadata_candidates: int = 200
    content_candidates: int = 120
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    bm25_cap: int = 400
    dense_cap: int = 200
    rrf_k: int = 60
    rrf_cap: int = 1000
    mmr_lambda: float = 0.72
    mmr_candidates: int = 400
    mmr_stop: float = 0.95
    rerank_shortlist: int = 60
    rerank_cap: int = 120

    def with_stored(self, stored: dict) -> RetrievalConfig:
        """These settings with the known keys of a stored record; unknown keys are ignored."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in stored.items() if k in known})
