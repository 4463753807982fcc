"""Parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 800
    chunk_overlap: int = 150
    dense_top_k: int = 50
    lexical_top_k: int = 50
    rerank_top_k: int = 10
    rrf_k: int = 60
    dense_weight: float = 0.35
    lexical_weight: float = 0.25
    sentence_min_chars: int = 12
    sentence_max_chars: int = 220
    sentences_per_chunk: int = 12
    overfetch: int = 5
    neighbours: int = 1
    score_threshold: float = 0.0
    metric: str = "l2sq"
