"""All tunables of the engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    chunk_tokens: int = 512
    chunk_overlap: int = 50
    tokens_per_word: float = 2.0
    measured_tokens_per_word: float = 2.77
    least_lead_tokens: int = 20
    top_k: int = 5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    fusion_depth: int = 50
    fused_threshold: float = 0.32979
    fused_floor: float = 0.18804
    dense_threshold: float = 0.606
    dense_floor: float = 0.53
    context_window: int = 4000
    completion_tokens: int = 900
    context_margin: int = 96
    tokens_per_message: int = 4
    history_turns: int = 3
    history_answer_tokens: int = 120
    least_document_chars: int = 200
    least_page_chars: int = 30
    most_replacement_ratio: float = 0.001
    least_turkish_chars: int = 1
    longest_run: int = 40
    embedding_dim: int | None = None  # set: vectors of another size raise
    embed_batch: int = 32
    embed_retries: int = 3

    @property
    def context_budget(self) -> int:
        """Prompt tokens left once the answer and the margin are set aside."""
        return self.context_window - self.completion_tokens - self.context_margin


DEFAULTS = Params()
