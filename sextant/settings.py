"""Tunable values of the retrieval jobs, with the defaults every operator uses."""

from __future__ import annotations

from dataclasses import dataclass


MAX_TOP_K = 50  # largest request the query schema admits


@dataclass(frozen=True)
class Settings:
    # chunk sizes, in characters
    parent_chunk_size: int = 2400
    parent_chunk_overlap: int = 240
    child_chunk_size: int = 520
    child_chunk_overlap: int = 80
    # retrieval windows
    default_top_k: int = 5
    child_chunks_per_parent: int = 3
    candidate_multiplier: int = 4
    max_query_variants: int = 3
    query_expansion_enabled: bool = True
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    metadata_boost_enabled: bool = True
    metadata_boost_weight: float = 0.12
    min_score: float = 0.15
    query_rewrite_min_chars: int = 8
    # rerank
    rerank_enabled: bool = True
    rerank_top_n: int = 40
    rerank_weight: float = 0.55
    # keyword search
    fulltext_max_terms: int = 16
    like_max_terms: int = 16
    like_metadata_max_terms: int = 8
    like_fallback_enabled: bool = True
    like_fallback_min_hits: int = 0
    # whole-document context
    full_document_enabled: bool = True
    full_document_max_docs: int = 2
    full_document_max_chars: int = 24000
    full_document_min_score: float = 0.15
    # context refinement
    refine_max_hits: int = 8
    # recognised-text pages
    ocr_strategy: str = "auto"
    ocr_min_confidence: float = 0.35
    ocr_low_confidence: float = 0.55
    ocr_complex_layout_lines: int = 24
    ocr_page_min_chars: int = 30
    ocr_page_limit: int = 80
    ocr_raw_max_chars: int = 12000
    ocr_vision_max_chars: int = 8000
    # conversation budget, in estimated tokens
    context_window_tokens: int = 262144
    compression_trigger_tokens: int = 200000
    retrieval_reserve_tokens: int = 16000
    summary_reserve_tokens: int = 12000
    token_safety_margin: int = 2048
    # ingest
    ingest_max_retries: int = 3
    ingest_stale_seconds: int = 1800
    # vectors
    vector_dim: int = 64
    vector_metric: str = "L2"
    vector_block_rows: int = 20000
    query_block_rows: int = 1024
    # "exact" compares all vectors of a scope, "cells" those of the closest cells
    vector_search: str = "exact"
    rescore_factor: int = 4

    # the largest windows that a request of the largest top_k can ask for

    @property
    def candidate_bound(self) -> int:
        floor = self.rerank_top_n if self.rerank_enabled else 0
        return max(MAX_TOP_K * 2 * max(self.child_chunks_per_parent, 1) * max(self.candidate_multiplier, 1), floor)

    @property
    def cross_kb_bound(self) -> int:
        return max(self.hit_bound, self.rerank_top_n if self.rerank_enabled else 0)

    @property
    def parent_bound(self) -> int:
        floor = -(-max(self.rerank_top_n, 0) // max(self.child_chunks_per_parent, 1))
        widened = min(max(self.rerank_top_n, 0), MAX_TOP_K * max(self.candidate_multiplier, 1))
        return max(MAX_TOP_K, floor, widened) if self.rerank_enabled else MAX_TOP_K

    @property
    def hit_bound(self) -> int:
        return MAX_TOP_K * max(self.child_chunks_per_parent, 1)


DEFAULTS = Settings()
