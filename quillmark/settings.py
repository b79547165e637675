"""Defaults of the document-typing operators."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    zone_weights: dict[str, float] = field(default_factory=lambda: {"title": 3.0, "heading": 2.0, "body": 1.0, "table": 1.2, "furniture": 0.25})
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    temperature: float = 0.6
    fuse_anchor: float = 3.0
    fuse_lexical: float = 1.0
    fuse_embedding: float = 0.8
    least_lead: float = 0.04
    least_support: float = 0.30
    least_coverage: float = 0.20
    accept_confidence: float = 0.60
    profile_terms: int = 40
    prior_strength: float = 500.0
    average_length: float = 400.0
    caps_length: int = 3
    anchor_caps_length: int = 4
    decisive_factor: float = 2.0
    negative_penalty: float = 1.0
    score_ceiling: float = 0.97
    most_block_chars: int = 32768
    most_blocks: int = 50_000
    geometry_tolerance: float = 0.02
    image_dominance: float = 0.6


DEFAULTS = Settings()
