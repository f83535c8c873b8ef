"""Every knob of retrieval and ingestion, with its default; read from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class RetrievalConfig:
    """Thresholds are data: a sweep is a frame of these rows."""

    start_threshold: float = 0.55
    confident_threshold: float = 0.92
    graph_anchor_threshold: float = 0.35
    graph_anchor_max_starts: int = 3
    propagation_decay: float = 0.90
    propagation_hop_threshold: float = 0.25
    propagation_max_depth: int = 4
    propagation_max_nodes: int = 25
    stub_penalty: float = 0.50
    graphrag_seed_threshold: float = 0.35
    link_threshold: float = 0.88
    link_ambiguous_min: float = 0.82
    segment_mode: str = "paragraph"
    semantic_split_threshold: float = 0.75
    min_segment_chars: int = 150
    vector_size: int = 768

    @staticmethod
    def from_env() -> RetrievalConfig:
        """Defaults overridden by environment variables of the same names."""
        base = RetrievalConfig()
        found = {f.name: type(getattr(base, f.name))(os.environ[f.name.upper()]) for f in fields(base) if f.name.upper() in os.environ}
        return replace(base, **found)
