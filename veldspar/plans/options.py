"""Options of retrieval and their ranges."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

_RANGES = {"top_k": (1, 50), "max_context_chars": (500, 50_000), "mmr_lambda": (0.0, 1.0), "source_window": (0, 3), "max_sources_per_file": (1, 20), "file_selection_limit": (1, 50), "explain_limit": (1, 100)}
_CHOICES = {
    "mode": ("hybrid", "vector", "keyword"), "context_mode": ("rag", "full", "auto", "none"), "diversity": ("relevance", "mmr"),
    "file_selection_mode": ("all", "auto"), "minimum_answerability": ("none", "low", "medium", "high"),
}


@dataclass(frozen=True)
class Options:
    """What a retrieval does; a value out of range is an error."""

    top_k: int = 5
    max_context_chars: int = 24_000
    relevance_threshold: float = 0.05
    mode: str = "hybrid"
    context_mode: str = "rag"
    diversity: str = "relevance"
    mmr_lambda: float = 0.7
    source_window: int = 0
    max_sources_per_file: int | None = None
    file_selection_mode: str = "all"
    file_selection_limit: int = 5
    minimum_answerability: str = "none"
    explain_limit: int = 20
    chunk_size: int = 900
    chunk_overlap: int = 180
    dimensions: int = 384

    def __post_init__(self) -> None:
        for name, (low, high) in _RANGES.items():
            value = getattr(self, name)
            if value is not None and not low <= value <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        for name, allowed in _CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")

    def override(self, *layers: Mapping[str, object]) -> Options:
        """These options under those of ``layers``, the last of which is strongest; None doesn't override."""
        chosen = {k: v for layer in layers for k, v in layer.items() if v is not None}
        return replace(self, **chosen)

    @classmethod
    def from_environment(cls, prefix: str = "VELDSPAR_") -> Options:
        kinds = {"int": int, "float": float, "str": str, "int | None": int}
        found = {f.name: kinds[str(f.type)](os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return cls(**found)
