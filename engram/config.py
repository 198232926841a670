"""Engine settings, with environment overrides for the operating constants."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Operating constants; the defaults are fixed values of the data model."""

    default_stability_days: float = 30.0
    retention_cutoff: float = 0.1
    reinforce_factor: float = 1.5
    max_stability_days: float = 365.0
    ann_pool: int = 100
    #: Cells of a vector index that a search reads; None compares with every row.
    probes: int | None = None
    cache_threshold: float = 0.95
    cache_size: int = 1000
    session_size: int = 50
    session_ttl_seconds: int = 86400
    chat_history: int = 15
    worker_history: int = 10
    own_facts: int = 5
    shared_facts: int = 5
    context_chunks: int = 3
    context_summaries: int = 2
    active_facts: int = 100
    community_facts: int = 20
    community_min_size: int = 2
    lpa_sweeps: int = 5
    resolution_vector_weight: float = 0.6
    resolution_name_weight: float = 0.4
    resolution_threshold: float = 0.93
    reflection_min_confidence: float = 0.7
    reflection_stability_days: float = 30.0
    chunk_size: int = 1000
    chunk_overlap: int = 200
    embed_batch: int = 100
    provider: str = "gemini"
    resolution_interval: str = "5 minutes"
    community_interval: str = "15 minutes"
    reflection_interval: str = "30 minutes"
    files_per_trigger: int = 100

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> "Settings":
        env = os.environ if env is None else env
        values: dict[str, object] = {}

        def number(name: str, field: str, kind) -> None:
            try:
                value = kind(env.get(name, ""))
            except ValueError:
                return
            if value > 0:
                values[field] = value

        number("DEFAULT_MEMORY_STABILITY_DAYS", "default_stability_days", float)
        number("SEMANTIC_CACHE_THRESHOLD", "cache_threshold", float)
        number("EMBEDDING_BATCH_SIZE", "embed_batch", int)
        number("VECTOR_INDEX_PROBES", "probes", int)
        number("CONSOLIDATION_QUEUE_SIZE", "files_per_trigger", int)
        for name, field in (
            ("LLM_PROVIDER", "provider"),
            ("ENTITY_RESOLUTION_INTERVAL", "resolution_interval"),
            ("COMMUNITY_RESOLUTION_INTERVAL", "community_interval"),
            ("REFLECTION_INTERVAL", "reflection_interval"),
        ):
            if env.get(name):
                values[field] = env[name]
        return cls(**values)


DEFAULTS = Settings()
