"""Settings with defaults; a missing file gives all defaults, a broken one an error."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields


@dataclass
class Crawl:
    max_pages: int = 500
    max_depth: int = 3
    per_domain: int = 50
    soft_block_min_bytes: int = 200
    retry_after_default: int = 30
    time_limit_seconds: int = 120
    concurrency: int = 8
    retries: int = 3
    backoff_ms: int = 500
    cache_entries: int = 2000
    cache_seconds: int = 600
    data_layers: bool = True


@dataclass
class Index:
    embedding_dim: int = 384
    chunk_words: int = 512
    chunk_overlap: float = 0.2
    simhash_bits: int = 3
    url_ttl_seconds: int = 3600


@dataclass
class Rank:
    rerank_top_k: int = 50
    min_relevance_score: float = 0.35
    max_per_domain: int = 2
    mmr_lambda: float = 0.7
    min_unique_orgs: int = 3


@dataclass
class Cache:
    query_similarity: float = 0.92
    query_ttl_seconds: int = 4 * 3600
    query_entries: int = 100
    embeddings: int = 10_000
    scores: int = 50_000


@dataclass
class Governor:
    """Pace in milliseconds within [50, 30,000] around a base of 500, jitter within [0, 0.999]."""

    base_ms: int = 500
    jitter: float = 0.2
    budget: int = 1000
    failures: int = 5
    cooldown_seconds: float = 300.0

    def clamped(self) -> Governor:
        return Governor(min(30_000, max(50, self.base_ms)), min(0.999, max(0.0, self.jitter)), max(0, self.budget), max(1, self.failures), max(0.0, self.cooldown_seconds))


@dataclass
class Config:
    crawl: Crawl = field(default_factory=Crawl)
    index: Index = field(default_factory=Index)
    rank: Rank = field(default_factory=Rank)
    cache: Cache = field(default_factory=Cache)
    governor: Governor = field(default_factory=Governor)

    @classmethod
    def load(cls, path: str) -> Config:
        """Unknown sections and keys are left out."""
        out = cls()
        if not os.path.exists(path):
            return out
        with open(path, "rb") as f:
            data = tomllib.load(f)
        for section in fields(cls):
            own = getattr(out, section.name)
            for key, value in (data.get(section.name) or {}).items():
                if hasattr(own, key):
                    setattr(own, key, value)
        return out
