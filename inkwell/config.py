"""Settings, passed explicitly; read from the environment only by ``from_env``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

TRUE = ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    """Each field is read from ``INKWELL_<NAME>``; a value that is set but empty counts as unset."""

    corpus: str = "~/Knowledge"
    store: str = "./inkwell-store"
    embed_url: str = ""
    embed_model: str = ""
    embed_key: str = "none"
    embed_dims: int = 64
    embed_batch: int = 16
    embed_timeout: float = 300.0
    embed_instruction: str = ""
    llm_url: str = ""
    llm_model: str = ""
    llm_key: str = "none"
    llm_max_tokens: int = 4000
    llm_timeout: float = 900.0
    llm_concurrency: int = 1
    max_entities: int = 20
    chunk_words: int = 350
    chunk_overlap: int = 60
    merge_threshold: float = 0.92
    score_mode: str = "normalized"
    semantic_queries: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Settings":
        env = dict(os.environ) if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(f"INKWELL_{f.name.upper()}", "").strip()
            if raw:
                kind = type(f.default)
                given[f.name] = raw.lower() in TRUE if kind is bool else kind(raw)
        return cls(**given)

    def embedder(self):
        from inkwell.sources.providers import HashEmbedder, HttpEmbedder

        return HttpEmbedder(self.embed_url, self.embed_model, self.embed_dims, self.embed_key, self.embed_timeout) if self.embed_url else HashEmbedder(self.embed_dims)

    def extractor(self):
        from inkwell.sources.providers import CapitalsExtractor, HttpExtractor

        return HttpExtractor(self.llm_url, self.llm_model, self.llm_key, self.llm_max_tokens, self.llm_timeout) if self.llm_url else CapitalsExtractor()
