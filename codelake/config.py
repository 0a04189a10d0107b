"""Settings of an index and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """Limits and places; every field may be given by name."""

    root: str = "."
    warehouse: str = "warehouse"
    max_chunk_size: int = 2048
    max_file_bytes: int = 500_000
    header_chars: int = 8192
    top_k: int = 10
    call_depth: int = 10
    graph_depth: int = 5
    debounce_seconds: float = 2.0
    embed_tokens: int = 2048
    embed_model: str = "hashing-64"
    exclude_patterns: tuple[str, ...] = field(default_factory=tuple)

    @property
    def embed_chars(self) -> int:
        """Characters of a text that fit the embedder: three a token, less a fifth."""
        return int(self.embed_tokens * 3 * 0.8)
