"""Settings of a pipeline, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    extensions: tuple[str, ...] = (".pdf", ".docx", ".html", ".txt", ".md")
    max_bytes: int = 25 * 1024 * 1024
    chunk_characters: int = 3000
    top_k: int = 5
    candidate_k: int = 40
    context_characters: int = 20_000
    max_output_tokens: int = 1024
    embedder: str = "hashed"
    scorer: str = "overlap"
    answerer: str = "extractive"
    model: str = "hashed"
    revision: str = "1"
    dimension: int = 64
