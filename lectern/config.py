"""Settings that define the results of ingest and retrieval."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    #: Fixed values, as all below: results depend on them.
    chunk_size: int = 1000
    chunk_overlap: int = 200
    #: Of the recursive splitter, most wanted first.
    separators: tuple[str, ...] = ("\n\n", "\n", "。", "！", "？", ".", "!", "?", " ", "")
    top_k: int = 5
    max_top_k: int = 20
    threshold: float = 0.7
    alpha: float = 0.6
    #: Each leg of hybrid search is asked for so many times top_k.
    over_fetch: int = 2
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    max_file_size: int = 50_000_000
    extensions: tuple[str, ...] = (".pdf", ".txt", ".md")
    history_messages: int = 5
    kept_messages: int = 10


DEFAULTS = Settings()
