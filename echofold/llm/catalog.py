"""All queries of this subpackage."""

from __future__ import annotations

from echofold.llm import (  # noqa: F401
    decontaminate, hard_negatives, language_id, near_dups, packing, pii, quality, token_counts, token_files, toxicity, url_filter, warc, whitening,
)
from echofold.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
