"""Limits of an engine as one immutable value; operators take their own defaults from the same numbers."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    search_limit: int = 12
    research_limit: int = 8
    local_cap: int = 8
    merged_cap: int = 12
    weak_score: int = 18
    share_of_top: float = 0.3
    graph_nodes: int = 600
    graph_edges: int = 3500
    pages_per_source: int = 4
    graph_candidates: int = 3
    lint_pages: int = 2500
    lint_issues: int = 1000
    topic_notes: int = 3000
    web_queries: int = 4
    web_per_query: int = 3
    web_total: int = 12
    archive_entries: int = 100_000
    archive_file_mib: int = 256
    archive_total_mib: int = 10_240

    def override(self, **values: int | float | None) -> Settings:
        """A copy with the given positive values; others are ignored, as unset."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in values.items() if k in known and v is not None and v > 0})

    @classmethod
    def from_environment(cls, prefix: str = "FOLIOFORGE_") -> Settings:
        """Settings from the environment; what is no number is ignored."""
        found = {}
        for f in fields(cls):
            try:
                found[f.name] = type(f.default)(os.environ.get(prefix + f.name.upper(), ""))
            except ValueError:
                continue
        return cls().override(**found)
