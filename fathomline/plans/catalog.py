"""All queries of the opportunity operators, with their DuckDB SQL."""

from __future__ import annotations

from . import analysis, changes, edits, explaining, histories, listings, matched, names, pages, places, profiles, queues, relations, scoring, signals, states, summaries  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES  # noqa: F401
