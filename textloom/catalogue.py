"""All driver queries of the library and their SQL, from the modules that register them."""

from __future__ import annotations

from textloom import queries, queries_chat, queries_eval, queries_raw, queries_rules, queries_sources, queries_stages, queries_store, queries_web  # noqa: F401
from textloom.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
