"""Queries over the driver tables, by name, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from . import evaluation_queries, policy_queries, text_queries

_MODULES = (text_queries, evaluation_queries, policy_queries)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
