"""Registry of the queries and of the DuckDB SQL that checks them."""

from __future__ import annotations

from tidemark.plans import decisions, flows, market, mixing, more_market, more_text, policies, records, reports, scores, state, structure, text, tokens

_ALL = (text, more_text, mixing, records, tokens, state, market, more_market, structure, scores, policies, decisions, reports, flows)
QUERIES: dict = {k: f for m in _ALL for k, f in m.query.queries.items()}
ORACLE: dict[str, str] = {k: s for m in _ALL for k, s in m.query.oracle.items()}
