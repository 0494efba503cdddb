"""All queries of the library outside the corpus operators, with their SQL."""

from __future__ import annotations

from . import answers, audit, briefs, buyers, desk, ideas, keywords, pages, serp, state, text

_PARTS = (serp, keywords, text, pages, audit, answers, state, briefs, buyers, desk, ideas)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLE_SQL = {k: s for p in _PARTS for k, s in p.ORACLE_SQL.items()}
