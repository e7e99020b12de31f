"""All registered queries and their oracles."""

from __future__ import annotations

from spanmill.plans import catalogue, composed, evaluation, kernels, live, texts, windows

_PARTS = (windows, catalogue, evaluation, texts, kernels, live, composed)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
