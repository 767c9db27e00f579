"""Registered queries and their SQL."""

from __future__ import annotations

from . import oracles, queries

QUERIES = {name: getattr(queries, name) for name in oracles.ORACLES}
ORACLES = oracles.ORACLES
