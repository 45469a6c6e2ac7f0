"""All queries of the core with their SQL."""

from __future__ import annotations

from . import analytics, balance, clusters, files, graphs, mining, streams

_PARTS = (analytics, balance, mining, graphs, streams, clusters, files)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}
