"""Queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import frame_queries, sql_queries

QUERIES: dict = {**sql_queries.QUERIES, **frame_queries.QUERIES}
ORACLES: dict[str, str] = {**sql_queries.ORACLES, **frame_queries.ORACLES}
