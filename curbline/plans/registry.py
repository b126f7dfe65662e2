"""All registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from . import queries_names, queries_raster, queries_tables  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
