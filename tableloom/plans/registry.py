"""Every registered query of the library proper, with the SQL that must give the same rows."""

from __future__ import annotations

from . import catalog_on_tables, functions_on_tables, incremental_on_tables, pipelines, quality, relational
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalog_on_tables", "functions_on_tables", "incremental_on_tables", "pipelines", "quality", "relational"]
