"""Queries for the engine's own operators and the SQL each is held against."""

from __future__ import annotations

from .plans import analysis, linking, modelling, queries, records
from .plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
MODULES = {name: f.module for name, f in QUERIES.items()}
