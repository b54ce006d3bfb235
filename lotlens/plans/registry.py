"""Every registered query of the listing operators and its SQL twin."""

from __future__ import annotations

from . import queries_maintenance, queries_photos, queries_sales, queries_text  # noqa: F401
from .register import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
