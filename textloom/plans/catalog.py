"""All registered queries."""

from __future__ import annotations

from textloom.plans import analyses, checks, tables, texts  # noqa: F401
from textloom.plans.registry import QUERIES, SQL
from textloom.plans.texts import flagship

__all__ = ["QUERIES", "SQL", "flagship"]
