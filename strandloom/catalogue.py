"""Registered queries and their SQL oracles."""

from __future__ import annotations

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
