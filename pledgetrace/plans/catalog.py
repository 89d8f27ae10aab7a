"""All registered queries."""

from __future__ import annotations

from . import audit, grading, passages, rules, stores, streams, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
