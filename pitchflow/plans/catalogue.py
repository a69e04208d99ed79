"""All queries and their SQL."""

from __future__ import annotations

from . import events, physical, repairs, reports, sequential, threaded  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
