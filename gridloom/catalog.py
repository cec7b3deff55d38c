"""All queries of the raster library by name, and the SQL to hold them against."""

from __future__ import annotations

from .plans import QUERIES, ORACLES

__all__ = ["ORACLES", "QUERIES"]
