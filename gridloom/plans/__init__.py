"""Queries: the operators applied to raster views of the given tables."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}
for _name in ("masks", "rules", "grids", "stats", "predict", "chips", "training", "stored"):
    _module = import_module(f"{__name__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
