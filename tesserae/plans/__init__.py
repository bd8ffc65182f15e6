"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import checks, extracts, features, grids, land, overlays, raster, state, stores, tiles

_modules = (raster, grids, features, checks, state, tiles, land, stores, overlays, extracts)


def queries():
    return {name: query for m in _modules for name, (query, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _modules for name, (_, sql) in m.QUERIES.items() if sql}
