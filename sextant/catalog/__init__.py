"""The catalog of registered queries."""

from __future__ import annotations

from importlib import import_module

from sextant.catalog.registry import ORACLES, QUERIES

MODULES = (
    "texts",
    "tabular",
    "chunks",
    "lexicon",
    "searches",
    "hits",
    "quality",
    "files",
    "records",
    "stores",
    "streams",
)


def load():
    """Import every catalog module and return (queries, oracles)."""
    for module in MODULES:
        import_module(f"sextant.catalog.{module}")
    return QUERIES, ORACLES
