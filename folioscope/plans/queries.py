"""All named queries of the library and their SQL twins; importing this registers every catalogue."""

from __future__ import annotations

from folioscope.plans import catalog, catalog_operators, catalog_text

QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE

__all__ = ["ORACLE", "QUERIES", "catalog_operators", "catalog_text"]
