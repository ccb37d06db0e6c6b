"""All queries outside the optional subpackage, with their SQL."""

from __future__ import annotations

from folioflow.plans import checks, core, corpus, gazette, pages, structure

_MODULES = [checks, core, corpus, gazette, pages, structure]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
