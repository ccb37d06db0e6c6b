"""Queries of the text problems and their SQL."""

from __future__ import annotations

from folioflow.llm import q_contamination, q_encodings, q_lookalikes, q_packing, q_scans, q_splitting, q_subjects

_MODULES = [q_encodings, q_lookalikes, q_scans, q_splitting, q_packing, q_contamination, q_subjects]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
