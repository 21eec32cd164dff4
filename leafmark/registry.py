"""All registered queries of the review engine and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES (key -> function of spark, sf_dir) and ORACLE (key -> DuckDB SQL).
MODULES: list[str] = [
    "leafmark.operators.rankings",
    "leafmark.functions.queries",
    "leafmark.functions.signals",
    "leafmark.operators.review",
    "leafmark.operators.checked",
    "leafmark.operators.reports",
    "leafmark.operators.sketches",
    "leafmark.operators.records",
    "leafmark.operators.pages",
    "leafmark.operators.doc_codes",
    "leafmark.operators.lines",
    "leafmark.operators.forms",
    "leafmark.operators.matching",
    "leafmark.operators.similar_pages",
    "leafmark.streaming.jobs",
    "leafmark.sources.queries",
]


def _all(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        entries = getattr(import_module(name), attribute)
        if twice := found.keys() & entries.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        found |= entries
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
