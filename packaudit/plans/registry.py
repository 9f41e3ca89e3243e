"""All queries of the library outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from packaudit.plans import evidence, extraction, finance, layouts, packages, rating, records, retrieval, summaries, texts

MODULES = (finance, packages, texts, records, evidence, extraction, summaries, layouts, retrieval, rating)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
