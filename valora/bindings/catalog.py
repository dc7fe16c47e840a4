"""All registered queries and checks."""

from __future__ import annotations

from valora.bindings import (
    cohort_stats,
    intake,
    meanings,
    offers_pairs,
    procurement,
    questions,
    text_prices,
    web_pages,
)

MODULES = (
    text_prices,
    offers_pairs,
    intake,
    meanings,
    questions,
    cohort_stats,
    procurement,
    web_pages,
)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.catalog.queries.items()}


def checks() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.catalog.checks.items()}
