"""All registered queries of the library and their SQL."""

from __future__ import annotations

from scholarlake.plans import adjust, builds, evaluate, greedy, interest, lookups, phrases, recommend, registry, retrieval, search, stores, streams  # noqa: F401

FLAGSHIP = "q1_boolean_search"


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
