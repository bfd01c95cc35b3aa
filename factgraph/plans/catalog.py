"""All registered queries of the reference's operators."""

from __future__ import annotations

from factgraph.plans import code, facts, relations, rules  # noqa: F401  (they register their queries)
from factgraph.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
