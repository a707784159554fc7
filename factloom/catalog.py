"""All registered queries."""

from __future__ import annotations

from .plans import checks, core, ledger, signals  # noqa: F401  register
from .plans.registry import ORACLES, QUERIES

FLAGSHIP = "pricing_rollup"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
