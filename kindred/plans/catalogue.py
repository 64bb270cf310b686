"""All queries over the driver's tables."""

from __future__ import annotations

from kindred.plans import actions, grouping, imaging, listing, matching  # noqa: F401
from kindred.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
