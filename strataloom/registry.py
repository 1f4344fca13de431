"""All queries over the release model, by name."""

from __future__ import annotations

from .catalog import ORACLES, QUERIES, checks, network, planner, releases, scalars  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
