"""Registry of the library's queries and their SQL oracles."""

from __future__ import annotations

from tideline.plans import catalog_core, catalog_files, catalog_jobs, catalog_more, catalog_plans, catalog_process  # noqa: F401
from tideline.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
