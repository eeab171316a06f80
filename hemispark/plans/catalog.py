"""All queries of the operators over the test tables, with the SQL they are compared with."""

from __future__ import annotations

from hemispark.plans import basic, front, linking, modelling  # noqa: F401 - they register their queries
from hemispark.plans.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
