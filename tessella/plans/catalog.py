"""The registry behind ``__spark_entry__``."""

from __future__ import annotations

from tessella.plans import datasets, evaluation, files, histories, models, pairing, releases, reporting, tiling  # noqa: F401
from tessella.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
