"""All queries of the engine by name, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.plans import queries as q
from flowlens.plans.sql import SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    hidden = {"flows", "predictions"}
    return {k: f for k, f in vars(q).items() if callable(f) and not k.startswith("_") and k not in hidden and k.islower() and getattr(f, "__module__", "") == q.__name__}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
