"""Column contracts and assertions that the operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The total order of flows; Spark rows have none of their own.
ORDER = ("Stime", "Ltime", "source_file", "record_id")
#: Plausible range of Unix seconds: 2000-01-01 to 2100-01-01.
TIME_RANGE = (946_684_800, 4_102_444_800)
BENIGN = "BENIGN"


class ContractError(ValueError):
    """The input breaks an operator's contract."""


class InvalidFeatures(ContractError):
    """A request lacks features or has values that are not numbers (422)."""

    code = "INVALID_FEATURES"


class ModelNotLoaded(RuntimeError):
    """No artifact is there (503)."""

    code = "MODEL_NOT_LOADED"


class PredictionFailed(RuntimeError):
    """Scoring failed (500)."""

    code = "PREDICTION_ERROR"


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def forbid_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Reserved names, or targets that must not be among features."""
    found = [c for c in columns if c in df.columns]
    if found:
        raise ContractError(f"columns that must not be there: {', '.join(found)}")
    return df


def require_empty(df: DataFrame, message: str) -> None:
    """Fail with the message and up to three offending rows."""
    rows = df.limit(3).collect()
    if rows:
        raise ContractError(f"{message}: {[r.asDict() for r in rows]}")


def require_unique(df: DataFrame, keys: Iterable[str], message: str = "repeated keys") -> DataFrame:
    require_empty(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), message)
    return df


def require_schema(df: DataFrame, other: DataFrame) -> DataFrame:
    if df.schema != other.schema:
        raise ContractError("schemas differ")
    return df


def require_disjoint(a: DataFrame, b: DataFrame, column: str) -> None:
    """No value of the column is in both."""
    require_empty(a.select(column).join(b.select(column), column, "left_semi"), f"{column} in both")
