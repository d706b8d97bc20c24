"""Cleaning: names, repeated columns and rows, infinities, categories, labels and counters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import contracts
from flowlens.functions.scalars import category, finite_or_zero, to_number

#: Columns that are never features.
RESERVED = ("record_id", "source_file", "Stime", "Ltime", "Binary_Label", "attack_cat", "temporal_session", "split", "purged", "position", "block", "development_block", "fold", "role")
CATEGORICAL = ("proto", "state", "service")


def clean_names(df: DataFrame) -> DataFrame:
    """Stripped names; blanks, slashes and hyphens become underscores."""
    return df.toDF(*(re.sub(r"[ /-]", "_", c.strip()) for c in df.columns))


def drop_repeated_columns(df: DataFrame, mark: str = "duplicated") -> DataFrame:
    return df.drop(*(c for c in df.columns if mark in c))


def dedupe_rows(df: DataFrame, order: str | None = None) -> DataFrame:
    """Equal rows once. With an order column, which equal rows may differ in, the first by it stays."""
    if order is None:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c != order]
    return df.groupBy(*rest).agg(F.min(order).alias(order)).select(*df.columns)


def fill_invalid(df: DataFrame) -> DataFrame:
    """Nulls, NaN and infinities of numeric columns become 0; types stay."""
    def one(f: T.StructField):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return finite_or_zero(F.col(f.name)).cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, T.NumericType):
            return F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name)
        return F.col(f.name)

    return df.select(*(one(f) for f in df.schema.fields))


def clean_flows(df: DataFrame, counters: tuple[str, ...] = ("is_ftp_login", "ct_flw_http_mthd"), label: str = "label", cat: str = "attack_cat") -> DataFrame:
    """Categories normalised, binary label cast, equal rows dropped, then absent counters set to 0."""
    out = df.withColumn(cat, category(F.col(cat)))
    if label in df.columns:
        out = out.withColumn("Binary_Label", F.col(label).cast("int"))
    out = dedupe_rows(out)
    return out.fillna(dict.fromkeys((c for c in counters if c in df.columns), 0))


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles: numbers as they are if finite, text by its decimal or hexadecimal value, else 0."""
    types = dict(df.dtypes)
    return df.withColumns({c: to_number(F.col(c)) if types[c] == "string" else finite_or_zero(F.col(c)) for c in columns})


def feature_columns(df: DataFrame, reserved: tuple[str, ...] = RESERVED, categorical: tuple[str, ...] = CATEGORICAL) -> list[str]:
    """All columns that are neither reserved nor categorical, in their order."""
    return [c for c in df.columns if c not in reserved and c not in categorical]


def top_columns(ranking: list[str], variant: str) -> list[str]:
    """The features of a variant: all, or top_N."""
    if variant == "all":
        return list(ranking)
    n = int(variant.removeprefix("top_"))
    if not variant.startswith("top_") or not 0 < n <= len(ranking):
        raise contracts.ContractError(f"unknown variant {variant}")
    return ranking[:n]


def invalid_rows(df: DataFrame, needed: list[str]) -> DataFrame:
    """Rows of a payload that lack a needed value, with up to ten of the missing names."""
    missing = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in needed)), lambda x: x.isNotNull())
    return df.withColumn("missing", F.slice(missing, 1, 10)).where(F.size("missing") > 0)
