"""Fitted preprocessing: log1p of large counts, robust scaling, one-hot categories; learned on training rows only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import contracts
from flowlens.operators.clean import CATEGORICAL, feature_columns, numbers

#: Columns without negatives whose largest value exceeds this are log-transformed.
LARGE = 1e6
MISSING = "__MISSING__"


class Preprocessor:
    """fit() on rows whose split is train alone; transform() any rows. The state is plain JSON."""

    def __init__(self, categorical: tuple[str, ...] = CATEGORICAL):
        self.categorical = tuple(categorical)
        self.state: dict | None = None

    def fit(self, train: DataFrame, numeric: list[str] | None = None) -> Preprocessor:
        """Two aggregates over the training rows: extremes and categories, then exact quartiles."""
        if self.state is not None:
            raise contracts.ContractError("already fitted")
        contracts.require_columns(train, ["split", "record_id", *self.categorical])
        if [r[0] for r in train.select("split").distinct().limit(2).collect()] != ["train"]:
            raise contracts.ContractError("only training rows may be fitted")
        contracts.require_unique(train, ["record_id"], "repeated record ids")
        numeric = numeric or feature_columns(train, categorical=self.categorical)
        rows = numbers(train, numeric)
        first = rows.agg(
            *(x for i, c in enumerate(numeric) for x in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))),
            *(F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)))).alias(f"cat{i}") for i, c in enumerate(self.categorical)),
        ).first()
        logged = [c for i, c in enumerate(numeric) if first[f"lo{i}"] >= 0 and first[f"hi{i}"] > LARGE]
        scaled = rows.agg(*(F.percentile(self._logged(c, logged), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i, c in enumerate(numeric))).first()
        scale = {c: (scaled[f"q{i}"][1], (scaled[f"q{i}"][2] - scaled[f"q{i}"][0]) or 1.0) for i, c in enumerate(numeric)}
        self.state = {"numeric": numeric, "logged": logged, "scale": scale, "categories": {c: list(first[f"cat{i}"]) for i, c in enumerate(self.categorical)}}
        return self

    @staticmethod
    def _logged(c: str, logged: list[str]):
        return F.log1p(F.greatest(F.col(c), F.lit(0.0))) if c in logged else F.col(c)

    def _fitted(self) -> dict:
        if self.state is None:
            raise contracts.ContractError("not fitted")
        return self.state

    @property
    def output_columns(self) -> list[str]:
        s = self._fitted()
        return [*s["numeric"], *(f"{c}_{v}" for c in self.categorical for v in s["categories"][c])]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The kept columns, then numbers, then one-hot columns, as floats; unknown categories are all zeros."""
        s = self._fitted()
        rows = numbers(df, s["numeric"])
        value = lambda c: ((self._logged(c, s["logged"]) - s["scale"][c][0]) / s["scale"][c][1]).cast("float").alias(c)
        known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
        hot = [(known(c) == v).cast("float").alias(f"{c}_{v}") for c in self.categorical for v in s["categories"][c]]
        kept = [c for c in (keep if keep is not None else df.columns) if c not in s["numeric"] and c not in self.categorical]
        return rows.select(*kept, *map(value, s["numeric"]), *hot)

    def to_json(self) -> str:
        return json.dumps({"categorical": self.categorical, **self._fitted()}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Preprocessor:
        d = json.loads(text)
        out = cls(tuple(d.pop("categorical")))
        out.state = {**d, "scale": {k: tuple(v) for k, v in d["scale"].items()}}
        return out
