"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics are Catalyst expressions over the whole text. The two classes' means and second moments are one
distributed aggregate; the driver sees 2 x (d + d * d) sums. Each covariance is shrunk towards its diagonal and
towards the pooled one, its Cholesky factor is computed once and shipped; a score is the logistic of the
difference of the two Mahalanobis log-densities plus the log prior odds.

Null and empty texts get the statistics of an empty text and a score like any other. Unlabelled rows, and rows
whose label is null, teach nothing. If a class has no row, the score is the share of label 1 (0.5 without any
label). Labels repeated for one id count as often as they are given. Repeated rows are judged on their own and get equal
scores; ties need no order. A text of any length is one row of the JVM, split into lines and words (some 5 times its
size). An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import common

#: Patterns whose matches are counted; the statistic is the logarithm of their rate.
COUNTED = {
    "marks": r"[#$%&*]", "bars": r"\|", "shouts": r"!", "upper": r"\p{Lu}", "letters": r"\p{L}", "digits": r"\p{N}", "stops": r"[.?]", "lines": r"\n",
}
FEATURES = ["size", "word_length", *COUNTED, "line_repeats", "word_variety"]


def statistics(text) -> list:
    """Transformed statistics of a text column, one expression per entry of FEATURES."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    words = F.regexp_count(t, F.lit(common.NON_WHITE))
    rate = lambda x: F.log((x + 0.5) / (n + 20.0))
    lines = F.split(t, "\n")
    vocabulary = F.split(common.ascii_lower(t), " ")
    return [
        F.log1p(n.cast("double")),
        F.log((n + 1.0) / (words + 1.0)),
        *(rate(F.regexp_count(t, F.lit(p))) for p in COUNTED.values()),
        F.log((F.size(F.array_distinct(lines)) + 1.0) / (F.size(lines) + 1.0)),
        F.log((F.size(F.array_distinct(vocabulary)) + 1.0) / (F.size(vocabulary) + 1.0)),
    ]


class Discriminant:
    """Class means, shrunk covariances and their cached Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float, ridge: float):
        self.total = sum(m[0] for m in moments.values())
        self.prior = moments[1][0] / self.total if self.total and 1 in moments else 0.5 if not self.total else 0.0
        self.parts = {}
        if len(moments) < 2:
            return
        means = {k: s / n for k, (n, s, _) in moments.items()}
        own = {k: q / n - np.outer(means[k], means[k]) for k, (n, _, q) in moments.items()}
        pooled = sum(own[k] * moments[k][0] for k in own) / self.total
        for k, c in own.items():
            # Few rows lean more on the pooled covariance.
            lean = min(1.0, shrink + len(c) / (len(c) + moments[k][0]))
            c = (1 - lean) * c + lean * pooled
            c = (1 - shrink) * c + shrink * np.diag(np.diag(c)) + ridge * np.eye(len(c))
            factor = np.linalg.cholesky(c)
            self.parts[k] = (means[k], np.linalg.inv(factor), -np.log(np.diag(factor)).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        if len(self.parts) < 2:
            return np.full(len(x), self.prior)
        density = {k: h - 0.5 * (((x - m) @ inv.T) ** 2).sum(1) for k, (m, inv, h) in self.parts.items()}
        odds = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def fit(rows: DataFrame, shrink: float = 0.05, ridge: float = 1e-3) -> Discriminant:
    """rows: columns x (array of statistics) and label (0 or 1). One aggregate; its result does not grow with the rows."""
    d = len(FEATURES)
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d)]
    moments = {}
    for r in rows.where("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect():
        q = np.array([[r[f"q{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        moments[int(r["label"])] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), q)
    return Discriminant(moments, shrink, ridge)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, shrink: float = 0.05) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Learns from labelled rows outside the held-out fold."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.array(*statistics(F.col(text_col))).alias("x"))
    x = common.stored(x.withColumn("held_out", common.remainder(F.col("doc_id"), folds) == held), "statistics")
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    model = fit(x.where(~F.col("held_out")).join(marks, "doc_id").select("x", "label"), shrink)

    @F.pandas_udf("double")
    def scored(rows: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))))

    out = x.select("doc_id", "held_out", scored("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
