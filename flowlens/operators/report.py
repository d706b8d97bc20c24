"""Report tables made from metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def importance_table(importances: DataFrame, used: DataFrame) -> DataFrame:
    """feature, importance, rank, and whether any configuration uses it."""
    rank = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))  # a row per feature
    out = importances.withColumn("rank", rank).join(used.select("feature").distinct().withColumn("used", F.lit(True)), "feature", "left")
    return out.withColumn("used", F.coalesce("used", F.lit(False)))


def development_vs_test(board: DataFrame, tested: DataFrame) -> DataFrame:
    """Per tested configuration its development mean, its test value and the difference."""
    out = tested.select("algorithm", "variant", F.col("f1").alias("test_f1")).join(board.select("algorithm", "variant", "f1_mean"), ["algorithm", "variant"])
    return out.withColumn("difference", F.round(F.col("test_f1") - F.col("f1_mean"), 6))


def model_table(tested: DataFrame) -> DataFrame:
    return tested.select("algorithm", "variant", "f1", "precision", "recall", "fpr", "roc_auc", "average_precision")


def confusion_table(tested: DataFrame) -> DataFrame:
    return tested.select("algorithm", "variant", "tn", "fp", "fn", "tp")


def markdown(table: DataFrame) -> str:
    """A small table as Markdown."""
    rows = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join([*rows, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in table.toLocalIterator())]) + "\n"
