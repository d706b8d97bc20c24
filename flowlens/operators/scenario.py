"""Flood scenarios: heuristic scores, correctness and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.scalars import flood_score, safe_divide, severity_scenario
from flowlens.operators.pieces import numbered


def scored(samples: DataFrame) -> DataFrame:
    """samples with prediction, confidence, triggered signals, severity and binary correctness."""
    out = samples.withColumns(flood_score())
    out = out.withColumn("severity", severity_scenario(F.col("prediction"), F.col("confidence")))
    hit = (F.col("prediction") != "Normal Traffic").cast("int")
    return out.withColumn("predicted_label", hit).withColumn("correct", hit == F.col("Binary_Label"))


def with_times(samples: DataFrame, start, order: str, seconds: int = 5) -> DataFrame:
    """Event times `seconds` apart over all samples, in the order of a column of unique numbers."""
    out = numbered(samples, "__place", order, [])
    return out.withColumn("timestamp", start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("__place") - 1) * seconds)).drop("__place")


def group_summary(rows: DataFrame) -> DataFrame:
    """Per traffic group: rows, correct ones, mean confidence and severities."""
    return rows.groupBy("traffic_group").agg(
        F.count("*").alias("n_rows"), F.count_if("correct").alias("n_correct"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        *(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "safe")),
    )


def summary(rows: DataFrame) -> DataFrame:
    """One row: the binary confusion counts and accuracy."""
    t, q = F.col("Binary_Label") == 1, F.col("predicted_label") == 1
    out = rows.agg(F.count("*").alias("n_rows"), F.count_if(t & q).alias("tp"), F.count_if(~t & ~q).alias("tn"), F.count_if(~t & q).alias("fp"), F.count_if(t & ~q).alias("fn"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return out.withColumn("accuracy", F.round(safe_divide(F.col("tp") + F.col("tn"), F.col("n_rows")), 6))
