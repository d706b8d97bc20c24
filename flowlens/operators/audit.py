"""Temporal audit of a flow table: profile, histograms, per-file figures and readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import contracts
from flowlens.functions.scalars import unix_to_iso
from flowlens.operators.onset import backward_steps


def profile(flows: DataFrame) -> DataFrame:
    """One row: extent, duration statistics and suspicious counts; one aggregate."""
    contracts.require_columns(flows, ["source_file", "Stime", "Ltime", "Binary_Label"])
    length = (F.col("Ltime") - F.col("Stime")).cast("double")
    low, high = contracts.TIME_RANGE
    return flows.agg(
        F.count("*").alias("n_rows"), F.count_distinct("source_file").alias("files"),
        F.min("Stime").alias("min_stime"), F.round(F.median(F.col("Stime").cast("double")), 6).alias("median_stime"), F.max("Stime").alias("max_stime"),
        F.max("Ltime").alias("max_ltime"), unix_to_iso(F.min("Stime")).alias("first_utc"), unix_to_iso(F.max("Stime")).alias("last_utc"),
        F.round(F.avg(length), 6).alias("mean_duration"), F.round(F.median(length), 6).alias("median_duration"), F.max(length).alias("max_duration"),
        F.count_if(length < 0).alias("negative_durations"), F.count_if(length == 0).alias("zero_durations"),
        F.count_if(~F.col("Stime").between(low, high)).alias("implausible_times"), F.count_if(F.col("Stime").isNull()).alias("missing_times"),
        F.sum("Binary_Label").cast("bigint").alias("attacks"),
    )


def histogram(flows: DataFrame, column: str) -> DataFrame:
    return flows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def per_file(flows: DataFrame) -> DataFrame:
    """Rows, extent, backward steps, ends before starts and labels of each file."""
    per = flows.groupBy("source_file").agg(
        F.count("*").alias("n_rows"), F.min("Stime").alias("min_stime"), F.max("Stime").alias("max_stime"),
        F.count_if(F.col("Ltime") < F.col("Stime")).alias("ends_before_start"), F.sum("Binary_Label").cast("bigint").alias("attacks"),
    )
    return per.join(backward_steps(flows), "source_file")


def readiness(flows: DataFrame) -> DataFrame:
    """One row: ready, and the reasons that stand against it."""
    p = profile(flows)
    reasons = F.filter(
        F.array(
            F.when(F.col("n_rows") == 0, "no rows"), F.when(F.col("negative_durations") > 0, "negative durations"),
            F.when(F.col("implausible_times") > 0, "implausible times"), F.when(F.col("missing_times") > 0, "missing times"),
            F.when(F.coalesce(F.col("attacks"), F.lit(0)).isin(0) | (F.col("attacks") == F.col("n_rows")), "a single class"),
        ), lambda x: x.isNotNull(),
    )
    return p.select((F.size(reasons) == 0).alias("ready"), F.array_join(reasons, "|").alias("reasons"))
