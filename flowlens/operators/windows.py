"""Count-based sliding windows of rows inside contiguous blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector

from flowlens.operators.pieces import ROWS, carried, with_overlap


def _pieces(blocked: DataFrame, width: int) -> DataFrame:
    """Pieces of positions that repeat the width - 1 rows before them, with each row's rank in its block (rank)."""
    first = blocked.groupBy("block").agg(F.min("position").alias("__first"))
    ranked = blocked.join(first, "block").withColumn("rank", F.col("position") - F.col("__first") + 1).drop("__first")
    return with_overlap(ranked, F.col("position"), ROWS, width - 1)


def _own(width: int):
    return Window.partitionBy("block", "piece").orderBy("position").rowsBetween(-(width - 1), 0)


def window_manifest(blocked: DataFrame, width: int) -> DataFrame:
    """One row per window of `width` rows: dense window_id in row order, ids, target (the last row) and extent.

    blocked needs position and block. Ids are ranks inside a block plus the windows of earlier blocks; blocks are
    cut into pieces, so that a long one is many tasks'.
    """
    back = _own(width)
    out = _pieces(blocked, width).select(
        "block", "temporal_session", "source_file", "own", F.collect_list("record_id").over(back).alias("record_ids"), F.col("rank").alias("__rank"),
        F.first("Stime").over(back).alias("start_stime"), F.last("Ltime").over(back).alias("end_ltime"), F.col("record_id").alias("target_record_id"), F.col("Binary_Label").alias("target_label"),
    ).where(F.col("own") & (F.col("__rank") >= width)).drop("own")
    # Blocks go by thousands first, so that their many small counts are not summed in one task.
    n = blocked.groupBy("block").agg(F.greatest(F.lit(0), F.count("*") - (width - 1)).alias("n")).withColumn("piece", F.floor(F.col("block") / 1000))
    ahead = carried(n.groupBy("piece").agg(F.sum("n").alias("n")), [], __before=("before", F.sum("n")))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("piece").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = n.withColumn("__inside", inside).join(ahead, "piece").select("block", (F.coalesce("__before", F.lit(0)) + F.col("__inside")).alias("__ahead"))
    out = out.join(ahead, "block")
    return out.withColumn("window_id", F.col("__ahead") + F.col("__rank") - width).drop("__rank", "__ahead")


def window_columns(manifest: DataFrame, width: int) -> DataFrame:
    """The ids as columns record_id_t00, record_id_t01, ..."""
    return manifest.select("*", *(F.col("record_ids")[i].alias(f"record_id_t{i:02d}") for i in range(width))).drop("record_ids")


def window_counts(rows: DataFrame, width: int, batch: int, *by: str) -> DataFrame:
    """Rows, windows max(0, n - width + 1) and batches per group."""
    windows = F.greatest(F.lit(0), F.count("*") - (width - 1))
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), windows.alias("windows"), F.ceil(windows / batch).alias("batches"))


def realized_windows(blocked: DataFrame, features: list[str], width: int, vector: bool = False) -> DataFrame:
    """The windows' feature values: one array of arrays (width x features) and its flattening, oldest row first.

    Select the features before: each row is held `width` times.
    """
    row = F.array(*(F.col(f).cast("float") for f in features))
    out = _pieces(blocked, width).select("block", "own", "rank", F.col("record_id").alias("target_record_id"), F.col("Binary_Label").alias("target_label"), F.collect_list(row).over(_own(width)).alias("window"))
    out = out.where(F.col("own") & (F.col("rank") >= width)).drop("own", "rank").withColumn("flat", F.flatten("window"))
    return out.withColumn("features", array_to_vector("flat")) if vector else out


def window_means(blocked: DataFrame, features: list[str], width: int) -> DataFrame:
    """Mean of each feature over each window; running frames, nothing is copied."""
    means = [F.round(F.avg(f).over(_own(width)), 6).alias(f"mean_{f}") for f in features]
    out = _pieces(blocked, width).select("block", "own", "rank", F.col("record_id").alias("target_record_id"), *means)
    return out.where(F.col("own") & (F.col("rank") >= width)).drop("own", "rank")


def differences(realized: DataFrame, manifest: DataFrame) -> DataFrame:
    """Targets and labels that only one of the two has; none if the windows are those of the manifest."""
    a, b = (d.select("block", "target_record_id", "target_label") for d in (realized, manifest))
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def window_rows(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that a manifest names: window_id, step (0 is the oldest) and all columns of rows; one join by id."""
    named = manifest.select("window_id", F.posexplode("record_ids").alias("step", "record_id"))
    return named.join(rows, "record_id")
