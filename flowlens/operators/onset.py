"""Attack runs: instants, running attack ends, onsets and the catalog of runs (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flowlens import contracts
from flowlens.functions.scalars import event_id, unix_to_iso
from flowlens.operators.pieces import carried, numbered, time_piece, with_row_before


def _file() -> WindowSpec:
    return Window.partitionBy("source_file")


def instants(flows: DataFrame) -> DataFrame:
    """One row per (source_file, Stime): flow and attack counts, latest end, latest attack end."""
    contracts.require_columns(flows, ["source_file", "Stime", "Ltime", "Binary_Label"])
    attack_end = F.when(F.col("Binary_Label") == 1, F.col("Ltime"))
    return flows.groupBy("source_file", "Stime").agg(
        F.count("*").alias("flow_count"), F.sum("Binary_Label").cast("bigint").alias("attack_count"),
        F.max("Ltime").alias("max_ltime"), F.max(attack_end).alias("max_attack_ltime"),
    )


def attack_states(flows: DataFrame) -> DataFrame:
    """Instants with attack_active (some attack begun so far has not ended), the state before, onsets and run numbers.

    An instant is active as long as the running maximum of attack ends reaches it. The first instant of a file,
    if active, starts a run but is a boundary, not a confirmed onset. Windows run in pieces of a file's time; the
    end reached, the last instant and its state, and the runs begun are carried over the borders.
    """
    inst = instants(flows).withColumn("piece", time_piece(F.col("Stime")))
    ends = inst.groupBy("source_file", "piece").agg(F.max("max_attack_ltime").alias("reach"), F.max("Stime").alias("last"))
    upto = Window.partitionBy("source_file").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("upto", F.max("reach").over(upto)).withColumn("last_active", F.coalesce(F.col("upto") >= F.col("last"), F.lit(False)))
    step = Window.partitionBy("source_file").orderBy("piece")
    ends = ends.select("source_file", "piece", F.lag("upto").over(step).alias("__reach"), F.lag("last").over(step).alias("__last"), F.lag("last_active").over(step).alias("__active"))
    order = Window.partitionBy("source_file", "piece").orderBy("Stime")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.greatest(F.max("max_attack_ltime").over(so_far), "__reach")
    out = inst.join(ends, ["source_file", "piece"]).withColumn("attack_active", F.coalesce(reach >= F.col("Stime"), F.lit(False)))
    out = out.withColumn("previous_active", F.coalesce(F.lag("attack_active").over(order), "__active")).withColumn("previous_stime", F.coalesce(F.lag("Stime").over(order), "__last"))
    active, before = F.col("attack_active"), F.col("previous_active")
    out = out.withColumn("confirmed_onset", active & F.coalesce(~before, F.lit(False))).withColumn("boundary_attack", active & before.isNull())
    out = out.withColumn("run_start", F.col("confirmed_onset") | F.col("boundary_attack")).drop("__reach", "__last", "__active")
    starts = out.groupBy("source_file", "piece").agg(F.count_if("run_start").alias("n"))
    starts = carried(starts, ["source_file"], __runs=("before", F.sum("n")))
    number = F.coalesce("__runs", F.lit(0)) + F.sum(F.col("run_start").cast("int")).over(so_far)
    return out.join(starts, ["source_file", "piece"]).withColumn("run", F.when(active, number)).drop("__runs", "piece")


def run_catalog(flows: DataFrame, prefix: str = "FLOW-E") -> DataFrame:
    """One row per attack run, with an event id in order of file, onset and run."""
    s = attack_states(flows).where("attack_active")
    mixed = (F.col("attack_count") > 0) & (F.col("attack_count") < F.col("flow_count"))
    runs = s.groupBy("source_file", "run").agg(
        F.min("Stime").alias("onset_stime"), F.max("Stime").alias("last_stime"), F.max("max_attack_ltime").alias("end_ltime"),
        F.min_by("previous_stime", "Stime").alias("previous_stime"), F.min_by("confirmed_onset", "Stime").alias("confirmed_onset"),
        F.count("*").alias("bins"), F.sum(mixed.cast("int")).cast("bigint").alias("mixed_bins"),
        F.sum("flow_count").alias("flow_count"), F.sum("attack_count").alias("attack_count"),
    )
    return numbered(runs, "number", "onset_stime", ["run"], ["source_file"]).select(
        event_id(prefix, F.col("number")).alias("event_id"), "source_file", "run", "onset_stime", "last_stime", "end_ltime", "previous_stime",
        (F.col("onset_stime") - F.col("previous_stime")).alias("gap_seconds"), (F.col("last_stime") - F.col("onset_stime")).alias("span_seconds"),
        unix_to_iso(F.col("onset_stime")).alias("onset_utc"), "confirmed_onset", "bins", "mixed_bins", "flow_count", "attack_count",
    )


def run_categories(flows: DataFrame, prefix: str = "FLOW-E") -> DataFrame:
    """Per run the primary attack category (most flows, ties by name) and all categories joined by a bar."""
    runs = attack_states(flows).where("attack_active").select("source_file", "Stime", "run")
    attacks = flows.where("Binary_Label = 1").select("source_file", "Stime", "attack_cat")
    per = attacks.join(runs, ["source_file", "Stime"]).groupBy("source_file", "run", "attack_cat").agg(F.count("*").alias("n"))
    found = per.groupBy("source_file", "run").agg(
        F.min_by("attack_cat", F.struct(-F.col("n"), "attack_cat")).alias("primary_category"),
        F.max("n").alias("primary_flows"),
        F.array_join(F.array_sort(F.collect_list("attack_cat")), "|").alias("categories"),
    )
    return run_catalog(flows, prefix).select("event_id", "source_file", "run").join(found, ["source_file", "run"])


def onset_diagnostics(flows: DataFrame) -> DataFrame:
    """Per file: runs, confirmed onsets, boundary attacks, mixed instants and flows of attack runs."""
    return run_catalog(flows).groupBy("source_file").agg(
        F.count("*").alias("runs"), F.count_if("confirmed_onset").alias("confirmed"), F.count_if(~F.col("confirmed_onset")).alias("boundary"),
        F.sum("mixed_bins").alias("mixed_bins"), F.sum("attack_count").alias("attack_count"),
    )


def five_numbers(df: DataFrame, column: str, *by: str) -> DataFrame:
    """count, min, median, p95 (linear) and max of a column; nulls when nothing is there."""
    x = F.col(column).cast("double")
    pick = lambda q: F.round(F.percentile(x, q), 6)
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.min(x).alias("min"), pick(0.5).alias("median"), pick(0.95).alias("p95"), F.max(x).alias("max"))


def raw_transitions(flows: DataFrame, *by: str) -> DataFrame:
    """Benign-to-attack transitions of neighbouring rows in input order, per file."""
    rows = with_row_before(flows, F.col("Binary_Label"), ["source_file"], "record_id", "before")
    return rows.select("source_file", ((F.col("Binary_Label") == 1) & (F.col("before") == 0)).alias("t")).groupBy("source_file").agg(F.count_if("t").alias("transitions"))


def backward_steps(flows: DataFrame) -> DataFrame:
    """Rows per file whose Stime lies before that of the row ahead of them in input order."""
    rows = with_row_before(flows, F.col("Stime"), ["source_file"], "record_id", "before")
    return rows.select("source_file", (F.col("Stime") < F.col("before")).alias("b")).groupBy("source_file").agg(F.count_if("b").alias("backward_steps"))
