"""Prospective labels: the next onset after each quiet instant, over several horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens import contracts
from flowlens.functions.scalars import event_id
from flowlens.operators.onset import attack_states, five_numbers
from flowlens.operators.pieces import carried, numbered, time_piece


def derived_onsets(flows: DataFrame, prefix: str = "DERIVED-E") -> DataFrame:
    """Confirmed onsets as a catalog; the first instant of a file never is one."""
    found = attack_states(flows).where("confirmed_onset").select("source_file", F.col("Stime").alias("onset_stime"))
    found = numbered(found, "number", "onset_stime", [], ["source_file"])
    return found.select(event_id(prefix, F.col("number")).alias("event_id"), "source_file", "onset_stime")


def check_onsets(flows: DataFrame, onsets: DataFrame) -> None:
    """Every onset needs an instant with an attack."""
    known = attack_states(flows).where("attack_active").select("source_file", F.col("Stime").alias("onset_stime"))
    contracts.require_unique(onsets, ["source_file", "onset_stime"], "repeated onsets")
    contracts.require_empty(onsets.join(known, ["source_file", "onset_stime"], "left_anti"), "onsets without an attack")


def next_onsets(flows: DataFrame, onsets: DataFrame | None = None) -> DataFrame:
    """Quiet instants with the next onset strictly after them in their file: a forward as-of look-up.

    Onsets are instants themselves, so it is a window over instants, taken before quiet ones are filtered; no join
    of ranges. It looks ahead in a piece of the file's time, and else to the first onset of a later piece.
    onsets: unset, the derived ones.
    """
    units = attack_states(flows)
    if onsets is None:
        marked = units.withColumn("onset_id", F.when(F.col("confirmed_onset"), F.lit("")))
    else:
        check_onsets(flows, onsets)
        marked = units.join(onsets.select("source_file", F.col("onset_stime").alias("Stime"), F.col("event_id").alias("onset_id")), ["source_file", "Stime"], "left")
    marked = marked.withColumn("piece", time_piece(F.col("Stime"))).withColumn("onset", F.when(F.col("onset_id").isNotNull(), F.struct(F.col("Stime").alias("at"), F.col("onset_id").alias("id"))))
    firsts = carried(marked.groupBy("source_file", "piece").agg(F.min("onset").alias("first")), ["source_file"], __later=("after", F.first("first", ignorenulls=True)))
    ahead = Window.partitionBy("source_file", "piece").orderBy("Stime").rowsBetween(1, Window.unboundedFollowing)
    nearest = F.coalesce(F.min("onset").over(ahead), "__later")
    marked = marked.join(firsts, ["source_file", "piece"])
    out = marked.withColumn("nearest", nearest).where("not attack_active")
    return out.select("source_file", "Stime", F.col("nearest.at").alias("next_onset"), F.col("nearest.id").alias("next_event_id"))


def prospective_labels(flows: DataFrame, horizons: list[int], onsets: DataFrame | None = None) -> DataFrame:
    """One row per quiet instant and horizon: is there an onset within the horizon, and in how many seconds is the next?

    The look-up is done once; horizons are a literal array that is exploded.
    """
    if not horizons or len(set(horizons)) != len(horizons) or min(horizons) <= 0:
        raise contracts.ContractError("horizons must be distinct positive integers")
    seconds = F.col("next_onset") - F.col("Stime")
    each = next_onsets(flows, onsets).withColumn("seconds_to_attack", seconds)
    each = each.select("*", F.explode(F.array(*map(F.lit, sorted(horizons)))).alias("horizon"))
    return each.select("source_file", "Stime", "horizon", F.coalesce((F.col("seconds_to_attack") <= F.col("horizon")).cast("int"), F.lit(0)).alias("future_attack"), "seconds_to_attack", "next_onset", "next_event_id")


def label_diagnostics(labels: DataFrame) -> DataFrame:
    """Per horizon: rows, positives, negatives, prevalence, events reached and a summary of seconds among positives."""
    hit = F.col("future_attack") == 1
    per = labels.groupBy("horizon").agg(
        F.count("*").alias("n_rows"), F.count_if(hit).alias("positives"), F.count_if(~hit).alias("negatives"), F.round(F.avg("future_attack"), 6).alias("prevalence"),
        F.count_distinct(F.when(hit, F.struct("source_file", "next_onset"))).alias("events"),
        F.count_distinct(F.when(F.col("next_onset").isNotNull(), F.struct("source_file", "next_onset"))).alias("events_ahead"),
    )
    seconds = five_numbers(labels.where(hit), "seconds_to_attack", "horizon").drop("n")
    return per.join(seconds, "horizon", "left").withColumn("coverage", F.round(F.col("events") / F.greatest(F.col("events_ahead"), F.lit(1)), 6))


def label_examples(labels: DataFrame) -> DataFrame:
    """The first positive and the first negative row of each horizon, with a check of the rule."""
    first = F.struct("source_file", "Stime")
    found = labels.groupBy("horizon", "future_attack").agg(F.min_by(F.struct("source_file", "Stime", "seconds_to_attack"), first).alias("row"))
    obeys = F.coalesce(F.col("row.seconds_to_attack") <= F.col("horizon"), F.lit(False)) == (F.col("future_attack") == 1)
    return found.select("horizon", "future_attack", "row.source_file", "row.Stime", "row.seconds_to_attack", obeys.alias("obeys_rule"))


def with_features(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Labels with the features of their instant; features must be unique by instant (many to one)."""
    contracts.require_unique(features, ["source_file", "Stime"], "repeated instants among the features")
    return labels.join(features, ["source_file", "Stime"], "left")


def at_instants(labels: DataFrame, instants: DataFrame) -> DataFrame:
    """The labels whose instant is among the given ones."""
    return labels.join(instants, ["source_file", "Stime"], "left_semi")
