"""Expanding folds with purge and embargo, and the event-anchored purged split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import contracts
from flowlens.operators.pieces import numbered


def fold_boundaries(positioned: DataFrame, folds: int) -> list[int]:
    """First positions of blocks 1 to folds: even parts of the rows up to the last attack, each moved on to the next time.

    positioned: rows with position. A few look-ups by position; the rows stay where they are.
    """
    stop = positioned.where("Binary_Label = 1").agg(F.max("position")).first()[0]
    if stop is None:
        raise contracts.ContractError("no attack to place folds by")
    stop += 1
    at = [min(max(1, stop * i // (folds + 1)), stop - 1) for i in range(1, folds + 1)]
    times = {r["position"]: r["Stime"] for r in positioned.where(F.col("position").isin(at)).select("position", "Stime").collect()}
    row = positioned.agg(*(F.count_if(F.col("Stime") <= times[p]).alias(f"b{i}") for i, p in enumerate(at))).first()
    out = [row[f"b{i}"] for i in range(folds)]
    if len(set(out)) != folds or max(out) >= stop:
        raise contracts.ContractError("fold boundaries coincide or leave no attack behind")
    return out


def purged_blocks(positioned: DataFrame, boundaries: list[int], width: int) -> DataFrame:
    """rows with development_block and purged.

    At each boundary the last width - 1 rows before it go, and after it the first width - 1 rows, or more: all
    whose time does not exceed the latest end of any row before the purged ones (also of rows that an earlier
    boundary has purged).
    """
    out = positioned.withColumn("development_block", sum((F.when(F.col("position") >= b, 1).otherwise(0) for b in boundaries), F.lit(0)))
    latest = positioned.agg(*(F.max(F.when(F.col("position") < b - (width - 1), F.col("Ltime"))).alias(f"e{i}") for i, b in enumerate(boundaries))).first()
    embargo = positioned.agg(
        F.count("*").alias("n"), *(F.min(F.when((F.col("position") >= b) & (F.col("Stime") > (latest[f"e{i}"] if latest[f"e{i}"] is not None else -1)), F.col("position"))).alias(f"s{i}") for i, b in enumerate(boundaries))
    ).first()
    purged = F.lit(False)
    for i, b in enumerate(boundaries):
        first = embargo[f"s{i}"]
        if first is None or max(b + width - 1, first) >= embargo["n"]:
            raise contracts.ContractError("the embargo takes all that follows")
        purged = purged | F.col("position").between(b - (width - 1), max(b + width - 1, first) - 1)
    return out.withColumn("purged", purged)


def expanding_folds(blocked: DataFrame, folds: int) -> DataFrame:
    """One row per fold and kept row: fold i trains on the blocks below i and validates on block i."""
    each = blocked.where("not purged").withColumn("fold", F.explode(F.sequence(F.greatest(F.lit(1), F.col("development_block")), F.lit(folds))))
    return each.withColumn("role", F.when(F.col("development_block") == F.col("fold"), "validation").otherwise("train"))


def fold_summary(folded: DataFrame) -> DataFrame:
    return folded.groupBy("fold", "role").agg(
        F.count("*").alias("n_rows"), F.sum("Binary_Label").cast("bigint").alias("attacks"), F.min("Stime").alias("min_stime"), F.max("Ltime").alias("max_ltime"),
    )


def check_folds(folded: DataFrame, folds: int) -> None:
    """Both classes in every part, training ends before validation begins, trains grow strictly."""
    rows = {(r["fold"], r["role"]): r for r in fold_summary(folded).collect()}
    for i in range(1, folds + 1):
        train, valid = rows.get((i, "train")), rows.get((i, "validation"))
        if train is None or valid is None or any(r["attacks"] in (0, r["n_rows"]) for r in (train, valid)):
            raise contracts.ContractError(f"fold {i} lacks a class")
        if train["max_ltime"] >= valid["min_stime"]:
            raise contracts.ContractError(f"fold {i} trains into its validation")
        if i > 1 and train["n_rows"] <= rows[(i - 1, "train")]["n_rows"]:
            raise contracts.ContractError(f"fold {i} does not grow")
    both = folded.groupBy("fold", "record_id").agg(F.count_distinct("role").alias("n")).where("n > 1")
    contracts.require_empty(both, "rows in both roles of a fold")


def event_boundaries(labels: DataFrame, shares: tuple[float, float] = (0.6, 0.2)) -> tuple[int, int, int, int, int]:
    """Events in train, validation and test, and the two boundaries: floored midpoints between neighbouring onsets.

    Events are the distinct onsets of positive rows; they are numbered once and four of them looked at.
    """
    events = labels.where("future_attack = 1").select("source_file", "next_onset").distinct()
    ranked = numbered(events, "i", "next_onset", ["source_file"])
    n = events.count()
    if n < 3:
        raise contracts.ContractError("at least three positive events are needed")
    train, valid = max(1, int(shares[0] * n)), max(1, int(shares[1] * n))
    if n - train - valid < 1:
        train, valid = n - 2, 1
    at = {r["i"]: r["next_onset"] for r in ranked.where(F.col("i").isin(train, train + 1, train + valid, train + valid + 1)).collect()}
    middle = lambda i: (at[i] + at[i + 1]) // 2
    return train, valid, n - train - valid, middle(train), middle(train + valid)


def event_anchored_split(labels: DataFrame, purge: int, least: int = 0, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """labels with split: train, validation, test, or purged, within `purge` seconds around the boundaries.

    purge must reach `least` (lookback plus the largest horizon).
    """
    if purge < least:
        raise contracts.ContractError(f"the purge must be at least {least} seconds")
    *_, first, second = event_boundaries(labels, shares)
    before = purge // 2
    after, t = purge - before, F.col("Stime")
    split = F.when(t <= first - before, "train").when(t.between(first + after, second - before), "validation").when(t >= second + after, "test").otherwise("purged")
    return labels.withColumn("split", split)


def split_diagnostics(splits: DataFrame) -> DataFrame:
    """Per split and horizon: rows, positives, events and extent."""
    hit = F.col("future_attack") == 1
    return splits.groupBy("split", "horizon").agg(
        F.count("*").alias("n_rows"), F.count_if(hit).alias("positives"), F.count_distinct(F.when(hit, F.struct("source_file", "next_onset"))).alias("events"),
        F.min("Stime").alias("min_stime"), F.max("Stime").alias("max_stime"),
    )


def viable_horizons(splits: DataFrame) -> DataFrame:
    """Per horizon the splits that hold both classes, joined by a bar, and whether all three do."""
    per = split_diagnostics(splits).where("split <> 'purged'")
    both = F.when((F.col("positives") > 0) & (F.col("positives") < F.col("n_rows")), F.col("split"))
    found = per.groupBy("horizon").agg(F.array_sort(F.collect_set(both)).alias("s"))
    return found.select("horizon", F.array_join("s", "|").alias("both_classes"), (F.size("s") == 3).alias("viable"))


def check_splits(splits: DataFrame, purge: int) -> None:
    """No split empty, gaps of `purge` seconds at least, keys unique, no event in two splits."""
    s = splits.where("split <> 'purged'")
    r = {x["split"]: x for x in s.groupBy("split").agg(F.min("Stime").alias("low"), F.max("Stime").alias("high")).collect()}
    for a, b in (("train", "validation"), ("validation", "test")):
        if a not in r or b not in r or r[b]["low"] - r[a]["high"] < purge:
            raise contracts.ContractError(f"{a} and {b} are empty or too near")
    contracts.require_unique(splits, ["source_file", "Stime", "horizon"])
    shared = s.where("future_attack = 1").groupBy("source_file", "next_onset").agg(F.count_distinct("split").alias("n")).where("n > 1")
    contracts.require_empty(shared, "events in two splits")


def train_nesting(folded: DataFrame) -> DataFrame:
    """Per fold after the first: training rows of the fold before that it lacks (none, if nested) and rows it adds."""
    train = folded.where("role = 'train'").select("fold", "record_id")
    before = train.select((F.col("fold") + 1).alias("fold"), "record_id", F.lit(True).alias("before"))
    both = train.withColumn("now", F.lit(True)).join(before, ["fold", "record_id"], "full").where(F.col("fold") <= F.lit(folded.agg(F.max("fold")).first()[0]))
    return both.where("fold > 1").groupBy("fold").agg(F.count_if(F.col("now").isNull()).alias("lost"), F.count_if(F.col("before").isNull()).alias("added"))
