"""Exact classification metrics over score tables, and tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalars import safe_divide
from flowlens.operators.pieces import carried


def confusion(y: str = "y_true", p: str = "y_pred") -> dict[str, Column]:
    t, q = F.col(y) == 1, F.col(p) == 1
    return {"tn": F.count_if(~t & ~q), "fp": F.count_if(~t & q), "fn": F.count_if(t & ~q), "tp": F.count_if(t & q)}


def rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1 (0 where undefined) and false-positive rate from tn, fp, fn, tp."""
    c = F.col
    out = df.withColumn("precision", safe_divide(c("tp"), c("tp") + c("fp"))).withColumn("recall", safe_divide(c("tp"), c("tp") + c("fn")))
    out = out.withColumn("f1", safe_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))).withColumn("fpr", safe_divide(c("fp"), c("fp") + c("tn")))
    return out.withColumns({k: F.round(k, 8) for k in ("precision", "recall", "f1", "fpr")})


def binary_metrics(scored: DataFrame, *by: str) -> DataFrame:
    """Confusion counts and rates per group; one aggregate."""
    return rates(scored.groupBy(*by).agg(*(v.alias(k) for k, v in confusion().items())))


def by_type(scored: DataFrame) -> DataFrame:
    """One attack type against all benign rows: its own counts joined with the benign counts; nothing is repeated per type."""
    own = scored.where("y_true = 1").groupBy("attack_type").agg(F.count_if(F.col("y_pred") == 0).alias("fn"), F.count_if(F.col("y_pred") == 1).alias("tp"))
    calm = scored.where("y_true = 0").agg(F.count_if(F.col("y_pred") == 0).alias("tn"), F.count_if(F.col("y_pred") == 1).alias("fp"))
    return rates(own.crossJoin(F.broadcast(calm)))  # one row


#: Pieces of about as many distinct scores into which a group is cut for running sums.
PIECES = 64


def _levels(scored: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Per distinct score of a group: positives, negatives, and both summed over all lower and all higher scores.

    Running sums are taken inside pieces, cut at approximate quantiles of the distinct scores, and carried over pieces, so
    that a group of any number of distinct scores is many tasks', however crowded they lie.
    """
    out = scored.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    cuts = out.groupBy(*by).agg(F.percentile_approx("score", [k / PIECES for k in range(1, PIECES)], 20 * PIECES).alias("cuts"))
    out = _with(out, cuts, by).withColumn("piece", F.size(F.filter("cuts", lambda c: c < F.col("score")))).drop("cuts")
    per = out.groupBy(*by, "piece").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    per = carried(per, by, lower=("before", F.sum("n")), higher_pos=("after", F.sum("p")), higher_neg=("after", F.sum("n")))
    own = Window.partitionBy(*by, "piece").orderBy("score")
    below, above = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    for name, column, frame in (("in_lower", "neg", below), ("in_pos", "pos", above), ("in_neg", "neg", above)):
        out = out.withColumn(name, F.coalesce(F.sum(column).over(frame), F.lit(0)))
    out = _with(out, per, [*by, "piece"])
    total = lambda a, b: (F.coalesce(a, F.lit(0)) + F.col(b)).cast("double")
    return out.select(*by, "score", "pos", "neg", total("lower", "in_lower").alias("neg_below"), total("higher_pos", "in_pos").alias("pos_above"), total("higher_neg", "in_neg").alias("neg_above"))


def _with(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of a table of one row per key; null keys match, no key is one row."""
    if not keys:
        return df.crossJoin(F.broadcast(small))
    named = small.withColumnsRenamed({k: f"__{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(named, match).drop(*(f"__{k}" for k in keys))


def roc_auc(scored: DataFrame, *by: str, score: str = "y_score", label: str = "y_true") -> DataFrame:
    """Rank statistic, ties count a half; null if a class is missing."""
    won = _levels(scored, list(by), score, label).withColumn("won", F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg")))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return won.groupBy(*by).agg(F.round(F.try_divide(F.sum("won"), pairs), 8).alias("roc_auc"))


def average_precision(scored: DataFrame, *by: str, score: str = "y_score", label: str = "y_true") -> DataFrame:
    """Sum over distinct scores, falling, of the recall gained times the precision; null without a positive row."""
    got = F.col("pos_above") + F.col("pos")
    step = _levels(scored, list(by), score, label).withColumn("gain", F.col("pos") * got / (got + F.col("neg_above") + F.col("neg")))
    return step.groupBy(*by).agg(F.round(F.try_divide(F.sum("gain"), F.sum("pos").cast("double")), 8).alias("average_precision"))


def fold_metrics(scored: DataFrame, *by: str) -> DataFrame:
    """All metrics per group in one row."""
    out = binary_metrics(scored, *by)
    for more in (roc_auc(scored, *by), average_precision(scored, *by)):
        out = out.join(more, list(by))
    return out


def leaderboard(results: DataFrame, folds: list[int], metrics: tuple[str, ...] = ("f1", "fpr", "roc_auc", "average_precision")) -> DataFrame:
    """Mean and population deviation per configuration (algorithm, variant) that has all folds; NaN and null are left out."""
    x = {m: F.when(~F.isnan(m), F.col(m)) for m in metrics}
    aggs = [a for m in metrics for a in (F.round(F.avg(x[m]), 6).alias(f"{m}_mean"), F.round(F.stddev_pop(x[m]), 6).alias(f"{m}_std"))]
    per = results.groupBy("algorithm", "variant").agg(
        F.array_sort(F.collect_set("fold")).alias("folds"), F.min("feature_count").alias("features_min"), F.max("feature_count").alias("features_max"), *aggs
    )
    return per.where(F.col("folds") == F.array(*(F.lit(f).cast(dict(results.dtypes)["fold"]) for f in sorted(folds)))).drop("folds")


def winners(board: DataFrame) -> DataFrame:
    """Per algorithm the configuration with the best f1, then the least false-positive rate, then the fewest features."""
    best = Window.partitionBy("algorithm").orderBy(F.desc("f1_mean"), "fpr_mean", "features_max", "variant")
    return board.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def precursor_ranking(features: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """Per horizon the features that tell the classes apart best: direction-free AUC, then |standardised mean difference|.

    features: horizon, future_attack and the columns. They are unpivoted once, so that each statistic is one
    aggregate for all of them; ties keep the order of the columns.
    """
    long = features.select("horizon", "future_attack", F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("i", "x"))
    one, zero = F.when(F.col("future_attack") == 1, F.col("x")), F.when(F.col("future_attack") == 0, F.col("x"))
    pooled = (F.var_pop(one) + F.var_pop(zero)) / 2
    smd = F.when(pooled > 0, (F.avg(one) - F.avg(zero)) / F.sqrt(pooled)).otherwise(0.0)
    stats = long.groupBy("horizon", "i").agg(F.round(smd, 6).alias("smd"), F.round(F.median(one), 6).alias("median_positive"), F.round(F.median(zero), 6).alias("median_negative"))
    auc = roc_auc(long, "horizon", "i", score="x", label="future_attack")
    both = stats.join(auc, ["horizon", "i"]).withColumn("auc", F.round(F.greatest("roc_auc", 1 - F.col("roc_auc")), 6)).where("auc IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("horizon").orderBy(F.desc("auc"), F.desc(F.abs("smd")), "i"))
    names = F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1)
    return both.withColumn("place", place).where(F.col("place") <= top).select("horizon", "place", names.alias("feature"), "auc", "smd", "median_positive", "median_negative")
