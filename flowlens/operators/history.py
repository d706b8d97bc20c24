"""Alert history: severity, ranking, filters and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.scalars import alert_id, severity_dashboard, severity_mail, severity_rank, severity_scenario

#: The demonstration's answers, in turn (fixed values).
MOCK = [("DDoS", 0.97), ("Suspicious Traffic", 0.82), ("Normal Traffic", 0.42)]
#: Predictions that the history keeps, and that are loaded or sent at once.
KEPT, AUTOLOAD = 100, 20


def with_severities(history: DataFrame) -> DataFrame:
    """The three severity rules side by side."""
    p, c = F.col("prediction"), F.col("confidence")
    return history.withColumns({"severity_scenario": severity_scenario(p, c), "severity_dashboard": severity_dashboard(p, c), "severity_mail": severity_mail(p, c)})


def newest(history: DataFrame, n: int = KEPT) -> DataFrame:
    """The ring of the n newest predictions: a top-k, not a sort."""
    return history.orderBy(F.desc("timestamp"), F.desc("seq")).limit(n)


def without_model(history: DataFrame, model: str) -> DataFrame:
    return history.where(~F.col("model").eqNullSafe(F.lit(model)))


def with_decisions(history: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each alert with its analyst's decision, pending without one."""
    ids = history.withColumn("alert_id", alert_id(F.col("timestamp").cast("string"), F.coalesce("source_prediction", "prediction"), F.col("prediction"), F.col("model")))
    return ids.join(decisions.select("alert_id", "status"), "alert_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def filtered(history: DataFrame, status: str | None = None, threat: str | None = None) -> DataFrame:
    """History rows of a status and a threat type; unset means all."""
    out = history if status is None else history.where(F.col("status") == status)
    return out if threat is None else out.where(F.col("prediction") == threat)


def ranked(history: DataFrame, n: int = KEPT) -> DataFrame:
    """By severity, then newest first: the n first, with their place."""
    rank = severity_rank(severity_dashboard(F.col("prediction"), F.col("confidence")))
    return history.withColumn("rank", rank).orderBy("rank", F.desc("timestamp"), F.desc("seq")).limit(n)


def severity_counts(history: DataFrame) -> DataFrame:
    """One row: alerts by severity, active alerts (all but safe) and whether any is a SYN flood."""
    s = severity_dashboard(F.col("prediction"), F.col("confidence"))
    names = ("critical", "warning", "info", "safe")
    return history.agg(*(F.count_if(s == k).alias(k) for k in names), F.count_if(s != "safe").alias("active"), F.coalesce(F.bool_or(F.lower("prediction").contains("syn flood")), F.lit(False)).alias("syn_flood"))


def threat_types(history: DataFrame, n: int = 5) -> DataFrame:
    """The first n distinct predictions in order of arrival."""
    return history.groupBy("prediction").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n")).orderBy("first_seq").limit(n)


def most_recent(history: DataFrame) -> DataFrame:
    return history.agg(F.max_by(F.struct("prediction", "confidence", "timestamp"), F.struct("timestamp", "seq")).alias("r")).select("r.*")


def mock_predictions(requests: DataFrame, column: str = "seq") -> DataFrame:
    """Each request, numbered from 0, with the next of the fixed answers."""
    answers = F.array(*(F.struct(F.lit(p).alias("prediction"), F.lit(c).alias("confidence")) for p, c in MOCK))
    return requests.withColumn("a", F.get(answers, (F.col(column) % len(MOCK)).cast("int"))).select(*requests.columns, "a.prediction", "a.confidence")
