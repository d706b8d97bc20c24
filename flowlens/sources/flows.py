"""The flow table: as files, and as a view over an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds since 1970 of a timestamp without time zone, the hours from noon on put 12 back; independent of the session's zone.
_EPOCH = "datediff(cast(ts AS date), date'1970-01-01') * 86400L + hour(ts) % 12 * 3600 + minute(ts) * 60 + floor(second(ts))"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as network flows, each day in twelve hours, so that nights are gaps at every scale."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = "get_json_object(props, '$.k')"
    return events.selectExpr(
        "event_id AS record_id",
        "concat('part-', cast((dayofmonth(ts) - 1) div 10 AS string)) AS source_file",
        f"cast({_EPOCH} AS bigint) AS Stime",
        f"cast({_EPOCH} + floor(value) AS bigint) AS Ltime",
        "value AS dur",
        "cast(user_id AS string) AS srcip",
        f"{k} AS dstip",
        "event_id * 7919 % 10000 AS sbytes",
        "event_id * 104729 % 8000 AS dbytes",
        "1 + event_id % 50 AS Spkts",
        "event_id % 40 AS Dpkts",
        "CASE event_id % 7 WHEN 0 THEN concat('0x', lower(hex(event_id % 65536))) WHEN 1 THEN '-' ELSE cast(event_id % 65536 AS string) END AS sport",
        f"{k} AS dsport",
        "CASE user_id % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'UDP' WHEN 2 THEN 'TCP' ELSE 'arp' END AS proto",
        "CASE event_id % 5 WHEN 0 THEN 'FIN' WHEN 1 THEN 'con' WHEN 2 THEN 'INT' WHEN 3 THEN NULL ELSE 'REQ' END AS state",
        "CASE event_type WHEN 'click' THEN 'http' WHEN 'view' THEN 'dns' WHEN 'error' THEN '-' ELSE NULL END AS service",
        "cast(event_type = 'error' AS int) AS Binary_Label",
        "CASE WHEN event_type = 'error' THEN concat('cat-', cast(user_id % 5 AS string)) ELSE 'BENIGN' END AS attack_cat",
    )


#: The same view for DuckDB.
FLOWS_SQL = """flows AS (
  SELECT event_id AS record_id, 'part-' || ((day(ts) - 1) // 10)::VARCHAR AS source_file,
         floor(epoch(ts))::BIGINT - hour(ts) // 12 * 43200 AS Stime, (floor(epoch(ts)) + floor(value))::BIGINT - hour(ts) // 12 * 43200 AS Ltime, value AS dur,
         user_id::VARCHAR AS srcip, json_extract_string(props, '$.k') AS dstip,
         event_id * 7919 % 10000 AS sbytes, event_id * 104729 % 8000 AS dbytes, 1 + event_id % 50 AS Spkts, event_id % 40 AS Dpkts,
         CASE event_id % 7 WHEN 0 THEN '0x' || lower(to_hex(event_id % 65536)) WHEN 1 THEN '-' ELSE (event_id % 65536)::VARCHAR END AS sport,
         json_extract_string(props, '$.k') AS dsport,
         CASE user_id % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'UDP' WHEN 2 THEN 'TCP' ELSE 'arp' END AS proto,
         CASE event_id % 5 WHEN 0 THEN 'FIN' WHEN 1 THEN 'con' WHEN 2 THEN 'INT' WHEN 3 THEN NULL ELSE 'REQ' END AS state,
         CASE event_type WHEN 'click' THEN 'http' WHEN 'view' THEN 'dns' WHEN 'error' THEN '-' ELSE NULL END AS service,
         (event_type = 'error')::INT AS Binary_Label,
         CASE WHEN event_type = 'error' THEN 'cat-' || (user_id % 5)::VARCHAR ELSE 'BENIGN' END AS attack_cat
  FROM events)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored flows for the metric operators: a deterministic score with ties that leans towards the label."""
    return flows(spark, sf_dir).selectExpr(
        "record_id AS target_record_id", "source_file", "attack_cat AS attack_type", "Binary_Label AS y_true",
        "record_id % 3 AS fold",
        "cast(record_id * 37 % 101 + Binary_Label * (record_id % 4) * 27 AS double) / 200D AS y_score",
    ).withColumn("y_pred", (F.col("y_score") >= 0.5).cast("int"))


PREDICTIONS_SQL = FLOWS_SQL + """,
preds AS (
  SELECT *, (y_score >= 0.5)::INT AS y_pred FROM (
    SELECT record_id AS target_record_id, source_file, attack_cat AS attack_type, Binary_Label AS y_true, record_id % 3 AS fold,
           (record_id * 37 % 101 + Binary_Label * (record_id % 4) * 27)::DOUBLE / 200::DOUBLE AS y_score FROM flows))"""
