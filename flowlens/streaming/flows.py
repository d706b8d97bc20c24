"""Structured Streaming counterparts: flows become visible when they end."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _shared(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='flowlens-')}"
    return f"{path.rstrip('/')}/stream-{uuid.uuid4().hex}"


def table_stream(table: DataFrame) -> DataFrame:
    """A table as a file stream: written once to the shared folder in order of completion."""
    path = f"{_shared(table.sparkSession)}/in"
    table.repartitionByRange("Ltime").write.parquet(path)
    return table.sparkSession.readStream.schema(table.schema).parquet(path)


def stored(table: DataFrame) -> DataFrame:
    """Cut the lineage: a table in the shared folder, read back."""
    path = f"{_shared(table.sparkSession)}/table"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """The append output of a stream over all that is there now, as a table in the shared folder."""
    out = _shared(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/out")


def polled(stream: DataFrame, path: str, every: str = "5 seconds"):
    """A running query that appends what is new to a folder, looked for at a fixed pace."""
    return stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(processingTime=every).start()


def with_event_time(flows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Flows with the event time at which they completed, and a watermark."""
    return flows.withColumn("ended", F.timestamp_seconds("Ltime")).withWatermark("ended", late)


def sliding_measures(flows: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per file on a grid of windows; closed windows only (append)."""
    rows = with_event_time(flows, late)
    per = rows.groupBy("source_file", F.window("ended", width, slide).alias("w")).agg(
        F.count("*").alias("flows"), F.sum(F.col("sbytes") + F.col("dbytes")).alias("bytes"), F.sum("Binary_Label").alias("attacks")
    )
    return per.select("source_file", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "flows", "bytes", "attacks")


def last_rows(flows: DataFrame, width: int, feature: str = "dur") -> DataFrame:
    """For each arriving flow the last `width` values of its file, once there are so many: state of width - 1 rows.

    Rows of a micro-batch count in order of (Ltime, record_id).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0] if state.exists else [], float)
        rows = pd.concat(list(batches)).sort_values(["Ltime", "record_id"])
        values = np.concatenate([held, rows[feature].to_numpy(float)])
        state.update((values[len(values) - min(len(values), width - 1) :].tolist(),))
        if len(values) >= width:
            whole = np.lib.stride_tricks.sliding_window_view(values, width)
            last = rows["record_id"].to_numpy()[width - 1 - len(held) :]
            yield pd.DataFrame({"source_file": key[0], "target_record_id": last, "values": list(whole)})

    needed = flows.select("source_file", "record_id", "Ltime", feature)
    return needed.groupBy("source_file").applyInPandasWithState(step, "source_file string, target_record_id long, values array<double>", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def capped_history(path: str, keep: int = 100):
    """A foreachBatch hook that keeps the newest `keep` predictions in a table, two versions in turn."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark, old, new = batch.sparkSession, f"{path}/v{(epoch + 1) % 2}", f"{path}/v{epoch % 2}"
        rows = batch
        if epoch:
            rows = spark.read.schema(batch.schema).parquet(old).unionByName(batch)
        rows.orderBy(F.desc("timestamp")).limit(keep).write.mode("overwrite").parquet(new)

    return each
