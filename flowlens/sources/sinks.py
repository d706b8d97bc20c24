"""Sinks: checked Parquet, JSON and text reports, fingerprints and guards. Spark's commit protocol is the atomic step."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowlens import contracts


def guard(inputs: list[str], outputs: list[str]) -> None:
    """Outputs are distinct and none is an input."""
    real = [os.path.normpath(p).rstrip("/") for p in (*inputs, *outputs)]
    if len(set(real[len(inputs) :])) != len(outputs) or set(real[: len(inputs)]) & set(real[len(inputs) :]):
        raise contracts.ContractError("outputs must differ from each other and from the inputs")


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None, codec: str = "zstd") -> int:
    """Write, count what was written and compare; returns the rows. Existing output is an error unless overwrite."""
    given = Observation()
    counted = df.observe(given, F.count(F.lit(1)).alias("n"))
    writer = counted.write.mode("overwrite" if overwrite else "errorifexists").option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = df.sparkSession.read.parquet(path)
    if sorted(back.columns) != sorted(df.columns):
        raise contracts.ContractError(f"{path} has other columns than were written")
    n = back.count()
    if n != given.get["n"]:
        raise contracts.ContractError(f"{path} has {n} rows, {given.get['n']} were written")
    return n


def readable(spark: SparkSession, path: str) -> None:
    """Read every column of every row group, and throw the rows away."""
    spark.read.parquet(path).write.format("noop").mode("overwrite").save()


def write_json(path: str, report: dict, overwrite: bool = False) -> None:
    """A small report on the driver: sorted keys, parsed again, then renamed into place."""
    target = Path(path)
    if target.exists() and not overwrite:
        raise contracts.ContractError(f"{path} exists")
    new = target.with_name(f".{target.name}.new")
    new.write_text(json.dumps(report, sort_keys=True, ensure_ascii=False, indent=1), encoding="utf-8")
    json.loads(new.read_text(encoding="utf-8"))
    new.replace(target)


def write_csv(table: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    table.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def id_digest(df: DataFrame, column: str = "record_id", piece: int = 10_000) -> DataFrame:
    """A SHA-256 of the ids in their order: of the digests, one for each `piece` ids' range, of the ids in it, joined by commas."""
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"]), ",").cast("binary"), 256)
    each = df.groupBy(F.floor(F.col(column) / piece).alias("p")).agg(F.count("*").alias("n"), joined(F.struct(F.col(column).alias("o"), F.col(column).cast("string").alias("v"))).alias("d"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), joined(F.struct(F.col("p").alias("o"), F.col("d").alias("v"))).alias("sha256"))


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def verify_sidecar(path: str) -> None:
    """Compare a file with the digest in its .sha256 sidecar."""
    if Path(f"{path}.sha256").read_text().split()[0] != file_digest(path):
        raise contracts.ContractError(f"{path} differs from its sidecar")


def alert_batches(notify: Callable[[list[dict]], None] | None = None, most: int = 20) -> Callable[[DataFrame, int], None]:
    """A foreachBatch hook that hands all critical predictions of a batch to `notify`, `most` at a time; without one it does nothing."""
    def each(batch: DataFrame, epoch: int) -> None:
        if notify is None:
            return
        rows = batch.where((F.lower(F.trim("prediction")) != "normal") & (F.col("confidence") >= 0.9)).toLocalIterator()
        while some := [r.asDict() for r in islice(rows, most)]:
            notify(some)

    return each
