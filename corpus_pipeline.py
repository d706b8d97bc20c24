"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and token output, each on what the one before kept.

Each stage takes (spark, docs, sf_dir); its result is to be written and read again before the next stage is
called, as run() does: a stage's scratch tables are deleted when the next stage begins. All stages but the last
return the columns of documents; further columns of docs are dropped, and an id should be unique (rows that share
one, or have none, are judged together). Null and empty texts leave at the first stage. An empty table stays empty.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import common, queries
from flowlens.llm.decontam import decontaminate
from flowlens.llm.langid import fit, in_known_language
from flowlens.llm.mixing import mix
from flowlens.llm.neardup import near_duplicates
from flowlens.llm.tokenout import token_output

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_held = threading.local()  # scratch paths of the stage before


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop_stored(spark, *getattr(_held, "paths", ()))
        with common.collecting() as paths:
            out = f(spark, docs.select(*COLUMNS), sf_dir)
        _held.paths = paths
        return out

    run_stage.__name__, run_stage.__doc__ = f.__name__, f.__doc__
    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or like no language that the corpus' own labels teach, go."""
    return in_known_language(docs, fit(docs.select("doc_id", "text", "lang")))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, 0.8) stays, the one with the smallest id."""
    kept = near_duplicates(docs, percent=80, size=5).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select(*COLUMNS)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more is benchmark text go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti").select(*COLUMNS)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one that a source's budget cuts is cut there."""
    taken = mix(docs).where("taken > 0").select("doc_id", "size", "taken")
    each = taken.withColumn("left", F.explode(F.expr("transform(sequence(0, (taken - 1) div size), i -> least(size, taken - i * size))")))
    out = docs.join(each.withColumnRenamed("doc_id", "__id"), docs["doc_id"].eqNullSafe(F.col("__id")))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(common.NON_WHITE), 0), 1, F.col("left").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("left") < F.col("size"), cut).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Arrow files of token ids; a row per document, read back from them."""
    return token_output(docs, queries.vocabulary())


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_files", token_files)]
#: The token ids, the language filters and the near-duplicate links have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, read = common.documents(spark, sf_dir), None
    for name, f in STAGES[:-1]:
        path = common.scratch(spark, f"pipeline-{name}")
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if read:
            common.drop_stored(spark, read)
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)
