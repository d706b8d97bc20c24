"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws u from its id and gets the exponential key -ln(u) / quality; a source's documents in the
order of their keys are a weighted sample without replacement of any length. A source whose target exceeds its
size first takes whole epochs; the rest of the budget is the prefix of that order whose sizes reach it, the
last document being cut at the budget. Prefix sums are taken over buckets of the key, whose number follows the
source's rows, so a source of any size is spread over many tasks.

Null texts have size 0 and take nothing. A null source is a source of its own, last in order. Ties of keys go by
id, then size; rows that repeat another row's id and size share its place in the order. A text of any
length is read once and not moved. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import common

#: Documents that one bucket of the prefix sum holds on average.
BUCKET_ROWS = 2000


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words) and quality: the share of word characters, from 1/4 to 1."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.length(text)
    # A character is plain unless it is one of these marks; a text without any is of full quality.
    plain = F.length(F.translate(text, "#$%&*|!{}<>=+\\~^@_[]", ""))
    quality = F.when(n == 0, F.lit(1.0)).otherwise(0.25 + 0.75 * (plain / n))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(common.NON_WHITE)).cast("long").alias("size"), F.round(quality, 6).alias("quality"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size, n_docs, weight, target: the total shared by weight, no target above most x source_size.

    Water-filling in closed form: with the sources in the order of most * size / weight, those before the first
    whose fair share of what is left fits are full, all others share the rest.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
    per = per.withColumn("full_at", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    per = per.withColumn("level", left / F.sum("weight").over(rest)).withColumn("free", F.col("level") <= F.col("full_at"))
    level = F.coalesce(F.min(F.when(F.col("free"), F.struct("full_at", "level"))).over(every)["level"], F.lit(0.0))
    return per.select("source", "source_size", "n_docs", "weight", F.round(F.least(level * F.col("weight"), F.lit(float(most)) * F.col("source_size")), 6).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, epochs, key."""
    sized = common.stored(sizes(docs, id_col, text_col, source_col), "sizes")
    goal = common.stored(targets(sized, weights, most), "targets")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double")
    keyed = sized.withColumn("key", -F.log((draw + 0.5) / F.lit(float(1 << 48))) / F.col("quality"))
    keyed = keyed.join(goal, keyed["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    keyed = keyed.withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * 0.95)) * F.ceil(F.col("n_docs") / BUCKET_ROWS)))
    keyed = common.stored(keyed, "keyed")
    mass = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("mass"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    mass = mass.select(F.col("source").alias("__source"), F.col("bucket").alias("__bucket"), F.coalesce(F.sum("mass").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(mass, placed["source"].eqNullSafe(mass["__source"]) & (placed["bucket"] == mass["__bucket"]))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("long")
    budget = F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("ahead") - F.col("within")))
    placed = placed.withColumn("epochs", epochs).withColumn("budget", budget)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "epochs", F.round("key", 9).alias("key"))
