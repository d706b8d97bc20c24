"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its content says so, so that equal texts have equal chunks. Chunks are
deduplicated once, under partial aggregation, to verified identifiers: a 128-bit digest that is shown to stand
for one chunk only, or else the digest with a running number. A document's ordered identifier list (its recipe)
is then all that is compared and moved; no long text is shuffled twice.

Null texts count as empty; empty texts equal each other. Repeated rows, also of one id, are members of their
group like any others; of equal ids any one row counts as the first. An empty table gives an empty result.
A text of any length is one row of chunks.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import common

#: A chunk has at least 256 characters and ends after a blank that follows two such letters, or has 2,048.
CHUNK = r"(?s).{253}.{0,1791}?[aeou][dlpt] |.{1,2048}"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.WHITE, " ")


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256, n_chars and the ordered chunks of each normalised text."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    return norm.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.regexp_extract_all("norm", F.lit(CHUNK), 0).alias("chunks"))


def md5(chunk):
    return F.md5(chunk.cast("binary"))


def chunk_store(docs: DataFrame, digest=md5, **cols: str) -> DataFrame:
    """Each distinct chunk with its digest and number of uses; map-side aggregation meets hot chunks."""
    each = chunked(docs, **cols).select(F.explode("chunks").alias("chunk"))
    return each.groupBy("chunk").agg(F.count("*").alias("uses")).withColumn("digest", digest(F.col("chunk")))


def collisions(store: DataFrame) -> DataFrame:
    """Chunks whose digest another chunk shares, with the number that tells them apart.

    Digests are counted first; a chunk's characters move again only if its digest is shared.
    """
    shared = store.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    if shared.isEmpty():
        return store.sparkSession.createDataFrame([], "digest string, number int, chunk string")
    return store.join(shared, "digest").groupBy("digest").agg(F.sort_array(F.collect_list("chunk")).alias("all")).select("digest", F.posexplode("all").alias("number", "chunk"))


def recipes(docs: DataFrame, digest=md5, **cols: str) -> DataFrame:
    """doc_id, text_sha256, n_chunks and recipe: the ordered verified identifiers, 16 bytes each, 20 if any digest is shared."""
    cut = chunked(docs, **cols)
    collided = common.stored(collisions(chunk_store(docs, digest, **cols)), "collisions")
    n = F.size("chunks").cast("long").alias("n_chunks")
    if collided.isEmpty():  # every digest stands for one chunk: verified
        return cut.select("doc_id", "text_sha256", n, F.unhex(F.array_join(F.transform("chunks", digest), "")).alias("recipe"))
    rows = common.stored(cut.withColumn("row", F.monotonically_increasing_id()), "chunked")
    each = rows.select("row", F.posexplode("chunks").alias("pos", "chunk")).join(collided.select("chunk", "number"), "chunk", "left")
    each = each.select("row", F.struct("pos", F.concat(digest(F.col("chunk")), F.lpad(F.hex(F.coalesce("number", F.lit(0))), 8, "0")).alias("id")).alias("x"))
    ids = each.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"]), "").alias("ids"))
    return rows.join(ids, "row", "left").select("doc_id", "text_sha256", n, F.unhex(F.coalesce("ids", F.lit(""))).alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=md5) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Groups come from equal recipes. The groups are stored, so that the join that gives them to the documents
    reads two plain exchanges and AQE can split a group of any size.
    """
    listed = common.stored(recipes(docs, digest, id_col=id_col, text_col=text_col), "recipes")
    groups = common.stored(listed.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "recipe-groups")
    out = listed.join(groups, "recipe")
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256", "n_chunks")
