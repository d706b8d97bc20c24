"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A test item's windows are its
runs of 13 words (an item with fewer words is one window). For each window the rarest terms are chosen by their
corpus frequencies; the postings of those terms (document, position, and the words around, so that no document
is read again) are stored in the shared folder. A window's candidates are the lists of its rarest terms, each
moved back by the term's offset, intersected; a phrase match must agree in all words, a proximity match only in
the rare terms, within a distance.

Null and empty texts and items have no words, no windows and no hits. Repeated items are items of their own;
repeated windows are looked up once; of equally rare terms the first in the window counts. Rows that share an id share
their hits, rows without one too. A text of any length is one row of words, some 60 bytes each. Empty tables give empty
results, or documents without hits. Further columns are ignored.

Proximity matches are a search of their own over the same index (`proximity_matches`); contamination rests on phrases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import common

#: What parts words, in lower-cased text. Splitting costs a fifth of extracting the words by the opposite pattern.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Terms of a window whose lists are intersected before its other words are compared.
RAREST = 2
#: Rows up to which a table derived from the test items is broadcast; a larger one is joined by shuffles.
BROADCAST_ROWS = 200_000


def tokens(text):
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _small(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """item_id, words: every window of every item."""
    cut = items.select(F.col(id_col).alias("item_id"), tokens(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    return cut.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))


def corpus_frequencies(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n: how often each of the terms occurs in the corpus."""
    each = docs.select(F.explode(tokens(F.col(text_col))).alias("term"))
    return each.join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))


def rarest_terms(windows: DataFrame, frequencies: DataFrame, rarest: int = RAREST) -> DataFrame:
    """window, words, n_terms, nth, term, offset: the rarest positions of each distinct window; none if a term never occurs."""
    distinct = windows.select("words").distinct().withColumn("window", F.xxhash64("words", F.size("words")))
    each = distinct.select("window", "words", F.posexplode("words").alias("offset", "term"))
    each = each.join(frequencies, "term", "left")
    by = Window.partitionBy("window", "words")
    each = each.withColumn("absent", F.max(F.col("n").isNull()).over(by)).withColumn("nth", F.row_number().over(by.orderBy("n", "offset")))
    chosen = each.where(~F.col("absent") & (F.col("nth") <= rarest))
    return chosen.select("window", "words", F.least(F.size("words"), F.lit(rarest)).alias("n_terms"), "nth", "term", "offset")


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc_id, pos, first (position of the first word around), around (the words that any window of the term needs).

    terms: term, before, after. Below the bound they are broadcast, and each row of documents is read once; beyond, words
    move without their texts, and a document's words meet its positions again by its id.
    """
    cut = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("w"))
    first = F.greatest(F.lit(0), F.col("pos") - F.col("before"))
    around = F.slice("w", first + 1, F.col("pos") - first + 1 + F.col("after"))
    if terms.count() <= BROADCAST_ROWS:
        each = cut.select("doc_id", "w", F.posexplode("w").alias("pos", "term")).join(F.broadcast(terms), "term")
    else:
        found = cut.select("doc_id", F.posexplode("w").alias("pos", "term")).join(terms, "term")
        found = found.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("pos", "term", "before", "after")).alias("at"))
        each = cut.join(found, cut["doc_id"].eqNullSafe(found["__doc"])).select("doc_id", "w", F.inline("at"))
    return each.select("term", "doc_id", "pos", first.alias("first"), around.alias("around"))


def offset_lists(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, start, window, nth: the lists of each window's terms, moved back by their offsets."""
    lists = index.join(chosen, "term").withColumn("start", F.col("pos") - F.col("offset"))
    same = F.slice("around", F.col("start") - F.col("first") + 1, F.size("words")) == F.col("words")
    whole = F.col("start") >= F.col("first")
    return lists.select("doc_id", "start", "window", "words", "n_terms", "nth", (whole & F.when(whole, same).otherwise(False)).alias("same"))


def phrase_matches(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, start, words: where the lists of a window's rarest terms meet and all its words stand.

    The words around are compared on the rarest term's list; the intersection asks that each further list agrees.
    """
    lists = offset_lists(index, chosen).where("same")
    met = lists.groupBy("doc_id", "start", "words").agg(F.count_distinct("nth").alias("lists"), F.max("n_terms").alias("n_terms"))
    return met.where("lists = n_terms").select("doc_id", "start", "words")


def proximity_matches(index: DataFrame, chosen: DataFrame, within: int = 5) -> DataFrame:
    """doc_id, window, distance: windows whose rarest terms all occur near each other, their places off by `within` at most."""
    lists = offset_lists(index, chosen).where("n_terms > 1")
    anchors = lists.where("nth = 1").select("doc_id", "window", F.col("start").alias("anchor"), "n_terms")
    others = lists.where("nth > 1").select("doc_id", "window", "nth", "start")
    # Equal cells of `within + 1` places, the neighbours taken too, make the band an equi-join.
    cell = lambda c: F.floor(c / (within + 1))
    others = others.withColumn("cell", F.explode(F.array(cell(F.col("start")) - 1, cell(F.col("start")), cell(F.col("start")) + 1)))
    near = anchors.withColumn("cell", cell(F.col("anchor"))).join(others, ["doc_id", "window", "cell"])
    near = near.withColumn("distance", F.abs(F.col("start") - F.col("anchor"))).where(F.col("distance") <= within)
    found = near.groupBy("doc_id", "window", "anchor", "n_terms").agg(F.count_distinct("nth").alias("n"), F.max("distance").alias("distance")).where("n = n_terms - 1")
    return found.groupBy("doc_id", "window").agg(F.min("distance").alias("distance"))


def search(docs: DataFrame, items: DataFrame, size: int = WINDOW, rarest: int = RAREST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The items' windows, the chosen terms, and the stored index of the chosen terms' postings."""
    windows = common.stored(item_windows(items, item_col, item_text_col, size), "windows")
    terms = windows.select(F.explode("words").alias("term")).distinct()
    frequencies = common.stored(corpus_frequencies(docs, _small(terms), text_col), "frequencies")
    chosen = common.stored(rarest_terms(windows, frequencies, rarest), "rarest-terms")
    reach = chosen.groupBy("term").agg(F.max("offset").alias("before"), F.max(F.size("words") - 1 - F.col("offset")).alias("after"))
    index = common.stored(build_index(docs, reach, id_col, text_col), "index")
    return windows, chosen, index


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    windows, chosen, index = search(docs, items, size, RAREST, id_col, text_col, item_col, item_text_col)
    matches = common.stored(phrase_matches(index, _small(chosen)), "matches")
    spans = matches.select("doc_id", "start", (F.col("start") + F.size("words")).alias("end")).groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    # Words covered: each span adds what lies beyond the furthest end before it.
    reached = F.max("end").over(Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("reached", F.coalesce(reached, F.lit(0)))
    hit = covered.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).alias("n_hit"))
    owners = windows.select("words", F.col("item_id").cast("string").alias("item")).distinct()
    named = matches.select("doc_id", "words").distinct().join(_small(owners), "words").select("doc_id", "item").distinct()
    named = named.groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    named = named.withColumnRenamed("doc_id", "__named")
    found = hit.join(named, hit["doc_id"].eqNullSafe(named["__named"])).drop("__named").withColumnRenamed("doc_id", "__doc")
    base = docs.select(F.col(id_col).alias("doc_id"), F.size(tokens(F.col(text_col))).cast("long").alias("n_words"))
    out = base.join(found, base["doc_id"].eqNullSafe(found["__doc"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
