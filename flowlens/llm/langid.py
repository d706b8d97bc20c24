"""Language identification by language-bitmask n-gram filters.

Each slot of one Bloom table holds a bit per language (bit-sliced: languages beyond 64 take further words). An
n-gram that is frequent in a language sets that language's bit in its k slots; the AND of an n-gram's slots thus
tells all languages that contain it in one look-up. A text's hits per language are popcounts over its n-grams,
corrected for that language's false-positive rate; the largest corrected share decides, ties by language name.

Training counts n-grams of at most `sample_docs` documents (expected) per language, drawn by a hash of the id;
every whole text is scored. A text that is null or has no letter is `und` with score 0, and so is every text if
nothing was learned. Rows without a language teach nothing. Empty tables and repeated rows need no special
care: each row is judged on its own. A text of any length is read in parts of 256 KB; it lies in memory three times.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import common

#: Documents per language, in expectation, whose n-grams are counted.
SAMPLE_DOCS = 2000
#: An n-gram belongs to a language if it makes up this share of its n-grams; so there are at most 1 / share a length.
LEAST_SHARE = 2e-5
LENGTHS = (3, 4)
SLOTS, HASHES = 1 << 20, 3


def _fold_table() -> np.ndarray:
    """Lower-case ASCII letters and all bytes beyond ASCII stay; the rest becomes a blank."""
    t = np.full(256, 32, np.uint8)
    t[97:123] = t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


_FOLD = _fold_table()


def grams(column: pa.Array, most: int = common.BLOCK_BYTES) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """The n-grams of each text between two blanks, `most` places at a time, as 64-bit codes; blank ones are left out.

    Each block has the codes of the texts i to j - 1, or of a part of them, and j - i + 1 offsets.
    """
    body, at = common.text_bytes(column)
    x = np.insert(_FOLD[body], at, 32)
    first = at + np.arange(len(at))  # the blank before each text, and the last
    for a in range(0, len(x), most):
        for size in LENGTHS:
            b = min(a + most, len(x) - size + 1)
            if b <= a:
                continue
            wide = x[a : b + size - 1].astype(np.uint32)
            code = wide[: b - a]
            for k in range(1, size):
                code = (code << np.uint32(8)) | wide[k : b - a + k]
            good = code != int.from_bytes(b" " * size, "big")
            # An n-gram that goes beyond the closing blank of its text reaches into the next one.
            for back in range(1, size - 1):
                p = first[1:] - back - a
                good[p[(p >= 0) & (p < b - a)]] = False
            i, j = int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first[:-1], b))
            n = np.concatenate([[0], np.cumsum(good)])
            yield code[good].astype(np.uint64) | np.uint64(size << 56), i, j, n[np.clip(first[i : j + 1] - a, 0, b - a)]


class MaskFilter:
    """The bit-sliced Bloom table of all languages."""

    def __init__(self, languages: list[str], slots: int = SLOTS, hashes: int = HASHES):
        self.languages, self.slots, self.hashes = languages, slots, hashes
        words = max(1, -(-len(languages) // 64))
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(k).itemsize * 8 >= min(64, len(languages)))
        self.table, self._rates = np.zeros((words, slots), kind), None

    def places(self, codes: np.ndarray) -> list[np.ndarray]:
        h = common.mix(codes)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + step * np.uint64(i)) % np.uint64(self.slots)).astype(np.int64) for i in range(self.hashes)]

    def add(self, language: int, codes: np.ndarray) -> None:
        self._rates = None
        row, bit = self.table[language // 64], self.table.dtype.type(1 << (language % 64))
        for p in self.places(codes):
            np.bitwise_or.at(row, p, bit)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it: the AND of its slots."""
        out = None
        for p in self.places(codes):
            out = self.table[:, p] if out is None else out & self.table[:, p]
        return out

    def false_rates(self) -> np.ndarray:
        if self._rates is None:
            fill = [((self.table[i // 64] >> self.table.dtype.type(i % 64)) & self.table.dtype.type(1)).mean() for i in range(len(self.languages))]
            self._rates = np.array(fill) ** self.hashes
        return self._rates

    def hits(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts x languages: how many of a text's n-grams the table has for the language, false ones included."""
        masks = self.masks(codes)
        out = np.zeros((len(at) - 1, len(self.languages)))
        for i in range(len(self.languages)):
            hit = (masks[i // 64] >> masks.dtype.type(i % 64)) & masks.dtype.type(1)
            out[:, i] = np.diff(np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[at])
        return out

    def shares(self, column: pa.Array) -> np.ndarray:
        """Texts x languages: the corrected share of a text's n-grams that the language contains."""
        n, out = np.zeros((len(column), 1)), np.zeros((len(column), len(self.languages)))
        for codes, i, j, at in grams(column):
            out[i:j] += self.hits(codes, at)
            n[i:j, 0] += np.diff(at)
        rates = self.false_rates()
        return np.clip((out / np.maximum(1, n) - rates) / (1 - rates), 0, 1)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to partial (lang, gram, n)."""
    for b in batches:
        names, inverse = np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        for codes, i, j, at in grams(b.column(1)):
            owner = np.repeat(inverse[i:j], np.diff(at))
            for k in np.unique(owner):
                gram, n = np.unique(codes[owner == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def fit(rows: DataFrame, sample_docs: int = SAMPLE_DOCS, least_share: float = LEAST_SHARE) -> MaskFilter | None:
    """rows: doc_id, text, lang. Only the n-grams of a language that reach least_share come to the driver."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    part = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, int(min(1.0, sample_docs / n) * (1 << 20)))))
    drawn = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < part[F.col("lang")])
    each = common.map_arrow(drawn.select("lang", "text"), counted, "lang string, gram long, n long")
    each = each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    each = common.stored(each, "grams")
    totals = {(r["lang"], r["size"]): r["n"] for r in each.groupBy("lang", F.shiftright("gram", 56).alias("size")).agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*(F.lit(x) for (k, size), n in sorted(totals.items()) for x in (f"{size}:{k}", max(2.0, least_share * n))))
    frequent = each.where(F.col("n") >= least[F.concat_ws(":", F.shiftright("gram", 56).cast("string"), "lang")]).select("lang", "gram").toPandas()
    model = MaskFilter(sorted(sizes))
    for i, name in enumerate(model.languages):
        model.add(i, frequent.loc[frequent["lang"] == name, "gram"].to_numpy(np.int64).view(np.uint64))
    return model


def identify(docs: DataFrame, model: MaskFilter | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # slots x languages bits, whatever the data

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        names = np.array([*known.languages, "und"], object)
        for b in batches:
            shares = known.shares(b.column(2))
            lettered = b.column(1).to_numpy(zero_copy_only=False)
            best = np.where(lettered, shares.argmax(1), len(names) - 1)
            score = np.where(lettered, shares.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return common.map_arrow(rows, judged, f"doc_id {kind}, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learns outside the held-out fold."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(rows.where(common.remainder(F.col("doc_id"), folds) != held), sample_docs)
    out = identify(rows, model)
    return out.select("doc_id", (common.remainder(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")


def in_known_language(docs: DataFrame, model: MaskFilter | None, least: float = 0.1, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text has a letter and a best share of `least` or more; with no model, all with a letter."""
    lettered = docs.where(F.col(text_col).rlike(r"\p{L}"))
    if model is None:
        return lettered
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.shares(b.column(at)).max(1, initial=0) >= least))

    return common.map_arrow(lettered, kept, docs.schema)
