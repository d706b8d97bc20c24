"""Toxicity by nearest labelled examples: exact TF-IDF cosine on a block-max inverted index.

Terms are whole words, word beginnings of 4 to 8 bytes, and the word beginning of no byte, which every word has
and which so tells how much text there is. The vocabulary is the terms whose document counts differ most between
the two labels (likelihood ratio G2 of at least `least_g2`, `vocabulary` terms at most); document frequencies
are over all documents. Weights are (1 + ln tf) (1 + ln((1 + N) / (1 + df))), vectors have length 1.

Labelled examples lie in blocks of similar ones; each block keeps its terms' largest weights. A query's bound for
a block is the sum of its weights times those maxima; blocks are opened in the order of their bounds, and none
whose bound cannot beat the k-th best cosine so far, so the k nearest are exact. Their votes, weighted by
closeness and by how many labelled rows an example stands for, give a raw share, which a logistic fit on other
labelled rows calibrates. The nearest examples are returned as evidence.

Bounds of the fit: `fit_docs` labelled documents for the vocabulary, `examples` of either label for the index
and as many for the calibration (all expected sizes, drawn by a hash of the id). Everything else covers all
documents and whole texts. Null texts count as empty. Without labelled rows, or with one label only, the score is
the share of label 1 (0.5 without any). Repeated rows are judged on their own. Of equal cosines, the example found first
stays, in the order of the blocks' bounds for that query; terms of equal G2 at the border of the vocabulary go by their
bytes. A text's words lie in memory as Python objects, some 60 bytes each. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import common

BEGINNINGS = (4, 5, 6, 7, 8)
FIT_DOCS, EXAMPLES, VOCABULARY, LEAST_G2 = 8000, 1500, 512, 25.0
NEAREST, BLOCK = 25, 32
MEMO_WORDS = 200_000


def _fold_table() -> bytes:
    t = bytearray(b" " * 128 + bytes(range(128, 256)))
    for i in range(26):
        t[65 + i] = t[97 + i] = 97 + i
    return bytes(t)


_FOLD = _fold_table()


def word_lists(column: pa.Array) -> list[list[bytes]]:
    """Runs of letters (and characters beyond ASCII), A-Z in lower case."""
    return [(t or b"").translate(_FOLD).split() for t in column.cast(pa.binary()).to_pylist()]


def terms_of(word: bytes) -> list[bytes]:
    """The terms of a word: itself, marked by a blank, and its beginnings."""
    return [word + b" ", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


def label_counts(rows: DataFrame) -> DataFrame:
    """(text, label) to term, p, n: documents of label 1 and of label 0 that have the term."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(), Counter()

        def out() -> pa.RecordBatch:
            terms = list({*held[0], *held[1]})
            b = pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array([held[1][t] for t in terms], pa.int64()), pa.array([held[0][t] for t in terms], pa.int64())], ["term", "p", "n"])
            held[0].clear()
            held[1].clear()
            return b

        for b in batches:
            for words, label in zip(word_lists(b.column(0)), b.column(1).to_pylist(), strict=True):
                held[label].update({t for w in set(words) for t in terms_of(w)})
            if len(held[0]) + len(held[1]) > MEMO_WORDS:
                yield out()
        yield out()

    each = common.map_arrow(rows.select("text", "label"), partial, "term binary, p long, n long")
    return each.groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def choose_terms(counted: DataFrame, positive: int, negative: int, most: int, least_g2: float) -> list[bytes]:
    """The terms that tell the labels apart best; the likelihood ratio of the 2 x 2 table of documents."""
    total = float(positive + negative)
    part = lambda o, row, col: F.when(o > 0, 2 * o * F.log(o * total / (row * col))).otherwise(0.0)
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    with_, without = p + n, F.lit(total) - p - n
    g2 = part(p, with_, F.lit(positive)) + part(n, with_, F.lit(negative)) + part(positive - p, without, F.lit(positive)) + part(negative - n, without, F.lit(negative))
    best = counted.where((p + n >= 4) & (p + n < total)).withColumn("g2", F.round(g2, 6)).where(F.col("g2") >= least_g2)
    return [bytes(r["term"]) for r in best.orderBy(F.desc("g2"), "term").limit(most).collect()]


class _Memo(dict):
    """Word to the places of its vocabulary terms (None: none), worked out once."""

    def __init__(self, places: dict[bytes, int]):
        super().__init__()
        self.places = places

    def __missing__(self, word: bytes):
        own = self[word] = [self.places[t] for t in terms_of(word) if t in self.places] or None
        return own


def vectors(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """doc_id, terms (places in the vocabulary), tf, n_words; and a row per task, marked by `counts`, with its terms' documents."""
    places = {t: i for i, t in enumerate(vocabulary)}

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, documents, n_docs = _Memo(places), Counter(), 0

        def out(ids: pa.Array, terms: list, tf: list, n: list, counts: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array([counts] * len(n))], ["doc_id", "terms", "tf", "n_words", "counts"])

        kind = None
        for b in batches:
            kind = b.column(0).type
            if len(memo) > MEMO_WORDS:
                memo = _Memo(places)
            terms, tf, n = [], [], []
            for words in word_lists(b.column(1)):
                hit = Counter(t for x in map(memo.__getitem__, words) if x for t in x)
                terms.append(sorted(hit))
                tf.append([hit[t] for t in terms[-1]])
                n.append(len(words))
                documents.update(hit.keys())
            n_docs += len(n)
            yield out(b.column(0), terms, tf, n, False)
        if kind is not None:
            seen_terms = sorted(documents)
            yield out(pa.nulls(1, kind), [seen_terms], [[documents[t] for t in seen_terms]], [n_docs], True)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return common.map_arrow(rows, seen, f"doc_id {kind}, terms array<int>, tf array<int>, n_words long, counts boolean")


def weigh(terms: list, tf: list, n_words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of TF-IDF weights; the last column is the term that every word has."""
    out = np.zeros((len(terms), len(idf)), np.float32)
    for i, (t, f) in enumerate(zip(terms, tf, strict=True)):
        out[i, t] = 1 + np.log(np.asarray(f, float))
    out[:, -1] = np.where(n_words > 0, 1 + np.log(np.maximum(n_words, 1)), 1.0)
    out *= idf
    return out / np.linalg.norm(out, axis=1, keepdims=True)


class BlockMaxIndex:
    """Examples in blocks; per block the postings of its terms and their largest weights."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, ids: np.ndarray):
        # Similar examples next to each other: by their heaviest term, then by its weight.
        heavy = rows.argmax(1)
        order = np.lexsort((ids, rows[np.arange(len(rows)), heavy], heavy))
        self.labels, self.weights, self.ids = labels[order], weights[order], ids[order]
        self.blocks, maxima = [], []
        for at in range(0, len(order), BLOCK):
            own = rows[order[at : at + BLOCK]]
            held = np.flatnonzero(own.any(0))
            self.blocks.append((at, held, np.ascontiguousarray(own[:, held].T)))
            maxima.append(own.max(0))
        self.maxima = np.array(maxima).T.copy()

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact k nearest examples of each row: cosines (descending) and places."""
        k = min(k, len(self.ids))
        best = np.full((len(q), k), -1.0, np.float32)
        place = np.zeros((len(q), k), np.int64)
        bounds = q @ self.maxima + np.float32(1e-5)
        order = np.argsort(-bounds, axis=1, kind="stable")
        live = np.arange(len(q))
        for nth in range(len(self.blocks)):
            blocks = order[live, nth]
            open_ = bounds[live, blocks] > best[live, -1]
            live, blocks = live[open_], blocks[open_]
            if not len(live):
                break
            for b in np.unique(blocks):
                at, held, postings = self.blocks[b]
                own = live[blocks == b]
                sims = np.concatenate([best[own], q[np.ix_(own, held)] @ postings], 1)
                where = np.concatenate([place[own], np.broadcast_to(np.arange(at, at + postings.shape[1]), (len(own), postings.shape[1]))], 1)
                keep = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                best[own] = np.take_along_axis(sims, keep, 1)
                place[own] = np.take_along_axis(where, keep, 1)
        return best, place

    def share(self, best: np.ndarray, place: np.ndarray, prior: float) -> np.ndarray:
        """The share of label 1 among the votes, one vote of the prior added."""
        vote = self.weights[place] / (1.02 - np.minimum(best, 1.0))
        one = self.weights.mean()
        return ((vote * self.labels[place]).sum(1) + one * prior) / (vote.sum(1) + one)


def platt(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of y on the logit of raw (Newton steps, a light ridge towards the identity)."""
    x = np.stack([np.ones(len(raw)), np.log(raw / (1 - raw))], 1)
    start = w = np.array([0.0, 1.0])
    weight = weight / weight.mean()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ((w - start) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + (w - start)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(h, g)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return float(w[0]), float(max(w[1], 0.05))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held: int = 0, fit_docs: int = FIT_DOCS, examples: int = EXAMPLES, vocabulary: int = VOCABULARY, least_g2: float = LEAST_G2) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence (ids and cosines of the 3 nearest examples)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held_out = (common.remainder(F.col("doc_id"), folds) == held).alias("held_out")
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    marks = common.stored(marks.where(common.remainder(F.col("doc_id"), folds) != held), "marks")
    sizes = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())

    def without_examples(constant: float) -> DataFrame:
        out = rows.select("doc_id", held_out, F.lit(constant).alias("score"))
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("evidence", F.array().cast("array<struct<doc_id:string,cosine:float>>"))

    draw = lambda salt: F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    if len(sizes) < 2:
        return without_examples(sizes.get(1, 0) / total if total else 0.5)
    drawn = common.stored(rows.join(marks.where(draw("terms") < min(1.0, fit_docs / total)), "doc_id"), "fit-docs")
    fitted = {r["label"]: r["n"] for r in drawn.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = choose_terms(label_counts(drawn), fitted.get(1, 0), fitted.get(0, 0), vocabulary, least_g2) if len(fitted) > 1 else []
    every = common.stored(vectors(rows, chosen, "doc_id", "text"), "vectors")
    seen, tasks = every.where("not counts").drop("counts"), every.where("counts")
    n = tasks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    df = np.zeros(len(chosen) + 1)
    each = tasks.select(F.explode(F.arrays_zip("terms", "tf")).alias("x")).groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.tf").alias("df"))
    for r in each.collect():
        df[r["t"]] = r["df"]
    df[-1] = n
    idf = (1 + np.log((1 + n) / (1 + df))).astype(np.float32)
    rate = F.when(F.col("label") == 1, F.lit(min(1.0, 2 * examples / sizes[1]))).otherwise(F.lit(min(1.0, 2 * examples / sizes[0])))
    sample = seen.join(marks.withColumn("u", draw("examples")).where(F.col("u") < rate), "doc_id").orderBy("u", "doc_id").toPandas()
    if sample["label"].nunique() < 2 or len(sample) < 4:
        return without_examples(sizes[1] / total)
    x = weigh(sample["terms"], sample["tf"], sample["n_words"].to_numpy(), idf)
    y, ids = sample["label"].to_numpy(), sample["doc_id"].astype(str).to_numpy()
    stands = np.array([sizes[k] / max(1, (y == k).sum()) for k in (0, 1)])[y]
    prior = sizes[1] / total
    even = np.arange(len(y)) % 2 == 0
    index = BlockMaxIndex(x[even], y[even], stands[even], ids[even])
    raw = index.share(*index.nearest(x[~even], NEAREST), prior)
    shift, slope = platt(raw, y[~even], stands[~even])
    shipped = spark.sparkContext.broadcast((index, idf, prior, shift, slope))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, idf, prior, shift, slope = shipped.value
        for b in batches:
            q = weigh([x or [] for x in b.column(1).to_pylist()], [x or [] for x in b.column(2).to_pylist()], b.column(3).to_numpy(), idf)
            first: dict[bytes, int] = {}
            same = np.array([first.setdefault(r.tobytes(), len(first)) for r in q], np.int64)
            best, place = index.nearest(q[np.unique(same, return_index=True)[1]], NEAREST)
            raw = index.share(best, place, prior)
            score = 1 / (1 + np.exp(-(shift + slope * np.log(raw / (1 - raw)))))
            near = [[{"doc_id": index.ids[p], "cosine": float(c)} for p, c in zip(ps[:3], cs[:3], strict=True)] for ps, cs in zip(place, best, strict=True)]
            kind = pa.list_(pa.struct([("doc_id", pa.string()), ("cosine", pa.float32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score[same]), pa.array([near[i] for i in same], kind)], ["doc_id", "score", "evidence"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = common.map_arrow(seen, judged, f"doc_id {kind}, score double, evidence array<struct<doc_id:string,cosine:float>>")
    return out.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
