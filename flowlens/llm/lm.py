"""Language-model scoring with a log-bilinear neural model.

Corpus counts of all training words are one distributed aggregate. The neural model has two levels. The first
predicts the class of the next token from the classes of the five before: each of the most frequent words is a
class, the end of a text is one, and all other words share classes by their last two bytes. Its predicted vector is
a sum of context vectors, each scaled by a vector of its place. The second predicts the word within a shared class
from the class before: each word that occurs often enough has a vector of its own, and one entry stands for the
rest, of which a word has its smoothed share by counts, with one place for unseen words. Both levels are normalised
by batched matrix products, so that every text has a proper probability.

Training is numpy, by noise-contrastive estimation with frequencies as the noise, on all training rows. First level: a
start on the whole texts of `sample_docs` documents (expected), drawn by a hash of the id, then a pass of every task
over its rows from that start, whose parameters are averaged by tokens. Second level: the counts of all pairs of a
class and the word after it are a distributed aggregate, on which the expected loss, noise included, is minimised by
Newton steps, a task per shared class.

The vocabulary with vectors grows with the corpus: words that occur `LEAST_COUNT` times, up to `WORDS`. The most
frequent words, `head` at most, are shipped to the scoring tasks; all rarer words get their counts by a join. Words of
equal count at either border are in or out together, or else in order of their bytes.

Null texts count as empty: one end token. If nothing was learned, every word counts 0 and the model is uniform.
Repeated rows are scored on their own, also of one id. A text's words lie in memory as Python objects, some 100
bytes each. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import common

CONTEXT, WIDTH = 5, 24
#: Neighbouring tokens of one step, and the noise classes that they share.
STEP, JOINT = 4096, 48
#: Noise words for each word, the ridge, and the Newton steps, of the second level.
NOISE, RIDGE, NEWTON = 8, 1.0, 8
#: Words with a vector of their own: how often they occur at least, and how many there are at most (codes have 16 bits).
LEAST_COUNT, WORDS = 40, 60_000
#: Pairs that a task holds before it counts them.
PAIRS = 1 << 21
#: Output classes: single words, shared classes, and the end of a text.
SINGLE, SHARED = 191, 64
CLASSES = SINGLE + SHARED + 1
END = CLASSES - 1
#: Words whose counts every task holds.
HEAD = 100_000
#: Documents of the start.
SAMPLE_DOCS = 1500
ADD = 0.1
#: Distinct words that a counting task holds before it passes them on.
FLUSH = 100_000


def shared_class(word: bytes) -> int:
    return SINGLE + zlib.crc32(word[-2:]) % SHARED


def word_lists(column: pa.Array) -> list[list[bytes]]:
    return [(t or b"").lower().split() for t in column.cast(pa.binary()).to_pylist()]


def counts(texts: DataFrame) -> DataFrame:
    """word, c: the count of every word of the column text."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return b

        for b in batches:
            for words in word_lists(b.column(0)):
                held.update(words)
            if len(held) > FLUSH:
                yield out()
        yield out()

    return common.map_arrow(texts.select("text"), partial, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counted: DataFrame, head: int) -> list[tuple[str, int]]:
    """The most frequent words, `head` at most, all those of some least count.

    A histogram of counts (sixteenths of powers of two) finds that count, so that no task sends more than its share.
    """
    level = F.floor(F.log2("c") * 16)
    kept, least = 0, None
    for r in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        if (kept := kept + r["n"]) > head:
            break
        least = r["level"]
    rows = counted.where(level >= least).collect() if least is not None else []
    return sorted(((r["word"], r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


class LogBilinear:
    """The first level: context vectors, place vectors, output vectors and biases."""

    def __init__(self, frequencies: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.noise = (frequencies + 1.0) / (frequencies + 1.0).sum()
        self.r = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        self.place = np.full((CONTEXT, WIDTH), 1.0, np.float32)
        self.bias = np.log(self.noise).astype(np.float32)
        self.rng = rng
        self.seen = [np.full(x.shape, 1e-3, np.float32) for x in self.parameters()]

    def parameters(self) -> tuple[np.ndarray, ...]:
        return self.r, self.q, self.place, self.bias

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parameters()])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.parameters():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def step(self, grads: list[np.ndarray], n: int, rate: float) -> None:
        """AdaGrad with the mean gradient of n tokens."""
        for x, g, s in zip(self.parameters(), grads, self.seen, strict=True):
            g /= n
            s += g * g
            x -= rate * g / np.sqrt(s)

    def learn(self, classes: np.ndarray, at: np.ndarray, rate: float = 0.05) -> None:
        """Noise-contrastive estimation with AdaGrad, once over whole texts; the partition function is taken as 1.

        A step takes neighbouring tokens, so that a vector is looked up and moved once for all places that a token takes.
        """
        base = (self.noise.cumsum(), np.log(JOINT * self.noise).astype(np.float32))
        line, where = self.line(classes, at)
        real = np.zeros(len(line), np.float32)
        real[where] = 1
        for a in self.rng.permutation(np.arange(CONTEXT, len(line), STEP)):
            own, live = line[a - CONTEXT : a + STEP], real[a : a + STEP, None]
            n, target = len(live), own[CONTEXT:]
            near, predicted = self.predicted(own)
            # Evenly spaced draws: by far less noise in the gradients than from independent ones.
            tried = np.minimum(np.searchsorted(base[0], (np.arange(JOINT) + self.rng.random()) / JOINT), CLASSES - 1)
            lean, out, right = self.bias - base[1], self.q[tried], self.q[target]
            wrong = predicted @ out.T
            wrong += lean[tried]
            np.tanh(wrong * np.float32(0.5), out=wrong)
            wrong += 1
            wrong *= live / 2
            miss = live * (np.tanh(((predicted * right).sum(1) + lean[target]) / 2) - 1)[:, None] / 2
            pull = wrong @ out + miss * right
            back, forth = np.zeros((2, len(own), WIDTH), np.float32)
            grads = [np.zeros_like(x) for x in self.parameters()]
            for k in range(CONTEXT):
                back[CONTEXT - 1 - k : CONTEXT - 1 - k + n] += pull * self.place[k]
                grads[2][k] = np.einsum("td,td->d", near[k], pull)
            np.multiply(miss, predicted, out=forth[CONTEXT:])
            order = np.argsort(own, kind="stable")
            first = np.flatnonzero(np.diff(own[order], prepend=-1))
            kinds = own[order[first]]
            for g, x in zip(grads, (back, forth), strict=False):
                g[kinds] = np.add.reduceat(x.take(order, 0), first)
            grads[3] += np.bincount(target, miss[:, 0], CLASSES).astype(np.float32)
            np.add.at(grads[1], tried, wrong.T @ predicted)
            np.add.at(grads[3], tried, wrong.sum(0))
            self.step(grads, max(1, int(live.sum())), rate)

    def line(self, classes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts on end with CONTEXT ends before each, and where each token lies."""
        where = np.arange(len(classes)) + CONTEXT * (np.repeat(np.arange(len(at) - 1), np.diff(at)) + 1)
        line = np.full(len(classes) + CONTEXT * (len(at) - 1), END, np.uint8)
        line[where] = classes
        return line, where

    def predicted(self, own: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The vectors at each place before, and the predicted ones, of all but the first CONTEXT tokens of a line."""
        n, held = len(own) - CONTEXT, self.r[own]
        near = [held[CONTEXT - 1 - k : CONTEXT - 1 - k + n] for k in range(CONTEXT)]
        out = near[0] * self.place[0]
        for x, p in zip(near[1:], self.place[1:], strict=True):
            out += x * p
        return near, out

    def log10(self, classes: np.ndarray, at: np.ndarray, block: int = 2048) -> np.ndarray:
        """Normalised log10 probabilities of the tokens of whole texts."""
        line, where = self.line(classes, at)
        q, out = np.ascontiguousarray(self.q.T), np.zeros(len(line))
        for a in range(CONTEXT, len(line), block):
            own = line[a - CONTEXT : a + block]
            logits = self.predicted(own)[1] @ q
            logits += self.bias
            np.clip(logits, -40, 40, out=logits)
            mine = logits[np.arange(len(logits)), own[CONTEXT:]].astype(np.float64)
            np.exp(logits, out=logits)
            out[a : a + block] = mine - np.log(logits.sum(1, dtype=np.float32))
        return out[where] / np.log(10)


class Within:
    """The second level: for each word with a vector, and the rest of each shared class, its vector and bias."""

    def __init__(self, words: list[bytes]):
        """words: those with a vector, the most frequent first."""
        n = len(words)
        self.n = n
        #: The class of each code: words, the rest of each shared class, the end.
        self.kind = np.array([i if i < SINGLE else shared_class(w) for i, w in enumerate(words)] + [SINGLE + g for g in range(SHARED)] + [END], np.int64)
        self.v = np.zeros((n + SHARED + 1, WIDTH), np.float32)
        self.b = np.zeros(n + SHARED + 1, np.float32)
        self.log_z = np.zeros((CLASSES, CLASSES))
        self.u = np.zeros((CLASSES, WIDTH), np.float32)

    def members(self, kind: int) -> np.ndarray:
        """Codes within a shared class; the last is its rest."""
        return np.flatnonzero(self.kind == kind)

    def put(self, u: np.ndarray, codes: np.ndarray, v: np.ndarray, b: np.ndarray) -> None:
        self.u = u
        for kind in range(SINGLE, END):
            self.b[self.members(kind)] = -np.inf  # nothing was counted,
            self.b[self.n + kind - SINGLE] = 0  # so that all is rest
        self.v[codes], self.b[codes] = v, b
        for kind in range(SINGLE, END):
            own = self.members(kind)
            logits = u @ self.v[own].T + self.b[own]
            top = logits.max(1)
            self.log_z[:, kind] = top + np.log(np.exp(logits - top[:, None]).sum(1))

    def log10(self, codes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log10 probabilities of codes within their classes, after the classes before; 0 for classes that are one word."""
        out = np.zeros(len(codes))
        kind = self.kind[codes]
        i = np.flatnonzero((kind >= SINGLE) & (kind != END))
        c = codes[i]
        out[i] = (np.einsum("td,td->t", self.u[before[i]], self.v[c]) + self.b[c] - self.log_z[before[i], kind[i]]) / np.log(10)
        return out


def fit_within(u: np.ndarray, n: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and biases of the words of one class from the counts n (class before x word).

    The loss of noise-contrastive estimation, expected over the noise, is convex for each word; Newton steps with a ridge.
    """
    q = (n.sum(0) + 1.0) / (n.sum(0) + 1.0).sum()
    x = np.concatenate([u.astype(float), np.ones((len(u), 1))], 1)
    square = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    of_noise, d = NOISE * n.sum(1)[:, None], x.shape[1]
    out = np.zeros((n.shape[1], d))
    out[:, -1] = np.log(q)
    start = out.copy()
    for a in range(0, n.shape[1], block):
        own, shift, w = n[:, a : a + block], np.log(NOISE * q[a : a + block]), out[a : a + block]
        noise = of_noise * q[a : a + block]
        for _ in range(NEWTON):
            p = 1 / (1 + np.exp(-np.clip(x @ w.T - shift, -30, 30)))
            g = (noise * p - own * (1 - p)).T @ x + RIDGE * (w - start[a : a + block])
            h = (((noise + own) * p * (1 - p)).T @ square).reshape(-1, d, d) + RIDGE * np.eye(d)
            step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
            w -= step * np.minimum(1, 3 / np.maximum(1e-9, np.abs(step).max(1, keepdims=True)))
    return out[:, :-1].astype(np.float32), out[:, -1].astype(np.float32)


class Scorer:
    """What a reading task holds: the head's words."""

    def __init__(self, head: list[tuple[bytes, int]], ends: int, words: int):
        self.place = {w: i for i, (w, _) in enumerate(head)}
        self.count = np.array([c for _, c in head] + [0], float)  # the last: words that are not here
        self.code = np.array([i if i < words else words + shared_class(w) - SINGLE for i, (w, _) in enumerate(head)] + [-1])
        self.ends, self.words = ends, words

    def ids(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """Head places, codes (an end after each text), offsets, and each text's words outside the head."""
        get, n = self.place.get, len(self.place)
        at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lists])]).astype(np.int64)
        places = np.full(at[-1], -1, np.int64)
        codes = np.full(at[-1], self.words + SHARED, np.int64)
        tails = []
        for words, a in zip(lists, at, strict=False):
            p = np.array([get(w, n) for w in words], np.int64)
            k = self.code[p]
            rare = np.flatnonzero(p == n).tolist()
            own = [words[i] for i in rare]
            k[rare] = [self.words + shared_class(w) - SINGLE for w in own]
            places[a : a + len(p)], codes[a : a + len(p)] = p, k
            tails.append(own)
        return places, codes, at, tails


def codes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts on end, and offsets."""
    body, at = common.text_bytes(column)
    return np.frombuffer(body.tobytes(), "<u2").astype(np.int64), at // 2


def trained(model: LogBilinear, within: Within, texts: DataFrame, share: float) -> None:
    """Train the first level: a start on a share of the texts (doc_id, codes; drawn by a hash), then a pass of each task over
    all of its own, whose parameters are averaged by tokens; the second from the pairs that the same pass counts."""
    spark = texts.sparkSession
    drawn = texts.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)))
    for rate in (0.2, 0.1):
        held: list[bytes] = []
        for r in drawn.select("codes").toLocalIterator():
            held.append(bytes(r["codes"]))
            if sum(map(len, held)) > common.BATCH_BYTES:
                codes, at = codes_of(pa.array(held, pa.binary()))
                model.learn(within.kind[codes], at, rate)
                held = []
        if held:
            codes, at = codes_of(pa.array(held, pa.binary()))
            model.learn(within.kind[codes], at, rate)
    begun = spark.sparkContext.broadcast((model, within.kind))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first, kind), n, pairs, waiting = begun.value, 0, [], 0
        own = copy.deepcopy(first)

        def rows(key: np.ndarray, value: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(value.astype(float)), pa.array(n.astype(np.int64))], ["key", "value", "n"])

        def counted() -> pa.RecordBatch:
            key, count = np.unique(np.concatenate(pairs), return_counts=True)
            pairs.clear()
            return rows(key, count, np.zeros(len(key)))

        for b in batches:
            codes, at = codes_of(b.column(0))
            kinds = kind[codes]
            own.learn(kinds, at)
            n += len(codes)
            before = previous(kinds, at)
            inner = np.flatnonzero((kinds >= SINGLE) & (kinds != END))
            pairs.append((before[inner] << 16 | codes[inner]).astype(np.uint32))
            if (waiting := waiting + len(inner)) > PAIRS:
                yield counted()
                waiting = 0
        if waiting:
            yield counted()
        if n:
            flat = own.flat().astype(float)
            yield rows(-1 - np.arange(len(flat)), flat * n, np.full(len(flat), n))

    each = common.map_arrow(texts.select("codes"), passed, "key int, value double, n long")
    each = common.stored(each.groupBy("key").agg(F.sum("value").alias("value"), F.sum("n").alias("n")), "learned")
    mean = each.where("key < 0").select("key", (F.col("value") / F.col("n")).alias("value")).collect()  # the first level's parameters
    if mean:
        model.put(np.array([r["value"] for r in sorted(mean, key=lambda r: -r["key"])], np.float32))
    u = model.r * model.place[0]
    kinds = spark.sparkContext.broadcast((within, u))

    def fitted(table: pa.Table) -> pa.Table:
        within, u = kinds.value
        key = table.column("key").to_numpy()
        own = within.members(int(table.column("kind")[0].as_py()))
        n = np.zeros((CLASSES, len(own)))
        n[key >> 16, np.searchsorted(own, key & 0xFFFF)] = table.column("value").to_numpy()
        v, b = fit_within(u, n)
        return pa.table({"code": pa.array(own, pa.int32()), "v": pa.array([x.tobytes() for x in v], pa.binary()), "b": pa.array(b.astype(float))})

    pairs = each.where("key >= 0").select("key", "value", F.col("key").bitwiseAND(0xFFFF).alias("code"))
    table = spark.createDataFrame([(k, int(g)) for k, g in enumerate(within.kind.tolist())], "code int, kind int")
    got = pairs.join(F.broadcast(table), "code").select("kind", "key", "value").groupBy("kind").applyInArrow(fitted, "code int, v binary, b double").collect()
    codes = np.array([r["code"] for r in got], np.int64)
    v = np.array([np.frombuffer(r["v"], np.float32) for r in got], np.float32).reshape(-1, WIDTH)
    within.put(u, codes, v, np.array([r["b"] for r in got], np.float32))


def previous(kinds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The class before each token; END before a text."""
    out = np.full(len(kinds), END, np.int64)
    out[1:] = kinds[:-1]
    out[at[:-1][np.diff(at) > 0]] = END
    return out


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0, head: int = HEAD, sample_docs: int = SAMPLE_DOCS, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (common.remainder(F.col(id_col), folds) == held).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    counted = common.stored(counts(training), "counts")
    ends = training.count()
    total, types = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, types = total + ends, types + (ends > 0)
    denominator = np.log10(total + ADD * (types + 1))
    top = [(w.encode(), c) for w, c in most_frequent(counted, head)]
    words = [w for i, (w, c) in enumerate(top[:WORDS]) if c >= least_count or i < SINGLE]
    scorer, within = Scorer(top, ends, len(words)), Within(words)
    # Mass and types of each class, and of what has no vector in it.
    last = F.expr("right(hex(word), 4)")
    mass, rest = np.zeros(CLASSES), np.zeros((2, CLASSES))
    for r in counted.groupBy(last.alias("last")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toLocalIterator():
        k = shared_class(bytes.fromhex(r["last"]))
        mass[k] += r["c"]
        rest[:, k] += r["c"], r["n"]
    for i, (w, c) in enumerate(top[: len(words)]):
        rest[:, shared_class(w)] -= c, 1
        if i < SINGLE:
            mass[shared_class(w)] -= c
            mass[i] = c
    mass[END] = ends
    spare = np.log10(rest[0] + ADD * (rest[1] + 1))
    shipped = spark.sparkContext.broadcast((scorer, spare))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, spare = shipped.value
        logs = np.log10(own.count + ADD)
        for b in batches:
            places, codes, at, tails = own.ids(word_lists(b.column(1)))
            log_c = np.where(places < 0, np.log10(own.ends + ADD), logs[places])
            log_c[places == len(own.place)] = 0  # they come by the join
            without = (codes >= own.words) & (codes < own.words + SHARED)
            share = np.where(without, log_c - spare[np.where(without, codes - own.words + SINGLE, 0)], 0)
            known = (places >= 0) & (places < len(own.place)) | (places < 0) & (own.ends > 0)
            sums = [np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.zeros(0) for x in (known.astype(np.int64), log_c, share)]
            words = pa.array([x for t in tails for x in t], pa.binary()).cast(pa.string())
            tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tails])]), pa.int32()), words)
            line = codes.astype("<u2")
            each = pa.array([line[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(at)), *map(pa.array, sums), tail, each], ["doc_id", "held_out", "n_tokens", "known", "base", "share", "tail", "codes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    first = common.map_arrow(rows, read, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, share double, tail array<string>, codes binary")
    first = common.stored(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    model = LogBilinear(mass)
    trained(model, within, first.where(~F.col("held_out")).select("doc_id", "codes"), min(1.0, sample_docs / ends) if ends else 0.0)
    learned = spark.sparkContext.broadcast((model, within))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, within = learned.value
        for b in batches:
            codes, at = codes_of(b.column(6))
            kinds = within.kind[codes]
            logs = own.log10(kinds, at) + within.log10(codes, previous(kinds, at))
            model = (np.add.reduceat(logs, at[:-1]) if len(at) > 1 else np.zeros(0)) + b.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(model), b.column(7)], ["doc_id", "held_out", "n_tokens", "known", "base", "model", "row"])

    tails = first.select("row", F.explode("tail").alias("word")).join(counted, "word", "left")
    rest = tails.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("more"), F.count("c").alias("also"))
    own = first.select("doc_id", "held_out", "n_tokens", "known", "base", "share", "codes", "row")
    out = common.map_arrow(own, scored, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double, row long").join(rest, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(float(denominator))).alias("base_score"), (F.col("model") + more).alias("score"),
    )
