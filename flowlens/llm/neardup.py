"""Near-duplicate detection by HyperMinHash.

A document's set is its distinct word shingles. Each of 480 buckets has a hash of its own and keeps, of the
smallest hash of the set, the leading-zero count (6 bits) and the next 10 bits (mantissa). Equal sets are one
class from the start (a 128-bit digest of the sorted shingle hashes), so that copies never meet in pairs. The
first 240 compressed registers are cut into 40 bands of 6; documents that share a band are candidates. A candidate
pair is kept if its Jaccard estimate, the share of equal registers corrected for registers that collide by chance,
is not far below the limit, and becomes a link only after comparing the full sets.

No band is expanded into all its pairs. First each document meets one leader, a smallest id of its bands, and
verified links give components; a band within one component is done. In the others, members of different components
still have to meet: a band with up to 2,048 members outside its largest component is compared by registers inside
tasks, that component in blocks, and only pairs that the estimate lets pass come out: first the best one for each
member, and once the links among these have joined components, all that still lie between different ones. For the
first of these, a more crowded band, as of many documents around one shared passage, is dealt out again under each pair
of its key and a later band's, whose six registers must agree too, and so on, which only finds most links early. What
is still crowded then is compared whole, by the full sets, block against block; each such task gives a spanning forest
of its links. That work grows with the square of a band's members. Two documents at the limit of 0.8 share no band with
probability 5e-6; the estimate fails them with 3e-5. At 0.9 both are below 1e-10.

Null, empty and blank texts have the empty set and link with nothing. A text shorter than a shingle is one
shingle. Rows that share an id are one node. A row without an id is linked by its text like any other and comes after
all ids: its component is the smallest id in reach, or null, and then it is kept, if no row with an id is linked with
it. Ids lie below 2**62. A text lies in memory some 30 times over. Empty tables give empty results; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import common

#: Registers; the first BANDS * ROWS make bands, all serve the estimate.
REGISTERS, BANDS, ROWS = 480, 40, 6
MANTISSA = 10
#: Standard errors below the limit at which an estimate still sends a pair to verification.
SLACK = 4.0
#: Members of a band outside its largest component up to which it is compared by registers, the members of that
#: component in a block, and the number of agreeing bands from which any number is compared in search of best pairs.
CROWD, BLOCK, DEEPEST = 2048, 1024, 12
#: Shingles (expected) of a block that is compared by full sets.
BLOCK_SHINGLES = 1 << 20
#: From here on nodes stand for texts of rows without an id.
NAMELESS = 1 << 62
_U = np.uint64
_HASHES = common.mix(np.arange(1, 2 * REGISTERS + 1, dtype=_U) * _U(0xD1B54A32D192ED03)) | _U(1)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, on end, and n + 1 offsets."""
    body, at = common.text_bytes(column)
    body = common.fold(body)
    start, end, first = common.words(body, at)
    word = common.span_hash(common.running_hash(body), start, end)
    n, count = len(at) - 1, np.diff(first)
    rolled = np.zeros(max(0, len(word) - size + 1), _U)
    for k in range(size):
        rolled = rolled * _U(0x9E3779B97F4A7C15) + word[k : len(word) - size + 1 + k] if len(rolled) else rolled
        rolled = common.mix(rolled)
    out, offsets = [], np.zeros(n + 1, np.int64)
    for i in range(n):
        if count[i] >= size:
            own = np.unique(rolled[first[i] : first[i + 1] - size + 1])
        elif count[i]:
            own = count[i : i + 1].astype(_U)
            for w in range(first[i], first[i + 1]):
                own = common.mix(own * _U(0x9E3779B97F4A7C15) + word[w : w + 1])
        else:
            own = np.zeros(0, _U)
        out.append(own)
        offsets[i + 1] = offsets[i] + len(own)
    return np.concatenate(out) if out else np.zeros(0, _U), offsets


def registers(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts x buckets: leading zeros and mantissa of each bucket's smallest hash; 0xFFFF for the empty set."""
    n = len(at) - 1
    least = np.full((REGISTERS, n), ~_U(0))
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        # Blocks of texts small enough for the cache.
        cuts = [0, *np.flatnonzero(np.diff(at[full] // 32768)) + 1, len(full)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            own = full[a:b]
            block, where = sets[at[own[0]] : at[own[-1] + 1]], at[own] - at[own[0]]
            for j in range(REGISTERS):
                h = (block ^ _HASHES[2 * j]) * _HASHES[2 * j + 1]
                h ^= h >> _U(32)
                h *= _HASHES[2 * j]
                least[j, own] = np.minimum.reduceat(h, where)
    value = least.T | _U(1)
    zeros = (63 - np.floor(np.log2(value.astype(np.float64)))).clip(0, 63).astype(_U)
    mantissa = (value << zeros << _U(1)) >> _U(64 - MANTISSA)
    out = ((zeros << _U(MANTISSA)) | mantissa).astype(np.uint16)
    out[np.diff(at) == 0] = 0xFFFF
    return np.ascontiguousarray(out)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers of sets of n and m shingles.

    Two unrelated minima of n and m hashes fall into one cell of relative width 2**-MANTISSA with probability
    c = n m / (n + m)**2 / (2 ln 2) * 2**-MANTISSA; the share of equal registers is J + (1 - J) c.
    """
    equal = (a == b).mean(1)
    c = n * m / np.maximum(1, n + m) ** 2 / (2 * np.log(2)) / (1 << MANTISSA)
    return np.clip((equal - c) / (1 - c), 0, 1)


def nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text; rows without an id get one by their text, beyond all others."""
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64(F.col(text_col)), F.lit(NAMELESS))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), nameless).alias("doc_id"), F.col(text_col).alias("text"))


def signatures(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest (of the set), registers (binary)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, at = shingles(b.column(1), size)
            flat = registers(sets, at)
            digests = [hashlib.blake2b(sets[x:y].tobytes(), digest_size=16).digest() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in flat], pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_arrow(rows, signed, "doc_id long, n_shingles long, digest binary, registers binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """key, nth, node: each class under its bands, numbered."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.array([np.frombuffer(x, np.uint16) for x in b.column(1).to_pylist()], _U).reshape(-1, REGISTERS)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
            key = np.tile(np.arange(1, BANDS + 1, dtype=_U), (len(r), 1))
            for k in range(ROWS):
                key = common.mix(key * _U(0x9E3779B97F4A7C15) + r[:, :, k])
            nth = np.tile(np.arange(BANDS, dtype=np.int32), len(r))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(nth), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["key", "nth", "node"])

    return common.map_arrow(classes.select("node", "registers"), banded, "key long, nth int, node long")


def in_components(members: DataFrame, component: DataFrame) -> DataFrame:
    """members of bands that hold two components or more, with theirs (c)."""
    own = common.stored(members.join(component, "node", "left").select("key", "nth", "node", F.coalesce("component", "node").alias("c")), "own")
    open_ = common.stored(own.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key"), "open")
    return common.stored(own.join(open_, "key", "left_semi"), "members")


def _least(percent: int) -> float:
    limit = percent / 100
    return limit - SLACK * float(np.sqrt(limit * (1 - limit) / REGISTERS))


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x, np.uint16) for x in column.to_pylist()], np.uint16).reshape(-1, REGISTERS)


def likely_in_bands(members: DataFrame, classes: DataFrame, percent: int, best: bool, plain: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a key and that the estimate lets pass, compared inside tasks.

    best: only the pair with the highest estimate for each member. plain: keys are bands as they are, and a pair
    that shares several comes out of the first only.
    """
    least = _least(percent)

    def compared(nodes: np.ndarray, parts: np.ndarray, nth: int, n: np.ndarray, r: np.ndarray) -> tuple[list, list]:
        out_a, out_b = [], []
        top, mate = np.full(len(nodes), least), np.full(len(nodes), -1)
        for i in range(len(nodes) - 1):
            other = i + 1 + np.flatnonzero((parts[i + 1 :] != parts[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i])))
            for at in range(0, len(other), BLOCK):
                j = other[at : at + BLOCK]
                near = estimate(r[j], r[i], n[j].astype(float), float(n[i]))
                if best:
                    k = int(near.argmax())
                    if near[k] >= top[i]:
                        top[i], mate[i] = near[k], j[k]
                    up = near > top[j]
                    top[j[up]], mate[j[up]] = near[up], i
                    continue
                j = j[near >= least]
                if plain and len(j):
                    j = j[(r[j] == r[i])[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(2).argmax(1) == nth]
                out_a += np.minimum(nodes[i], nodes[j]).tolist()
                out_b += np.maximum(nodes[i], nodes[j]).tolist()
        if best:
            i = np.flatnonzero(mate >= 0)
            out_a, out_b = np.minimum(nodes[i], nodes[mate[i]]).tolist(), np.maximum(nodes[i], nodes[mate[i]]).tolist()
        return out_a, out_b

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = [c.to_numpy() for c in b.columns[:5]] + [_rows_of(b.column(5))]
            held = now if held is None else [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            cut = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            if len(cut):  # whole keys; the last may go on
                yield pairs_of([x[: cut[-1]] for x in held])
                held = [x[cut[-1] :] for x in held]
        if held is not None:
            yield pairs_of(held)

    def pairs_of(rows: list[np.ndarray]) -> pa.RecordBatch:
        cut = [0, *(np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1), len(rows[0])]
        out_a, out_b = [], []
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            got = compared(rows[1][x:y], rows[2][x:y], int(rows[3][x]), rows[4][x:y], rows[5][x:y])
            out_a += got[0]
            out_b += got[1]
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    rows = members.join(classes, "node").select("key", "node", "c", "nth", "n", "registers").repartition("key").sortWithinPartitions("key")
    return common.map_arrow(rows, met, "a long, b long").distinct()


def remaining_pairs(members: DataFrame, classes: DataFrame, percent: int, best: bool) -> DataFrame:
    """Likely pairs (a, b) of different components in the open bands (best: one for each member, crowded bands dealt out again; else without these)."""
    out, depth = None, 1
    while True:
        per = members.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "c")).alias("top"))
        bands = common.stored(per.select("key", (F.col("m") - F.col("top.n")).alias("strays"), F.col("top.c").alias("__top"), F.ceil(F.col("top.n") / BLOCK).alias("blocks")), "sizes")
        deepest = best and depth >= DEEPEST
        # Members of the largest component lie in one block each, all others in every block.
        small = members.join(bands if deepest else bands.where(F.col("strays") <= CROWD), "key")
        own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")))
        small = small.withColumn("block", F.explode(F.when(F.col("c") == F.col("__top"), own).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
        small = common.stored(small.select(F.when(F.col("blocks") > 1, F.xxhash64("key", "block")).otherwise(F.col("key")).alias("key"), "nth", "node", "c"), "small")
        found = likely_in_bands(small, classes, percent, best, depth == 1)
        out = common.stored(found if out is None else out.union(found), "likely")
        many = None if deepest or not best else common.stored(members.join(bands.where(F.col("strays") > CROWD).select("key"), "key", "left_semi"), "crowded")
        if many is None or many.isEmpty():
            return out.distinct()
        asked = many.select("node").distinct()
        asked = F.broadcast(asked) if asked.count() <= 200_000 else asked
        later = common.stored(band_rows(classes.join(asked, "node", "left_semi")), "later").toDF("__key", "__nth", "node")
        again = many.join(later, "node").where("__nth > nth").select(F.xxhash64("key", "__key").alias("key"), F.col("__nth").alias("nth"), "node", "c")
        again = common.stored(again, "again")
        split = common.stored(again.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key"), "split")
        members, depth = common.stored(again.join(split, "key", "left_semi"), "members"), depth + 1
        if members.isEmpty():
            return out.distinct()


def crowded_links(members: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that join all linked components of each band with more than CROWD strays, by comparing full sets.

    Strays and the largest component are dealt into blocks; each block of strays meets every block, itself too.
    """
    sized = members.join(classes.select("node", "n"), "node")
    per = sized.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum("n").alias("w")).groupBy("key").agg(F.sum("n").alias("m"), F.sum("w").alias("w"), F.max(F.struct("n", "c", "w")).alias("top"))
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_SHINGLES))
    per = per.where(F.col("m") - F.col("top.n") > CROWD)
    bands = common.stored(per.select("key", F.col("top.c").alias("__top"), blocks(F.col("m") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("strays"), blocks(F.col("top.n"), F.col("top.w")).alias("tops")), "crowds")
    if bands.isEmpty():
        return bands.select(F.col("key").alias("a"), F.col("key").alias("b"))
    top, hashed = F.col("c") == F.col("__top"), F.xxhash64("node")
    own = members.join(bands, "key").withColumn("own", F.when(top, F.col("strays") + F.pmod(hashed, F.col("tops"))).otherwise(F.pmod(hashed, F.col("strays"))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(top, F.col("strays")).otherwise(F.col("strays") + F.col("tops")) - 1))
    cells = own.select("key", "node", "c", "own", other.alias("other")).select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "c")

    def set_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, at = shingles(b.column(1), size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sets[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "set"])

    asked = common.stored(own.select("node").distinct(), "asked")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(asked, "node", "left_semi")
    sets = common.stored(common.map_arrow(texts, set_of, "node long, set binary"), "sets")

    def forest(rows: list[tuple]) -> list[tuple[int, int]]:
        whole, own = rows[0][1] == rows[0][2], np.array([r[3] for r in rows])
        node, part = np.array([r[4] for r in rows]), np.unique([r[5] for r in rows], return_inverse=True)[1]
        each = [np.frombuffer(r[6], _U) for r in rows]
        n = np.array([len(x) for x in each])
        at = np.concatenate([[0], np.cumsum(n)])
        ids = np.unique(np.concatenate(each), return_inverse=True)[1]
        has, out = np.zeros(ids.max(initial=0) + 1, np.uint8), []
        for i in range(len(rows) - 1):
            if not n[i]:
                continue
            has[ids[at[i] : at[i + 1]]] = 1
            got = np.concatenate([[0], np.cumsum(has[ids[at[i + 1] :]], dtype=np.int64)])
            shared = np.diff(got[at[i + 1 :] - at[i + 1]])
            has[ids[at[i] : at[i + 1]]] = 0
            near = (n[i + 1 :] > 0) & (100 * shared >= percent * (n[i] + n[i + 1 :] - shared)) & (whole | (own[i + 1 :] != own[i]))
            for j in i + 1 + np.flatnonzero(near):
                if part[j] != part[i]:
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
                    part[part == part[j]] = part[i]
        return out

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, cell in groupby(rows, key=lambda r: r[:3]):
            found = forest(list(cell))
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = cells.join(sets, "node").select("key", "low", "high", "own", "node", "c", "set").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return common.map_arrow(dealt, met, "a long, b long").distinct()


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sizes and registers let them reach the limit."""
    least = _least(percent)
    sign = classes.select("node", "n", "registers")
    both = pairs.join(sign.toDF("a", "na", "ra"), "a").join(sign.toDF("b", "nb", "rb"), "b")
    # Sets whose sizes differ by more than the limit allows cannot reach it.
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = estimate(_rows_of(b.column(4)), _rows_of(b.column(5)), b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float)) >= least
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep)) for x in b.columns[:2]], ["a", "b"])

    return common.map_arrow(both.select("a", "b", "na", "nb", "ra", "rb"), hopeful, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """Of the pairs (a, b), a stored table, those whose full sets reach the limit. A set is made once per class."""
    asked = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")

    def set_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, at = shingles(b.column(1), size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sets[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    wanted = texts.join(F.broadcast(asked) if pairs.count() <= 200_000 else asked, "node", "left_semi")
    sets = common.stored(common.map_arrow(wanted, set_of, "node long, set binary"), "sets")
    full = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep, pa.bool_())) for x in b.columns[:2]], ["a", "b"])

    return common.map_arrow(full.select("a", "b", "sa", "sb"), linked, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links), kept."""
    docs, id_col, text_col = nodes(docs, id_col, text_col), "doc_id", "text"
    signed = common.stored(signatures(docs, size, id_col, text_col), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("first"))
    classes = common.stored(classes.select(F.col("first.doc_id").alias("node"), F.col("first.n_shingles").alias("n"), F.col("first.registers").alias("registers"), "digest"), "classes")
    bands = common.stored(band_rows(classes), "bands")
    heads = bands.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    members = common.stored(bands.join(heads, "key"), "members")
    # Each class meets the one leader it shares most bands with; all else is left to the bands themselves.
    shared = members.where("a < node").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("n"))
    pairs = shared.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    pairs = common.stored(likely(pairs, classes, percent), "likely")
    links = common.stored(verified(pairs, docs, percent, size, id_col, text_col), "links")
    component = common.components(links)
    still = in_components(members.select("key", "nth", "node"), component)
    for best in (True, False):
        if still.isEmpty():
            break
        more = common.stored(remaining_pairs(still, classes, percent, best).join(pairs, ["a", "b"], "left_anti"), "more")
        links = common.stored(links.union(verified(more, docs, percent, size, id_col, text_col)), "links")
        if not best:
            links = common.stored(links.union(crowded_links(still, classes, docs, percent, size, id_col, text_col)), "links")
        component = common.components(links)
        if best:
            pairs = pairs.union(more)
            still = in_components(still.drop("c"), component)
    # Every document to its class, every class to its component; both joins read tables, so hot classes can be split.
    named = classes.join(component, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    named = common.stored(named, "named")
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    real = lambda c: F.when(c < NAMELESS, c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(own).alias("component_id"), real(F.col("doc_id")).eqNullSafe(real(own)).alias("kept"))
