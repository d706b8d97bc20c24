"""A random forest whose trees are grown whole, each by one task, on rows held as bin codes.

1. Features are cut into BINS bins at quantiles of all training rows. A row becomes a byte per feature; equal rows of one
   label become one with a count, which loses nothing: a row's weight in a tree is a Poisson draw, and draws add up.
2. The coded rows are packed in the order of their codes and go to each group of trees. A tree draws the weights and is
   grown level by level: rows lie by node, histograms of a few thousand nodes are made at once, and of the square root
   of the features, drawn anew for each node, the split of the largest Gini gain is taken.
3. With the trees of its group a task scores all test rows as they stream by; the groups' sums are added as whole
   numbers, so that their order does not matter.

No forest goes through the driver, which sees bin borders and one number per tree and feature. A task holds the distinct
coded rows (a byte per feature and some 20 more) and its own trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import contracts
from flowlens.streaming.flows import stored

BINS = 32
#: Quantiles looked at for borders: a value with a larger share of the rows than 1 / QUANTILES has a bin of its own if there are BINS such values at most.
QUANTILES = 1000
#: Rows of a packed block; rows and nodes whose histograms are made at once.
BLOCK, ROWS, NODES = 1 << 16, 1 << 16, 1 << 11
#: Probabilities are added as multiples of this.
UNIT = 2.0**-40


def borders(rows: DataFrame, width: int) -> list[np.ndarray]:
    """For each place of the array column x the first values of all bins but the lowest."""
    at = F.array(*(F.lit(i / QUANTILES) for i in range(QUANTILES + 1)))
    n, *found = rows.agg(F.count("*"), *(F.percentile_approx(F.col("x")[i], at, 10 * QUANTILES).alias(f"q{i}") for i in range(width))).first()
    if not n:
        raise contracts.ContractError("no rows to fit")
    out = []
    for q in found:
        q = np.array(q if q is not None else [], np.float64)
        values = np.unique(q)
        if len(values) > BINS:
            values = np.unique(q[np.arange(BINS) * QUANTILES // BINS])
        out.append(values[1:])
    return out


def _codes(b: pa.RecordBatch, cuts: list[np.ndarray]) -> np.ndarray:
    """Rows x features of bin codes; what is missing or not a number counts as the largest."""
    x = np.nan_to_num(b.column("x").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf, neginf=-np.inf).reshape(b.num_rows, len(cuts))
    out = np.empty(x.shape, np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, x[:, i], "right")
    return out


def _blocks(rows: DataFrame, pack, schema: str) -> DataFrame:
    """nth and one row of packed columns per block of rows, in the order of the rows."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, held, n = TaskContext.get().partitionId() << 24, [], 0
        for b in (x.slice(i, BLOCK) for x in batches for i in range(0, x.num_rows, BLOCK)):
            held.append(b)
            n += b.num_rows
            if n >= BLOCK:
                yield out(nth, held)
                nth, held, n = nth + 1, [], 0
        if n:
            yield out(nth, held)

    def out(nth: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=1)
        cols = pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        return pa.RecordBatch.from_arrays([pa.array([nth]), pa.array([sum(b.num_rows for b in held)]), *(pa.array([press.compress(np.ascontiguousarray(c).tobytes())], pa.binary()) for c in cols)], ["nth", "n", "codes", "ids", "marks"])

    return rows.mapInArrow(packed, schema)


_BLOCKS = "nth long, n long, codes binary, ids binary, marks binary"


def _train_blocks(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Distinct coded rows in their order, their counts as ids and their labels as marks."""
    width = len(cuts)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = _codes(b, cuts)
            at = np.arange(len(c) + 1, dtype=np.int32) * np.int32(width)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(at), pa.py_buffer(c.tobytes())]), b.column("y")], ["codes", "y"])

    def pack(b: pa.RecordBatch) -> list[np.ndarray]:
        c = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8)
        return [c, b.column("k").to_numpy().astype(np.int64), b.column("y").to_numpy().astype(np.uint8)]

    each = rows.select("x", "y").mapInArrow(coded, "codes binary, y int").groupBy("codes", "y").agg(F.count("*").alias("k"))
    return _blocks(each.orderBy("codes", "y"), pack, _BLOCKS)


def _test_blocks(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Coded rows with ids, labels as marks."""
    return _blocks(rows.select("x", "id", "y"), lambda b: [_codes(b, cuts), b.column("id").to_numpy().astype(np.int64), b.column("y").to_numpy().astype(np.uint8)], _BLOCKS)


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of nodes with ROWS rows and NODES nodes at most, but one node at least."""
    upto, i = np.cumsum(sizes), 0
    while i < len(sizes):
        before = int(upto[i - 1]) if i else 0
        j = min(max(i + 1, int(np.searchsorted(upto, before + ROWS, "right"))), i + NODES)
        yield i, j
        i = j


def grow(codes: np.ndarray, marks: np.ndarray, weights: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A tree by nodes (feature or -1, bin that still goes left, left child, share of label 1) and the features' summed gains.

    codes: rows x features; marks: 0 or 1; the right child follows the left one. A node stays a leaf at the depth, if
    one label is left, or if none of its drawn features splits it with a gain.
    """
    width = codes.shape[1]
    few = int(np.ceil(np.sqrt(width)))
    flat, gains = codes.reshape(-1), np.zeros(width)
    rows = np.flatnonzero(weights)
    both = np.bincount(marks[rows], weights[rows], 2)
    counts = both[None, :]
    value = [np.array([both[1] / both.sum() if both.sum() else 0.0], np.float32)]
    feature, cut, left = [np.full(1, -1, np.int16)], [np.zeros(1, np.uint8)], [np.zeros(1, np.int32)]
    sizes, nodes, total = np.array([len(rows)]), np.array([0]), 1  # nodes that may be split: rows by node, their number
    if not both.all():
        sizes = sizes[:0]
    for _ in range(depth):
        if not len(sizes):
            break
        start = np.concatenate([[0], np.cumsum(sizes)])
        kept, new_sizes, new_nodes, new_counts = [], [], [], []
        at = np.concatenate(feature), np.concatenate(cut), np.concatenate(left)
        born = []
        for i, j in _chunks(sizes):
            r, m = rows[start[i] : start[j]], j - i
            own = np.repeat(np.arange(m), sizes[i:j])
            w, base = weights[r], own * (2 * BINS) + marks[r] * BINS
            tried = np.argsort(rng.random((m, width), np.float32), 1)[:, :few]
            t0, t1 = counts[i:j, 0, None], counts[i:j, 1, None]
            parent = (2 * t0 * t1 / (t0 + t1))[:, 0]
            best, split, chosen, l0, l1 = np.full(m, 1e-9), np.zeros(m, np.int64), np.full(m, -1), np.zeros(m), np.zeros(m)
            for k in range(few):
                code = flat[r * width + tried[own, k]]
                h = np.bincount(base + code, w, m * 2 * BINS).reshape(m, 2, BINS)[:, :, :-1].cumsum(2)
                a0, a1 = h[:, 0], h[:, 1]
                n, other = a0 + a1, t0 + t1 - a0 - a1
                gain = np.where((n > 0) & (other > 0), parent[:, None] - 2 * a0 * a1 / np.maximum(n, 1) - 2 * (t0 - a0) * (t1 - a1) / np.maximum(other, 1), -1.0)
                b = gain.argmax(1)
                g = gain[np.arange(m), b]
                better = np.flatnonzero(g > best)
                best[better], split[better], chosen[better] = g[better], b[better], tried[better, k]
                l0[better], l1[better] = a0[better, b[better]], a1[better, b[better]]
            done = np.flatnonzero(chosen >= 0)
            if not len(done):
                continue
            np.add.at(gains, chosen[done], best[done])
            node = nodes[i:j][done]
            at[0][node], at[1][node] = chosen[done], split[done]
            child = total + 2 * np.arange(len(done))
            at[2][node] = child
            total += 2 * len(done)
            # Two children per split node, left first: their counts, shares, and whether they may be split on.
            c = np.empty((len(done), 2, 2))
            c[:, 0, 0], c[:, 0, 1] = l0[done], l1[done]
            c[:, 1] = counts[i:j][done] - c[:, 0]
            c = c.reshape(-1, 2)
            born.append((c[:, 1] / c.sum(1)).astype(np.float32))
            goes_on = (c > 0).all(1)
            # Rows of a node stay together: those that go left first.
            slot = np.full(m, -1)
            slot[done] = np.arange(len(done)) * 2
            side = flat[r * width + np.maximum(chosen, 0)[own]] > split[own]
            to = slot[own] + side
            stay = (slot[own] >= 0) & goes_on[to]
            to, r = to[stay], r[stay]
            kept.append(r[np.argsort(to.astype(np.uint16), kind="stable")])
            n = np.bincount(to, minlength=len(c))[goes_on]
            new_sizes.append(n)
            new_nodes.append((child[:, None] + np.arange(2)).reshape(-1)[goes_on])
            new_counts.append(c[goes_on])
        fresh = np.concatenate(born) if born else np.zeros(0, np.float32)
        feature, cut, left = ([x, np.full(len(fresh), fill, x.dtype)] for x, fill in zip(at, (-1, 0, 0), strict=True))
        value.append(fresh)
        if not kept:
            break
        rows, sizes, nodes, counts = np.concatenate(kept), np.concatenate(new_sizes), np.concatenate(new_nodes), np.concatenate(new_counts)
    return np.concatenate(feature), np.concatenate(cut), np.concatenate(left), np.concatenate(value), gains


def shares(tree: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    """The share of label 1 in each row's leaf."""
    feature, cut, left, value, _ = tree
    node, going = np.zeros(len(codes), np.int64), np.arange(len(codes))
    while len(going):
        at = node[going]
        f = feature[at]
        on = f >= 0
        going, at, f = going[on], at[on], f[on]
        node[going] = left[at] + (codes[going, f] > cut[at])
    return value[node]


def _grouped(blocks: DataFrame, trees: int) -> tuple[DataFrame, int]:
    """Each block once per group of trees, a group's blocks together: training blocks first, in their order."""
    groups = min(trees, 2 * blocks.sparkSession.sparkContext.defaultParallelism)
    each = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return each.repartitionByRange(groups, "part").sortWithinPartitions("part", "test", "nth").select("part", "test", "nth", "n", "codes", "ids", "marks"), groups


def _run(blocks: DataFrame, width: int, trees: int, depth: int, seed: int, score: bool) -> DataFrame:
    """row, id, y and total for each test row and group of trees; or, without scores, tree, feature and gain."""
    grouped, groups = _grouped(blocks, trees)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, part, held, forest = zstandard.ZstdDecompressor(), None, [], None

        def fit() -> list:
            codes, ids, marks = (np.concatenate([np.frombuffer(x[k], t) for x in held]) for k, t in enumerate((np.uint8, np.int64, np.uint8)))
            held.clear()
            out = []
            for t in range(part, trees, groups):
                rng = np.random.default_rng([seed, t])
                weights = rng.poisson(1.0, len(ids)) if ids.max() == 1 else rng.poisson(ids.astype(np.float64))
                out.append((t, grow(codes.reshape(-1, width), marks, weights.astype(np.float32), depth, rng)))
            return out

        def gains() -> pa.RecordBatch:
            rows = [(t, i, float(g)) for t, tree in forest for i, g in enumerate(tree[-1])]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["tree", "feature", "gain"])

        for b in batches:
            for p, test, nth, n, *packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    if held and not score:
                        forest = fit()
                        yield gains()
                    part, forest = p, None
                    held.clear()
                codes, ids, marks = map(press.decompress, packed)
                if not test:
                    held.append((codes, ids, marks))
                    continue
                forest = forest or fit()
                codes = np.frombuffer(codes, np.uint8).reshape(n, width)
                total = sum((np.round(shares(tree, codes).astype(np.float64) / UNIT).astype(np.int64) for _, tree in forest), np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((nth << 20) + np.arange(n)), pa.array(np.frombuffer(ids, np.int64)), pa.array(np.frombuffer(marks, np.uint8).astype(np.int32)), pa.array(total)], ["row", "id", "y", "total"])
        if held and not score:
            forest = fit()
            yield gains()

    return grouped.mapInArrow(work, "row long, id long, y int, total long" if score else "tree int, feature int, gain double")


def importances(rows: DataFrame, width: int, trees: int, depth: int, seed: int) -> np.ndarray:
    """Mean over the trees of each feature's share of the gain. rows: x (array), y (0 or 1)."""
    blocks = stored(_train_blocks(rows, borders(rows, width)).withColumn("test", F.lit(0)))
    out = np.zeros((trees, width))
    for r in _run(blocks, width, trees, depth, seed, False).collect():
        out[r["tree"], r["feature"]] = r["gain"]
    whole = out.sum(1, keepdims=True)
    mean = (out / np.where(whole > 0, whole, 1)).sum(0)
    return mean / (mean.sum() or 1.0)


def scores(train: DataFrame, test: DataFrame, width: int, trees: int, depth: int, seed: int) -> DataFrame:
    """id, y and y_score, the trees' mean share of label 1, for each test row. Both tables: x, y, and test also id."""
    cuts = borders(train, width)
    blocks = stored(_train_blocks(train, cuts).withColumn("test", F.lit(0)).union(_test_blocks(test, cuts).withColumn("test", F.lit(1))))
    sums = _run(blocks, width, trees, depth, seed, True).groupBy("row", "id", "y").agg(F.sum("total").alias("total"))
    return sums.select("id", "y", (F.col("total") * F.lit(UNIT / trees)).alias("y_score"))
