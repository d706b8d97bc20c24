"""The forest against plain counts; its results do not depend on how rows lie."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens import contracts
from flowlens.operators import forest, models


def gini(y):
    return 2 * y.sum() * (len(y) - y.sum()) / len(y) if len(y) else 0.0


def test_a_stump_has_the_best_split():
    rng = np.random.default_rng(1)
    for _ in range(50):
        c, y = rng.integers(0, 32, (60, 1)).astype(np.uint8), rng.integers(0, 2, 60).astype(np.uint8)
        feature, cut, left, value, gains = forest.grow(c, y, np.ones(60, np.float32), 1, rng)
        best = max(gini(y) - gini(y[c[:, 0] <= b]) - gini(y[c[:, 0] > b]) for b in range(31) if 0 < (c[:, 0] <= b).sum() < 60)
        assert abs(gains[0] - best) < 1e-6 and feature.tolist() == [0, -1, -1]
        assert np.allclose(value, [y.mean(), y[c[:, 0] <= cut[0]].mean(), y[c[:, 0] > cut[0]].mean()])


def test_weights_are_repeated_rows_and_chunks_do_not_matter(monkeypatch):
    rng = np.random.default_rng(2)
    c, y, w = rng.integers(0, 32, (900, 1)).astype(np.uint8), rng.integers(0, 2, 900).astype(np.uint8), rng.integers(0, 4, 900)
    one = forest.grow(c, y, w.astype(np.float32), 30, np.random.default_rng(3))
    monkeypatch.setattr(forest, "ROWS", 40)
    monkeypatch.setattr(forest, "NODES", 3)
    two = forest.grow(np.repeat(c, w, 0), np.repeat(y, w), np.ones(w.sum(), np.float32), 30, np.random.default_rng(4))
    assert np.allclose(one[-1], two[-1]) and len(one[0]) == len(two[0])
    assert np.array_equal(forest.shares(one, c), forest.shares(two, c))
    for b in range(32):  # with one feature and no limit, a leaf is a bin or has one label
        at = c[:, 0] == b
        share = forest.shares(one, c[at])
        assert len(set(share)) <= 1 and (share[0] in (0, 1) or abs(share[0] - np.repeat(y[at], w[at]).mean()) < 1e-6)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    raw = [(i, [float(rng.randrange(9)), rng.random() if i % 50 else None, rng.gauss(0, 1), 3.0], 0) for i in range(3000)]
    raw = [(i, x, int((x[0] > 4) != ((x[1] or 1) > 0.3) if rng.random() < 0.9 else rng.random() < 0.5)) for i, x, _ in raw]
    return spark.createDataFrame(raw, "id long, x array<double>, y int")


def test_scores_are_the_mean_of_plain_trees(table):
    train, test = table.where("id % 3 > 0"), table.where("id % 3 = 0")
    got = {r.id: (r.y, r.y_score) for r in forest.scores(train, test, 4, 7, 6, 42).collect()}
    cuts = forest.borders(train, 4)
    coded = lambda rows: np.array([[int(np.searchsorted(cuts[i], np.inf if v is None else v, "right")) for i, v in enumerate(r.x)] for r in rows], np.uint8)
    rows, asked = train.collect(), test.collect()
    each = sorted({}.fromkeys(zip(map(bytes, coded(rows)), (r.y for r in rows), strict=True)))
    count = {k: 0 for k in each}
    for r, c in zip(rows, coded(rows), strict=True):
        count[bytes(c), r.y] += 1
    codes, marks, times = np.array([list(c) for c, _ in each], np.uint8), np.array([y for _, y in each], np.uint8), np.array([count[k] for k in each])
    want = np.zeros(len(asked))
    for t in range(7):
        rng = np.random.default_rng([42, t])
        w = rng.poisson(times.astype(float)) if times.max() > 1 else rng.poisson(1.0, len(times))
        want += forest.shares(forest.grow(codes, marks, w.astype(np.float32), 6, rng), coded(asked)) / 7
    assert set(got) == {r.id for r in asked} and all(abs(got[r.id][1] - s) < 1e-6 and got[r.id][0] == r.y for r, s in zip(asked, want, strict=True))
    assert sum((s > 0.5) == y for y, s in got.values()) / len(got) > 0.8


def test_partitions_do_not_change_the_forest(table, monkeypatch):
    rows = table.select(*(F.col("x")[i].alias(f"f{i}") for i in range(4)), F.col("y").alias("Binary_Label"))
    names = ["f0", "f1", "f2", "f3"]
    one = models.importances(rows.coalesce(1), names, trees=9, depth=8)
    monkeypatch.setattr(forest, "BLOCK", 100)
    assert models.importances(rows.repartition(7), names, trees=9, depth=8) == one
    assert {n for n, _ in one[:2]} == {"f0", "f1"} and one[3] == ("f3", 0.0) and abs(sum(v for _, v in one) - 1) < 1e-9
    with pytest.raises(contracts.ContractError):
        models.importances(rows.limit(0), names)
