"""Near duplicates, repeated substrings and benchmark phrases against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm import common, decontam, neardup, queries, suffix_dedup


def sets_of(rows, size):
    out = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(common.UPPER, common.LOWER)))
        out[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


def linked(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(docs, rows):
    for size in (4, 5):
        sets = sets_of(rows, size)
        want = linked(sets, 80)
        got = {r.doc_id: r for r in neardup.near_duplicates(docs, 80, size).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_crowded_bands_are_compared_whole(spark, monkeypatch):
    """Links near the limit share few bands, here all crowded, in which every pair must still be compared."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10_000)}"
    core, rows = [word() for _ in range(40)], []
    for i in range(80):
        own = [word() for _ in range(12)] if i % 2 == 0 else [*rows[-1][1].split()[:3], word(), *rows[-1][1].split()[4:6], *rows[-1][1].split()[-6:-1], word()]
        rows.append((i, " ".join(own[:6] + core + own[6:])))
    want = linked(sets_of(rows, 4), 80)
    assert sum(want[i] != i for i in want) == 40
    monkeypatch.setattr(neardup, "CROWD", 0)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 80, 4).collect()} == want


def passages(seed=1, n=150):
    """Many texts around one passage, alike but below the limit, with some links among them."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10_000)}"
    core = [word() for _ in range(40)]
    rows = []
    for i in range(n):
        own = [word() for _ in range(12)]
        if i % 10 == 9:
            own = rows[-3][1].split()[:11] + [word()]
        rows.append((i, " ".join(own[:6] + core + own[6:]), None, None, 0))
    return rows


def test_bands_full_of_different_components(spark, monkeypatch):
    rows = passages()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    want = linked(sets_of(rows, 4), 80)
    monkeypatch.setattr(neardup, "CROWD", 6)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 80, 4).collect()} == want


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.2, 0.8):
        n = 1000
        k = int(2 * n * share / (1 + share))
        a, b = np.sort(pool[:n]), np.sort(pool[n - k : 2 * n - k])
        r = neardup.registers(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        assert abs(neardup.estimate(r[:1], r[1:], np.array([n]), np.array([n]))[0] - share) < 0.13


def test_edges_of_pair_operators(spark, empty):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "A"), (5, " a "), (5, "b c d e f"), (7, "b c d e f")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.near_duplicates(odd).collect()}
    assert got[(1, 0)] == 1 and got[(2, 0)] == 2 and got[(4, 1)] == 3
    assert neardup.near_duplicates(empty).count() == 0 and suffix_dedup.suffix_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(odd).count() == 7


def test_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (None, text), (None, text + " x"), (2, "a b c d e f"), (None, "g h i j k l"), (None, None)], "doc_id long, text string")
    got = sorted(((r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).where("doc_id is null").collect()), key=repr)
    assert got == [(0, None, True), (2, None, True), (26, 1, False), (27, 1, False)]
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert sorted(r.n_hit for r in decontam.decontaminate(df.limit(3), items).collect()) == [30, 30, 30]


def test_of_equal_rows_one_keeps_its_text(spark):
    rng = random.Random(6)
    text, other = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (160, 130))
    df = spark.createDataFrame([(4, text), (4, text), (4, text + other), (5, other), (6, "z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(df).collect())
    n, m = len(text), len(other)
    assert sum(r for i, _, r in got if i == 4) == 2 * n and got[3] == (5, m, m) and got[4] == (6, 1, 0)


def test_phrases_are_the_same_without_broadcasts(spark, docs, rows, monkeypatch):
    items = spark.createDataFrame([*bench_items(rows), (11, "a"), (12, "th")], "item_id long, text string")
    want = sorted(map(repr, decontam.decontaminate(docs, items).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, decontam.decontaminate(docs, items).collect())) == want


def test_suffix_arrays_refuse_what_does_not_fit():
    with pytest.raises(ValueError):
        suffix_dedup.suffix_array(np.ones(1 << 20, np.int64))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(x):
    assert suffix_dedup.suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def repeats(rows, length):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = 1
            seen.add(b[k : k + length])
        kept = np.frombuffer(b, np.uint8)[gone[:-1] == 0].tobytes()
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, rows, monkeypatch):
    shown = lambda df: {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}
    assert shown(suffix_dedup.suffix_dedup(docs)) == repeats(rows, 100)
    assert shown(suffix_dedup.suffix_dedup(docs, 40, most_spans=2)) == repeats(rows, 40)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = random.Random(2)
    part = "".join(rng.choice("abcdef") for _ in range(3000))
    rows = [(1, part + part[500:1500]), (2, "z" + part[100:2500]), (3, part[:99]), (4, "q" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df).collect()} == repeats(rows, 100)


def test_dealt_strings_alone_under_their_key_are_not_sorted():
    """Anchors with very many spans deal out each string; only different strings under one key need a suffix array."""
    bodies, keys, offs = [bytes([65 + i]) * 100 for i in range(4)], np.array([1, 2, 2, 3]), np.array([-1, -1, -1, -1])
    assert suffix_dedup.agreeing(bodies, keys, offs, 100).tolist() == [False, True, True, False]


def test_anchors_do_not_depend_on_blocks_or_neighbours(monkeypatch):
    """Found by blocks, they are the least grams of each string, the first of equal ones."""
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (500, 0, 99, 100, 340)] + [b"q" * 300]
    body, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = suffix_dedup.anchored(body, at, 100)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    for x, y in zip(whole, suffix_dedup.anchored(body, at, 100), strict=True):
        assert x.tolist() == y.tolist()
    text, lo, n, anchor, span, off = whole
    covered = [(i, p, a, p0 + o - p) for i, p0, m, a, o in zip(text, lo, n, anchor, off, strict=True) for p in range(p0, p0 + m)]
    assert [(i, p) for i, p, *_ in covered] == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 99)]
    grams = lambda b: common.span_hash(common.running_hash(b), np.arange(len(b) - 23), np.arange(len(b) - 23) + 24)
    for i, p, a, o in covered:
        g = grams(np.frombuffer(texts[i][p : p + 100], np.uint8))
        assert int(np.argmin(g)) == o and int(g[o].view(np.int64)) == a


def bench_items(rows):
    words = lambda k: re.findall(r"\w+", rows[k][1])
    long = max(range(60), key=lambda k: len(rows[k][1] or ""))
    return [(1, " ".join(words(long)[:30]).upper()), (2, " ".join(words(0)[:3])), (3, None), (4, ""), (5, "!!"), (6, "never seen words here at all"), (7, " ".join(words(long)[:30])), (10, " ".join(words(9)[-25:]))]


def test_phrases_equal_sql(spark, docs, rows):
    items = spark.createDataFrame(bench_items(rows), "item_id long, text string")
    got = decontam.decontaminate(docs, items)
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    c.register("benchmark", pa.table({"item_id": [r[0] for r in bench_items(rows)], "text": [r[1] for r in bench_items(rows)]}))
    want = c.execute(queries.OP1_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in got.collect())
    assert got.where("contaminated").count() > 2


def test_phrases_with_nothing_to_find(spark, docs, empty, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, none).where("n_hit > 0 or contaminated").count() == 0
    assert decontam.decontaminate(empty, spark.createDataFrame(bench_items(rows), "item_id long, text string")).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha one two beta"), (2, "alpha beta"), (3, "beta x x x x x x x x x x x x alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    _, chosen, index = decontam.search(docs, items)
    assert sorted((r.doc_id, r.distance) for r in decontam.proximity_matches(index, chosen, 3).collect()) == [(1, 2), (2, 0)]
    assert [r.doc_id for r in decontam.phrase_matches(index, chosen).collect()] == [2]


@pytest.mark.parametrize("name", ["op2_suffix_repeats", "op5_hyperminhash_groups"])
def test_duplicates_equal_sql(docs, rows, name):
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    want = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = suffix_dedup.suffix_dedup(docs) if name.startswith("op2") else neardup.near_duplicates(docs, percent=80, size=4)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())
