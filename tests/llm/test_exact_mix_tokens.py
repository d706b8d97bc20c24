"""Exact dedup, mixing and token files against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.llm import common, exact_dedup, mixing, queries, tokenout


@pytest.mark.parametrize("digest", [exact_dedup.md5, lambda c: F.md5(F.substring(c, 2, 1).cast("binary"))])
def test_exact_dedup(docs, rows, digest):
    """Also under a digest that most chunks share."""
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, digest=digest).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        g, r = groups[norm(t)], got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g), len(g), i == min(g), hashlib.sha256(norm(t).encode()).hexdigest())


def test_chunks_are_the_text_and_follow_content(spark):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("aeioudlptnrs") for _ in range(rng.randint(1, 9))) for _ in range(9000))
    df = spark.createDataFrame([(1, text), (2, "a new beginning, " + text)], "doc_id long, text string")
    a, b = (r.chunks for r in exact_dedup.chunked(df).orderBy("doc_id").collect())
    assert "".join(a) == text and "".join(b) == "a new beginning, " + text
    assert len(set(a) & set(b)) > 0.8 * len(a) and all(len(c) <= 2048 for c in a + b)


def test_a_digest_that_stands_for_two_chunks_is_told_apart(spark):
    store = spark.createDataFrame([("a", 1, "d"), ("b", 1, "d"), ("c", 1, "e")], "chunk string, uses long, digest string")
    assert sorted((r.chunk, r.number) for r in exact_dedup.collisions(store).collect()) == [("a", 0), ("b", 1)]


def test_mix_against_a_plain_loop(docs, rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    total = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = sum(total.values()), set(names), {}
    while True:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * total[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
        open_ -= over
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert all(r["size"] == size[i] and 0 <= r.taken <= 3 * size[i] and abs(r.target - target[source[i]]) < 1e-3 and r.source_size == total[source[i]] for i, r in got.items())
    for s in names:
        own = [r for i, r in got.items() if source[i] == s]
        assert abs(sum(r.taken for r in own) - target[s]) <= 1
        order = sorted((r for r in own if r["size"]), key=lambda r: r.key)
        part = [r.taken - r.epochs * r["size"] for r in order]
        full = [p == r["size"] for p, r in zip(part, order, strict=True)]
        assert full == sorted(full, reverse=True) and sum(0 < p < r["size"] for p, r in zip(part, order, strict=True)) <= 1
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(2)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_prefix_sums_over_many_buckets(spark, monkeypatch):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 300, "hot").otherwise("cold").alias("source"))
    one = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert {r.doc_id: r.taken for r in mixing.mix(df).collect()} == one


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.vocabulary())


def test_token_files(docs, rows, tokenizer):
    odd = [("don't we'll 's x's",), ("áb é İx Σας",), ("x<|endoftext|>y",), ("a\x1cb\x0bc\x85d e",), ("ÀÉß× ÷µª ÿÿ!!!",), ("12ab3 a1!! $$$a",)]
    extra = docs.sparkSession.createDataFrame([(20_000 + i, t) for i, (t,) in enumerate(odd)], "doc_id long, text string")
    manifest = tokenout.write_sequences(docs.select("doc_id", "text").union(extra), queries.vocabulary(), common.scratch(docs.sparkSession, "tokens"), length=64)
    got = sorted(tokenout.read_back(manifest).collect(), key=lambda r: r.doc_id)
    texts = sorted([(i, t or "") for i, t, *_ in rows] + [(20_000 + i, t) for i, (t,) in enumerate(odd)])
    start, every = 0, []
    for r, (i, t) in zip(got, texts, strict=True):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        every += ids
    flat, k = [], 0
    for m in manifest.orderBy("part").collect():
        for k in range(-(-m.n_ids // 64)):
            ids, mask = tokenout.sequence(m.path, k)
            assert len(ids) == len(mask) == 64
            flat += ids[mask].tolist()
    assert flat == every


def test_ids_are_those_of_the_library_for_whole_texts(tokenizer, spark):
    """All of a table, random texts of hard characters, and texts that are read in parts."""
    rng = random.Random(1)
    hard = "aAzZ09 '\"<>|.,!?-_ \t\n\r\x0b\x0c\x1c\x85\xa0 éÉÀßÿ÷×ªµİıΣςσ日本語\u0327\u0301ﬁⅧ²½٣🙂\u200d'sS'tTreElLdDmMvV"
    some = ["<|endoftext|>", "<|startoftext|>", "'s", "don't", "<|x", "A'LL", "we're", "''s", "!'s"]
    plain = [c for c in hard if c in " \t\n\r" or "!" <= c <= "~" or c in "éÉÀßÿ"]
    texts = [r.text for r in common.documents(spark, "/root/testdata/sf0.01").select("text").collect()]
    texts += ["".join(rng.choice(hard) if rng.random() < 0.9 else rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["日本語の テキスト " * 20_000, "x" * 300_000 + " y", "don't we'll " * 30_000]
    encoder = tokenout.Encoder(queries.vocabulary(), 2)
    assert encoder.apart
    for a in range(0, len(texts), 331):
        blocks, counts = encoder.encode(pa.array(texts[a : a + 331], pa.string()))
        flat, at = np.concatenate(blocks).tolist(), 0
        for t, n in zip(texts[a : a + 331], counts, strict=True):
            assert flat[at : at + n] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
            at += n
        assert at == len(flat)
    encoder.apart = False  # an unknown pre-tokenizer
    blocks, counts = encoder.encode(pa.array(["a b", None]))
    assert np.concatenate(blocks).tolist() == [*tokenizer.encode("a b", add_special_tokens=False).ids, 2, 2] and counts.tolist() == [3, 1]


def test_memo_tells_all_hashes_apart():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(1, 1 << 63, 5000).astype(np.uint64) & np.uint64(0xFFFFFFFF00000FFF))
    memo = tokenout.Memo(np.dtype("<u2"), 2)
    for a in range(0, len(h), 700):
        memo.add(h[a : a + 700], np.arange(a, min(a + 700, len(h))) % 60_000, np.ones(min(700, len(h) - a), np.int64))
    assert (memo.find(h) == np.arange(1, len(h) + 1)).all() and not memo.find(h + np.uint64(0x1000)).any()


def test_repeated_ids_and_empty_tables(spark, empty):
    twice = spark.createDataFrame([(5, "a b"), (5, "a b"), (5, "c"), (None, "d")], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert exact_dedup.exact_dedup(twice).count() == 4 and mixing.mix(twice).count() == 4
    assert tokenout.token_output(twice, queries.vocabulary()).count() == 4
    for f in (exact_dedup.exact_dedup, mixing.mix, lambda d: tokenout.token_output(d, queries.vocabulary())):
        assert f(empty).count() == 0
