"""Language ID, language model, toxicity and quality: exact parts by brute force, the rest on held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from flowlens.llm import common, langid, lm, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    return common.documents(spark, SF), common.labels(spark, SF)


def test_language_id(spark, table, empty, docs):
    d, _ = table
    got = langid.language_id(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.98
    odd = {r.doc_id: r for r in langid.language_id(docs).collect()}
    for i in (10_000, 10_001, 10_002, 10_003, 10_006):
        assert (odd[i].lang_pred, odd[i].score) == ("und", 0.0)
    assert odd[10_007].lang_pred in ("en", "de") and all(0 <= r.score <= 1 for r in odd.values())
    assert langid.language_id(empty).count() == 0
    unknown = langid.language_id(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert (unknown.lang_pred, unknown.score) == ("und", 0.0)


def test_bloom_masks_have_all_languages_and_few_others():
    codes = common.mix(np.arange(30_000, dtype=np.uint64))
    names = [f"l{i}" for i in range(70)]  # two words of bits
    f = langid.MaskFilter(names, 1 << 18)
    for i in (0, 65):
        f.add(i, codes[:10_000])
    f.add(69, codes[10_000:20_000])
    at = np.array([0, 10_000, 20_000, 30_000, 30_000])
    shares = f.hits(codes, at) / np.maximum(1, np.diff(at))[:, None]
    assert (shares[0, [0, 65]] == 1).all() and shares[1, 69] == 1
    rates = f.false_rates()
    assert np.abs(shares[2] - rates).max() < 0.01 and shares[3].max() == 0 and rates[1] == 0 and 0 < rates[0] < 0.01


def test_grams_and_shares_equal_a_plain_count_whatever_the_blocks(rows):
    texts = [r[1] for r in rows] + [None, "", "x", "Ab c", "é"]
    want = []
    for t in texts:
        x = b" " + bytes(langid._FOLD[np.frombuffer((t or "").encode(), np.uint8)]) + b" "
        own = [x[i : i + n] for n in langid.LENGTHS for i in range(len(x) - n + 1)]
        want.append(Counter(int.from_bytes(g, "big") | len(g) << 56 for g in own if g.strip(b" ")))
    f = langid.MaskFilter(["p", "q"], 1 << 12)
    f.add(0, np.array(sorted(want[0]), np.uint64))
    f.add(1, np.array(sorted(want[3]), np.uint64))
    rates = f.false_rates()
    for most in (5, 1000, 1 << 18):
        got = [Counter() for _ in texts]
        for codes, i, j, at in langid.grams(pa.array(texts), most):
            for k in range(i, j):
                got[k].update(codes[at[k - i] : at[k - i + 1]].tolist())
        assert got == want
    for w, share in zip(want, f.shares(pa.array(texts)), strict=True):
        masks = f.masks(np.array(sorted(w), np.uint64))[0] if w else np.zeros(0, np.uint8)
        n = np.array([w[g] for g in sorted(w)])
        raw = np.array([(n * ((masks >> k) & 1)).sum() for k in (0, 1)]) / max(1, sum(w.values()))
        assert np.allclose(share, np.clip((raw - rates) / (1 - rates), 0, 1))


def test_language_model_base_and_gain(spark, table):
    d, _ = table
    check_base(lm.lm_scores(d), d)
    got = lm.lm_scores(d).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def check_base(scored, d):
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in d.select("doc_id", "text").collect()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 10}
    c = Counter(w for i in train for w in texts[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    for r in scored.collect():
        w = texts[r.doc_id]
        want = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)


def test_language_model_with_a_tiny_head_and_odd_rows(spark, docs, empty):
    check_base(lm.lm_scores(docs, head=3, sample_docs=20), docs)
    assert lm.lm_scores(empty).count() == 0


def test_log_bilinear_probabilities_sum_to_one_and_learn():
    seq = np.tile(np.array([3, 5, 7, 11]), 2000)
    at = np.array([0, len(seq)])
    m = lm.LogBilinear(np.bincount(seq, minlength=lm.CLASSES))
    before = m.log10(seq, at).mean()
    for _ in range(60):
        m.learn(seq, at, 0.2)
    assert m.log10(seq, at).mean() > max(before, -0.2)
    each = np.concatenate([np.append(seq[:7], k) for k in range(lm.CLASSES)])
    last = m.log10(each, np.arange(lm.CLASSES + 1) * 8)[7::8]
    assert abs((10**last).sum() - 1) < 1e-4


def test_second_level_is_the_least_of_its_loss_and_normalised():
    rng = np.random.default_rng(3)
    u, n = rng.normal(0, 1, (lm.CLASSES, lm.WIDTH)), rng.poisson(0.3, (lm.CLASSES, 40)).astype(float)
    n[:, 7] *= 30
    v, b = lm.fit_within(u, n, block=16)
    q = (n.sum(0) + 1) / (n.sum(0) + 1).sum()
    noise = lm.NOISE * n.sum(1)[:, None] * q
    p = 1 / (1 + np.exp(-(u @ v.T + b - np.log(lm.NOISE * q))))
    wrong = noise * p - n * (1 - p)
    assert np.abs(wrong.T @ u + lm.RIDGE * v).max() < 1e-2 and np.abs(wrong.sum(0) + lm.RIDGE * (b - np.log(q))).max() < 1e-2
    words = [b"w%d" % i for i in range(1000)]
    w = lm.Within(words)
    codes = np.concatenate([w.members(k) for k in range(lm.SINGLE, lm.END)])
    w.put(u.astype(np.float32), codes, rng.normal(0, 1, (len(codes), lm.WIDTH)), rng.normal(0, 1, len(codes)))
    for kind in range(lm.SINGLE, lm.END):
        own = w.members(kind)
        assert abs((10 ** w.log10(own, np.full(len(own), 9))).sum() - 1) < 1e-4


def test_language_model_scores_equal_a_loop_over_tokens(spark, docs, rows, monkeypatch):
    held, train = [], lm.trained
    monkeypatch.setattr(lm, "trained", lambda model, within, *x: (train(model, within, *x), held.append((model, within))))
    got = {r.doc_id: r for r in lm.lm_scores(docs, head=600, sample_docs=20, least_count=2).collect()}
    (m, w), texts = held[0], {r[0]: (r[1] or "").encode().lower().split() for r in rows}
    c = Counter(x for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for x in t)
    top = sorted(c, key=lambda x: (-c[x], x))[: w.n]
    assert lm.SINGLE < w.n < len(c)
    code = {x: i for i, x in enumerate(top)}
    spare = {k: [c[x] for x in c if x not in code and lm.shared_class(x) == k] for k in range(lm.SINGLE, lm.END)}
    for i, t in texts.items():
        kinds = [code[x] if code.get(x, lm.SINGLE) < lm.SINGLE else lm.shared_class(x) for x in t] + [lm.END]
        if len(t) > 400:
            continue
        total = 0.0
        for k, kind in enumerate(kinds):
            before = [kinds[k - 1 - j] if k - 1 - j >= 0 else lm.END for j in range(lm.CONTEXT)]
            z = m.q @ sum(m.r[x] * m.place[j] for j, x in enumerate(before)) + m.bias
            total += math.log10(np.exp(z[kind]) / np.exp(z).sum())
            if lm.SINGLE <= kind < lm.END:
                own = w.members(kind)
                z = np.exp(w.v[own] @ w.u[before[0]] + w.b[own])
                total += math.log10(z[list(own).index(code.get(t[k], w.n + kind - lm.SINGLE))] / z.sum())
                if t[k] not in code:
                    total += math.log10((c[t[k]] + 0.1) / (sum(spare[kind]) + 0.1 * (len(spare[kind]) + 1)))
        assert math.isclose(got[i].score, total, rel_tol=1e-3, abs_tol=1e-2)


def test_toxicity(spark, table, empty, docs):
    d, lab = table
    got = toxicity.toxicity_scores(d, lab).join(lab, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.93 and got.predicted[got.toxic == 0].mean() < 0.03
    assert toxicity.toxicity_scores(empty, lab).count() == 0
    none = spark.createDataFrame([], lab.schema)
    assert {r.score for r in toxicity.toxicity_scores(docs, none).collect()} == {0.5}
    odd = toxicity.toxicity_scores(docs.select("doc_id", "text", "label").unionByName(d.select("doc_id", "text", F.lit("z").alias("label"))), lab)
    assert odd.where("score is null or score < 0 or score > 1").count() == 0


def test_evidence_has_the_plain_cosine_of_the_two_texts(spark, table):
    """Chosen terms and weights counted text by text; repeated rows have equal results."""
    d, lab = table
    texts, marks = {r.doc_id: r.text for r in d.collect()}, {r.doc_id: r.toxic for r in lab.where("toxic is not null").collect()}
    marks = {i: y for i, y in marks.items() if zlib.crc32(str(i).encode()) % 5}
    words = {i: toxicity.word_lists(pa.array([t]))[0] for i, t in texts.items()}
    counts = toxicity.label_counts(spark.createDataFrame([(texts[i], y) for i, y in marks.items()], "text string, label int"))
    chosen = set(toxicity.choose_terms(counts, sum(marks.values()), len(marks) - sum(marks.values()), toxicity.VOCABULARY, toxicity.LEAST_G2))
    tf = {i: Counter(t for x in w for t in toxicity.terms_of(x) if t in chosen) for i, w in words.items()}
    twice = [i for i in texts if i % 50 == 0]
    df = Counter(t for i in [*texts, *twice] for t in tf[i])

    def vector(i):
        out = {t: (1 + math.log(k)) * (1 + math.log((1 + len(texts) + len(twice)) / (1 + df[t]))) for t, k in tf[i].items()}
        out[b""] = 1 + math.log(len(words[i])) if words[i] else 1.0
        norm = math.sqrt(sum(x * x for x in out.values()))
        return {t: x / norm for t, x in out.items()}

    got = toxicity.toxicity_scores(d.union(d.where("doc_id % 50 = 0")), lab).collect()
    assert len(got) == len(texts) + len(twice) and len({(r.doc_id, r.score) for r in got}) == len(texts)
    for r in got[::7]:
        own = vector(r.doc_id)
        for e in r.evidence:
            other = vector(int(e.doc_id))
            assert int(e.doc_id) in marks and math.isclose(e.cosine, sum(x * other.get(t, 0.0) for t, x in own.items()), abs_tol=1e-4)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    x = rng.random((300, 40)).astype(np.float32) * (rng.random((300, 40)) < 0.15)
    x[:, -1] += 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = toxicity.BlockMaxIndex(x[:250], np.zeros(250, int), np.ones(250), np.arange(250))
    best, place = index.nearest(x[250:], 7)
    want = np.sort(x[250:] @ x[:250].T, axis=1)[:, ::-1][:, :7]
    assert np.allclose(best, want, atol=1e-5)
    assert np.allclose((x[250:, None] * x[:250][index.ids[place]]).sum(2), best, atol=1e-5)


def test_quality(spark, table, empty, docs):
    d, lab = table
    got = quality.quality_scores(d, lab).join(lab, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    odd = quality.quality_scores(docs.select("doc_id", "text").union(d.select("doc_id", "text")), lab)
    assert odd.where("score is null or score < 0 or score > 1 or isnan(score)").count() == 0
    assert quality.quality_scores(empty, lab).count() == 0
    assert {r.score for r in quality.quality_scores(docs, spark.createDataFrame([], lab.schema)).collect()} == {0.5}


def test_statistics_equal_plain_counts(docs, rows):
    got = {r[0]: r[1] for r in docs.select("doc_id", F.array(*quality.statistics(F.col("text")))).collect()}
    for i, text, *_ in rows:
        t = text or ""
        n, words, lines = len(t), len(regex.findall(r"[^\x20\x09-\x0D]+", t)), t.split("\n")
        lower = t.translate(str.maketrans(common.UPPER, common.LOWER)).split(" ")
        want = [math.log1p(n), math.log((n + 1) / (words + 1))]
        want += [math.log((len(regex.findall(p, t)) + 0.5) / (n + 20)) for p in quality.COUNTED.values()]
        want += [math.log((len(set(x)) + 1) / (len(x) + 1)) for x in (lines, lower)]
        assert np.allclose(got[i], want, atol=1e-9), i


def test_discriminant_equals_the_formula():
    rng = np.random.default_rng(4)
    x = {0: rng.normal(0, 1, (200, 3)), 1: rng.normal(1, [1, 2, 0.5], (300, 3))}
    m = quality.Discriminant({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in x.items()}, 0.0, 1e-9)
    probe = rng.normal(0.5, 1, (20, 3))
    own = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = (own[0] * 200 + own[1] * 300) / 500
    logs = []
    for k, v in x.items():
        lean = 3 / (3 + len(v))
        c = (1 - lean) * own[k] + lean * pooled
        z = probe - v.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) - 0.5 * np.linalg.slogdet(c)[1] + np.log(len(v) / 500))
    assert np.allclose(m.scores(probe), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-6)


def test_remainder_is_that_of_the_text(spark):
    ids = [random.Random(1).randrange(1 << 40) for _ in range(20)] + [None]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select(common.remainder(F.col("i"), 7)).collect()
    assert [r[0] for r in got] == [zlib.crc32(("" if i is None else str(i)).encode()) % 7 for i in ids]


def test_language_model_learns_from_all_training_rows(spark):
    """Rows that the start does not draw still move the parameters: their order of words is learned."""
    rows = [(i, " ".join(["red", "green", "blue", "grey"] * 60)) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    total = lm.lm_scores(d, sample_docs=0).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert total.s > 0.6 * total.b
    assert lm.lm_scores(d.where("false")).count() == 0


def test_a_pass_over_texts_follows_the_gradient_of_each_token(monkeypatch):
    """One step of neighbouring tokens against the same step token by token."""
    rng = np.random.default_rng(5)
    kinds, at = rng.integers(0, lm.CLASSES, 60), np.array([0, 20, 21, 60])

    def contexts():
        for a, b in zip(at[:-1], at[1:], strict=True):
            for i in range(a, b):
                yield [kinds[i - 1 - k] if i - 1 - k >= a else lm.END for k in range(lm.CONTEXT)]

    monkeypatch.setattr(lm.LogBilinear, "step", lambda self, grads, n, rate: setattr(self, "took", [g.copy() for g in grads]))
    m = lm.LogBilinear(rng.random(lm.CLASSES) * 50)
    m.rng = np.random.default_rng(6)
    m.learn(kinds, at)
    draw = np.random.default_rng(6)
    draw.permutation(1)
    tried = np.searchsorted(m.noise.cumsum(), (np.arange(lm.JOINT) + draw.random()) / lm.JOINT)
    want = [np.zeros(x.shape) for x in m.parameters()]
    for c, t in zip(contexts(), kinds, strict=True):
        predicted = (m.r[c] * m.place).sum(0)
        for k, own in [(t, 1), *((k, 0) for k in tried)]:
            error = 1 / (1 + np.exp(-(predicted @ m.q[k] + m.bias[k] - np.log(lm.JOINT * m.noise[k])))) - own
            np.add.at(want[0], c, error * m.q[k] * m.place)
            want[1][k] += error * predicted
            want[2] += error * m.q[k] * m.r[c]
            want[3][k] += error
    assert all(np.allclose(x, y, atol=1e-4) for x, y in zip(m.took, want, strict=True))
