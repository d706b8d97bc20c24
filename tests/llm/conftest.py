import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": ["th", "er", "on", "an", "ing", "ed"], "de": ["sch", "ein", "ung", "lich", "ü", "ß"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=3, n=160):
    """Documents with exact and near copies, shared passages, nulls, empty, tiny and long texts, odd white space."""
    rng = random.Random(seed)
    passage = sentence(rng, "en", 60)
    rows = []
    for i in range(n):
        lang = rng.choice(("en", "en", "de"))
        text = sentence(rng, lang, rng.randint(3, 90))
        if i % 9 == 0:
            text = f"{text}\n{passage}. {sentence(rng, lang, 5)}"
        if i % 7 == 1:
            text = rows[rng.randrange(len(rows))][1]
        if i % 7 == 2:
            words = (rows[rng.randrange(len(rows))][1] or "x").split(" ")
            words[rng.randrange(len(words))] = "edit"
            text = " ".join(words)
        if i % 11 == 5 and text:
            text = text.replace(" ", "\t\n ", 3).capitalize()
        rows.append((i * 3, text, lang, f"s{i % 4}" if i % 13 else None, len(text or "")))
    odd = [None, "", " ", "\n\t", "a", "A b", "... !!", "日本語 の テキスト", "x" * 30_000, "ab " * 9_000, "É é É"]
    rows += [(10_000 + i, t, None, "odd", None) for i, t in enumerate(odd)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with further columns, some named like the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    names = ("size", "target", "key", "w", "n", "label", "words", "x", "bucket", "digest", "node", "component", "row", "anchor", "lo", "n_words", "registers", "text_sha256", "held_out", "score")
    return df.withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
