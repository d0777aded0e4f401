"""Training and calibration of language ID against plain restatements of their rules."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from framewell.llm import lang_id
from pyspark.sql import functions as F


def plain_ftrl(rows, classes, epochs, alpha, beta, l1, l2):
    """Follow-the-regularised-leader, coordinate by coordinate; rows are ({feature: value}, label)."""
    z, n = Counter(), Counter()

    def weight(f, c):
        if abs(z[f, c]) <= l1:
            return 0.0
        return -(z[f, c] - math.copysign(l1, z[f, c])) / ((beta + math.sqrt(n[f, c])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            w = {(f, c): weight(f, c) for f in x for c in range(classes)}
            scores = [sum(v * w[f, c] for f, v in x.items()) for c in range(classes)]
            top = max(scores)
            e = [math.exp(s - top) for s in scores]
            for f, v in x.items():
                for c in range(classes):
                    g = v * (e[c] / sum(e) - (c == y))
                    sigma = (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / alpha
                    z[f, c] += g - sigma * w[f, c]
                    n[f, c] += g * g
    return weight


def test_updates_against_a_restatement():
    rng = random.Random(3)
    rows = [({rng.randrange(40): rng.uniform(0.1, 1) for _ in range(6)}, rng.randrange(3)) for _ in range(30)]
    ftrl = lang_id.Ftrl(3, alpha=0.3, beta=0.7, l1=0.05, l2=0.02)
    for _ in range(3):
        for x, y in rows:
            ftrl.learn(np.array(list(x)), np.array(list(x.values())), y)
    weight = plain_ftrl(rows, 3, 3, 0.3, 0.7, 0.05, 0.02)
    want = np.array([[weight(f, c) for c in range(3)] for f in range(40)])
    got = ftrl.weights(np.arange(40))
    assert np.allclose(got, want, atol=1e-12) and (got == 0).any() and (got != 0).any()


def test_penalties():
    """The first penalty empties weights, the second shrinks them."""
    rows = [(np.array([k, 9]), np.array([1.0, 0.2]), k % 2) for k in range(8)] * 3

    def learnt(**more):
        ftrl = lang_id.Ftrl(2, **more)
        for at, x, y in rows:
            ftrl.learn(at, x, y)
        return ftrl.weights(np.arange(10))

    assert (learnt(l1=3.0) == 0).all()
    assert np.abs(learnt(l1=0.0, l2=5.0)).sum() < np.abs(learnt(l1=0.0, l2=0.0)).sum()


def test_tf_idf_and_features():
    at, n = lang_id.features("Ab ab!")
    grams = Counter(" ab ab "[i : i + k] for k in lang_id.LENGTHS for i in range(8 - k))
    assert n.sum() == sum(grams.values()) and len(at) == len(grams) and sorted(n) == sorted(grams.values())
    idf = np.linspace(1, 2, lang_id.FEATURES)
    rows, values = lang_id.weigh(at, n, idf)
    raw = (1 + np.log(n)) * idf[at]
    assert np.allclose(values, [*(raw / np.linalg.norm(raw)), 1.0]) and rows[-1] == lang_id.FEATURES


def test_temperature_is_the_least_loss():
    rng = random.Random(5)
    texts = ["".join(rng.choices(letters, k=12)) for letters in ("abcde", "cdefg") for _ in range(60)]
    labels = ["x"] * 60 + ["y"] * 60
    idf = np.ones(lang_id.FEATURES)
    counted = [lang_id.features(t) for t in texts]
    model = lang_id.fit(labels, counted, idf)
    fresh = np.random.default_rng(7).permutation(120)[:24]
    grid = np.geomspace(0.1, 10, 81)

    def loss(t):
        total = 0.0
        for i in fresh:
            rows, values = model.vector(texts[i])
            s = values @ model.weights[rows] / t
            total -= s[model.languages.index(labels[i])] - s.max() - math.log(np.exp(s - s.max()).sum())
        return total

    losses = [loss(t) for t in grid]
    assert model.temperature == pytest.approx(grid[int(np.argmin(losses))])


def test_counts_and_training_rows(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.filter(~lang_id.held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    df, sizes = lang_id.corpus_counts(rows.repartition(3))
    local = rows.collect()
    want = np.zeros(lang_id.FEATURES + 1, dtype=int)
    for r in local:
        want[lang_id.features(r["text"])[0]] += 1
    want[-1] = len(local)
    assert (df == want).all() and sizes == Counter(r["lang"] for r in local)
    # Held-out rows and rows without a language change nothing.
    swapped = docs.withColumn("lang", F.when(lang_id.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert (lang_id.train(docs).weights == lang_id.train(swapped).weights).all()


def test_every_language_is_learned(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(chr(0x4E00 + 40 * (i % 230)) + chr(0x4E01 + 40 * (i % 230)), k=20)), f"l{i % 230:03}") for i in range(2300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(docs)
    assert len(model.languages) == 230
    assert sum(model.predict(t)[0] == lang for _, t, lang in rows) > 2200


def test_odd_tables(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = lang_id.train(docs)
    assert lang_id.identify(docs.limit(0), model).count() == 0
    text = "the and of the with that was this " * 30000
    odd = spark.createDataFrame([(1, text, 3), (2, text[:35], 4)], "doc_id long, text string, lang_pred int")
    got = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(odd, model).collect()}
    assert got == {1: "en", 2: "en"}
