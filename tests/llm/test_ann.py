"""Nearest neighbours against brute force: exact where the graph is small, recall where it is not."""

import numpy as np
import pytest
from framewell.llm import ann, queries
from pyspark.sql import functions as F


def brute(ids, vectors, queries_, k):
    v = np.asarray(vectors, dtype=np.float64)
    out = {}
    for q, x in queries_:
        score = (v * np.asarray(x, dtype=np.float64)).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def run(df, asked, k):
    got = {}
    for r in sorted(ann.nearest(df, asked, k=k).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 40 if i < 60 else 0]]) for i in range(200)]  # one vector in two thirds of the rows
    odd = [(500, None), (501, [0.0] * 8), (502, [1.0, None] + [0.0] * 6), (503, [float("nan")] * 8), (504, [float("inf")] + [0.0] * 7), (505, []), (506, [1.0, 2.0]), (None, rows[0][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows + odd], "vec_id long, embedding array<float>, score int")
    asked = df.filter("vec_id % 20 = 0 OR vec_id > 499").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = run(df, asked, 20)
    ids, vectors = np.array([i for i, _ in rows]), [v for _, v in rows]
    want = brute(ids, vectors, [(i, v) for i, v in rows if i % 20 == 0], 20)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(a[1] == pytest.approx(b[1], rel=1e-12) for q in want for a, b in zip(got[q], want[q], strict=True))
    few = run(df.filter("vec_id < 5"), asked.filter("query_id = 0"), 20)
    assert [len(x) for x in few.values()] == [4]
    assert ann.nearest(df.limit(0), asked).count() == 0 and ann.nearest(df, asked.limit(0)).count() == 0


def test_recall_of_large_shards():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(4000, 32)), rng.normal(size=(30, 32)).repeat(70, 0) + 0.02 * rng.normal(size=(2100, 32))])
    v = np.concatenate([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((len(v), 1))], 1).astype(np.float32)[rng.permutation(6100)]
    graph = ann.build(v)
    found, _ = ann.search(graph, v[::50])
    true = np.argsort(-(v[::50] @ v.T), axis=1)[:, :20]
    assert np.mean([np.isin(t, f).mean() for t, f in zip(true, found, strict=True)]) > 0.95


@pytest.mark.parametrize("kind", ["1", "100", "10000", "1e12", "short", "lognormal", "many", "double"])
def test_recall_with_uneven_lengths(spark, kind):
    """4,000 vectors of 64 components through the operator: one outlier of some length, one very short, lengths of all kinds, and several outliers that are copies or beyond single precision."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "lognormal":
        v *= rng.lognormal(0, 2, (4000, 1))
    elif kind == "many":
        v[rng.integers(0, 4000, 300)] *= 10.0 ** rng.integers(-6, 7, (300, 1))
    elif kind == "double":
        v *= 10.0 ** rng.choice([-200, 0, 140], (4000, 1), p=[0.1, 0.8, 0.1])
    elif kind == "short":
        v[17] *= 1e-20
    else:
        v[17] *= float(kind)
        v[18] = v[17]
    v = v if kind == "double" else v.astype(np.float32).astype(np.float64)
    ids = np.arange(4000)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"vec_id long, embedding array<{'double' if kind == 'double' else 'float'}>")
    asked = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got, want = run(df, asked, 20), brute(ids, v, [(int(i), v[i]) for i in ids[::20]], 20)
    recall = np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want])
    assert recall > 0.95 and all(len(x) == 20 for x in got.values())
    # What is found has exactly its measure.
    assert all(s == pytest.approx(float((v[i] * v[q]).sum()), rel=1e-9, abs=1e-12 * np.linalg.norm(v[q]) * np.linalg.norm(v[i])) for q in got for i, s in got[q])


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), [list(r["embedding"]) for r in rows]
    want = brute(ids, vectors, [(int(i), v) for i, v in zip(ids, vectors, strict=True) if i % 20 == 0], 20)
    got = {}
    for r in queries.op7_neighbours(spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert np.mean([len({i for i, _ in want[q]} & set(got[q])) / 20 for q in want]) > 0.98
