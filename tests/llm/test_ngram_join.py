"""The similarity join against brute force."""

import random
import re

import pytest
from framewell.llm import _shingles, ngram_join, queries


def brute(rows, n=4, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x]}:
            if j < i and (find(i) != find(j)) and (i, j) not in seen:
                k = len(s & sets[j])
                if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            low[r] = min(low.get(r, d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_odd_rows(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "ONE two"), (10, "two one"), (11, "é É x"), (12, "é é x"), (None, "a b c d e"), (3, "a b c d e"), (None, "lonely words of no one"), (4, "a b c d e"), (4, "a b c d e"), (13, "x" * 100000 + " y z w q")]
    rows += [(20, "w " * 3000), (21, "w " * 4000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    assert result(ngram_join.similarity_components(docs)) == brute(rows)
    assert ngram_join.similarity_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot,block", [(32, 512), (4, 16)])
def test_groups_of_copies(spark, monkeypatch, hot, block):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    rows, doc = [], 0
    common = [word() for _ in range(20)]
    for group in range(14):
        base = [word() for _ in range(rng.randint(20, 120))] + (common if group % 3 == 0 else [])
        for _ in range(90 if group == 0 else rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append((doc * 7 % 1009, " ".join(w)))
            doc += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(ngram_join.similarity_components(docs)) == brute(rows)


def test_query(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = result(queries.op6_ngram_join(spark, tiny))
    assert got == brute(rows) and any(c != d for d, _, c in got)


def test_batches_hash_like_single_texts():
    import numpy as np
    import pyarrow as pa

    texts = ["a b c d e", None, "", "  A b  c d", "x", "b c d e\x0bf \x1c g", "é ü"] * 5
    column = pa.array(texts)
    whole = list(_shingles.batch_shingles(column, 4))
    single = [next(_shingles.batch_shingles(pa.array([t], pa.string()), 4)) for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(whole, single, strict=True))
    assert len(np.intersect1d(whole[0], whole[3])) == 1
    sliced = list(_shingles.batch_shingles(column.slice(3, 9), 4))
    assert all(np.array_equal(a, b) for a, b in zip(sliced, whole[3:12], strict=True))
