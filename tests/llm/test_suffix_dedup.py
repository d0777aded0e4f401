"""Removal of repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from framewell.llm import queries, suffix_dedup
from pyspark.sql import functions as F


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(df).collect()), key=str)


def made(seed):
    rng = random.Random(seed)
    word = lambda n=4: "".join(rng.choices("abcdeéß", k=n))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (30, 39, 40, 41, 45, 80, 200)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 30)
            parts += [s[a : len(s) - rng.randint(0, 30)], prose(rng.randint(0, 40))]
        rows.append((i, "".join(parts)))
    rows += [(90, rows[3][1]), (91, rows[3][1]), (92, "x" * 199), (93, "x" * 200), (94, "x" * 201), (95, "x" * 199), (96, None), (97, ""), (None, "ab" * 300), (98, "\0" * 500), (99, "y" * 200), (99, "y" * 200)]
    return rows


@pytest.mark.parametrize("hot,batches,filtered", [(1000, 2, 1 << 23), (3, 1, 1 << 23), (1000, 5, 2), (3, 8, 2)])
def test_against_brute_force(spark, monkeypatch, hot, batches, filtered):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "FILTERED", filtered)
    rows = made(batches)
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_bytes int").repartition(3)
    assert result(suffix_dedup.remove_repeats(docs, batches=batches)) == brute(rows)


def test_small_steps(spark, monkeypatch):
    for name, value in (("CHUNK", 700), ("COMPARED", 5000), ("REMEMBERED", 3)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = made(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(suffix_dedup.remove_repeats(docs)) == brute(rows)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 9)
    rows = made(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert max(len((t or "").encode()) for _, t in rows) > 1 << 10
    assert result(suffix_dedup.remove_repeats(docs)) == brute(rows)


def test_text_beyond_16_mib(spark):
    rng = random.Random(3)
    shared = rng.randbytes(150).hex()
    filler = rng.randbytes(9 << 20).hex()
    early, late = 5_000, (1 << 24) + 700_000
    long = filler[:early] + shared + filler[early:late] + shared + filler[late:]
    docs = spark.createDataFrame([(1, long), (2, f"[{shared}]")], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in suffix_dedup.remove_repeats(docs).select("doc_id", "removed").collect()}
    # Neighbours of the passage may be equal by chance, so the first and third may reach a little further.
    assert len(got[1]) == 2 and got[2] == [(1, 301)]
    for (a, b), start in zip(got[1], (early, late + 300), strict=True):
        assert start - 4 <= a <= start and start + 300 <= b <= start + 304


def arrays(spark, rows, batches):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("unhex(md5(text)) AS text_key", "cast(coalesce(text, '') AS binary) AS data").filter("text_key IS NOT NULL")
    return suffix_dedup.suffix_arrays(docs, batches, 4)


def test_levels_merge(spark):
    made_arrays, name = arrays(spark, made(4), 8)
    index = suffix_dedup.Levels(4)
    sizes = []
    for i in range(8):
        index.add(made_arrays.filter(f"batch = {i}").drop("batch"))
        sizes.append([s for s, _, _ in index.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1], [4, 2, 1], [4, 2, 1, 1]] and index.merges == 4
    every = made_arrays.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    assert sorted(map(tuple, index.repeated().collect())) == sorted(map(tuple, every.collect()))
    # A scan joins the batch with the levels without a shuffle.
    scan = made_arrays.filter("batch = 1").join(index.levels[0][1].withColumnRenamed("n", "m").hint("merge"), ["lead", "key"])
    assert "Exchange" not in scan._jdf.queryExecution().executedPlan().toString()
    index.drop()
    suffix_dedup.drop_table(name)


def test_arrays_are_in_order(spark):
    rows = [(i, t) for i, t in made(2) if t]
    made_arrays, name = arrays(spark, rows, 1)
    whole = b"".join(t.encode() for _, t in rows)
    for part in made_arrays.select("lead", "key", F.spark_partition_id().alias("p")).groupBy("p").agg(F.collect_list(F.struct("lead", "key")).alias("l")).collect():
        leads = [(r["lead"], r["key"]) for r in part["l"]]
        assert leads == sorted(leads)
        assert all(((a + (1 << 63)).to_bytes(8, "big")) in whole for a, _ in leads)
    suffix_dedup.drop_table(name)


def test_query(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op10_suffix_dedup(spark, tiny).collect()), key=str)
    assert got == brute(rows)


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, 5, 7, "x" * 300), (2, 6, 8, "short")], "data long, marks long, kept long, text string")
    out = suffix_dedup.remove_repeats(docs, keep=("data", "marks", "kept"))
    assert out.columns == ["data", "marks", "kept", "n_bytes", "n_removed", "n_spans", "_kept", "removed"]
    assert [(r["data"], r["marks"], r["kept"], r["n_bytes"], len(r["_kept"])) for r in out.orderBy("data").collect()] == [(1, 5, 7, 300, 0), (2, 6, 8, 5, 5)]
