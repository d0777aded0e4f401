"""Folds and joins on many rows of one key, and choices and medians against plain restatements."""

import json
import random
import time
import uuid

from framewell.operators import intervals as I
from framewell.operators import joins as J
from framewell.operators import reports as R
from framewell.operators import selection as P
from framewell.plans import labeling as L
from framewell.sources import tables as T
from pyspark.sql import functions as F


def naive_clusters(rows, share):
    kept = []
    for row in rows:
        home = next((m for m in kept if I._label(m) == I._label(row) and I.common_share(m, row) >= share), None)
        if home is None:
            kept.append(dict(row))
        else:
            home.update(I._surer(home, row), start=min(home["start"], row["start"]), end=max(home["end"], row["end"]))
    return sorted(kept, key=lambda r: (r["start"], r["end"]))


def candidate(draw, start, length, labels=2):
    return {"start": start, "end": start + length, "action": f"a{draw.randrange(labels)}", "hand": draw.choice(["left", "both"]), "object": draw.choice(["the cup", "cup"]), "confidence": draw.choice(["low", "medium", "high"])}


def test_clusters_equal_a_search_of_all(spark):
    draw = random.Random(2)
    for _ in range(300):
        rows = sorted((candidate(draw, draw.randrange(60), draw.choice([1, 2, 5, 9, 30, 60])) for _ in range(40)), key=lambda r: (r["start"], r["end"]))
        for share in (0.2, 0.5, 0.8):
            assert I.clusters(rows, share) == naive_clusters(rows, share)


def test_clusters_of_one_label_are_linear():
    """A hundred thousand candidates of one label: of like lengths, of very unequal ones, and under one that spans them all."""
    draw = random.Random(3)
    for lengths in ([30], [1, 10, 100, 1000, 10_000], [2**i for i in range(17)]):
        rows = [candidate(draw, i, draw.choice(lengths), 1) for i in range(100_000)]
        rows.insert(0, candidate(draw, 0, 100_000, 1))
        begin = time.time()
        assert len(list(I.resolved(I.clusters(rows, 0.5)))) > 0
        assert time.time() - begin < 30


def test_overlaps_by_brute_force(spark):
    draw = random.Random(4)
    rows = [(draw.randrange(3), i, draw.choice("ab"), draw.choice(["the x", "x"]), s := draw.randrange(200), s + draw.choice([0, 1, 2, 3, 7, 20, 64, 150])) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, id long, action string, object string, start long, end long")
    for share in (0.05, 0.3, 0.5, 1.0):
        got = [(r["key"], r["id"], r["other"], round(r["iou"], 9)) for r in I.same_label_overlaps(df, share=share).collect()]
        want = set()
        for a in rows:
            for b in rows:
                if a[1] < b[1] and a[0] == b[0] and a[2] == b[2] and a[4] < a[5] and b[4] < b[5]:
                    both = max(min(a[5], b[5]) - max(a[4], b[4]), 0) / (max(a[5], b[5]) - min(a[4], b[4]))
                    if both >= share:
                        want.add((a[0], a[1], b[1], round(both, 9)))
        assert set(got) == want and len(got) == len(want)


def test_one_long_interval_meets_no_short_ones(spark):
    """A hundred thousand short intervals, each touching the next, and one as long as all: rows joined are a small multiple of the intervals."""
    short = spark.range(100_000).select(F.lit(1).alias("key"), "id", F.lit("a").alias("action"), F.lit("x").alias("object"), (F.col("id") * 2).alias("start"), (F.col("id") * 2 + 3).alias("end"))
    long = spark.createDataFrame([(1, 100_000, "a", "x", 0, 200_001)], short.schema)
    begin = time.time()
    assert I.same_label_overlaps(short.unionByName(long), share=0.2).count() == 99_999
    assert time.time() - begin < 60


def turns(pools, n):
    """The rule as it is told: sort the pool by whether its groups are seen, take the first."""
    out, seen = [], set()
    while len(out) < n and any(pools):
        for pool in pools:
            if len(out) >= n:
                break
            pool.sort(key=lambda x: x[0] in seen)
            if pool:
                out.append(pool.pop(0))
                seen.add(out[-1][0])
    return out


def test_review_order(spark):
    import hashlib

    draw = random.Random(5)
    for groups, size, n in ((3, 60, 12), (40, 200, 9), (2, 9, 50), (1, 30, 7)):
        rows = [(draw.choice([None, *range(groups)]) if groups > 3 else draw.randrange(groups), i, draw.random() < 0.3) for i in range(size)]
        df = spark.createDataFrame(rows, "g long, k long, flagged boolean")
        got = [(r["turn"], r["k"]) for r in P.review_order(df, "g", "k", "flagged", n).orderBy("turn").collect()]
        order = sorted(rows, key=lambda r: (hashlib.md5(f"42:{r[1]}".encode()).hexdigest(), r[1]))
        want = turns([[(r[0], r[1]) for r in order if r[2] is side] for side in (True, False)], n)
        assert got == [(i, k) for i, (_, k) in enumerate(want, 1)]
    assert P.review_order(df.limit(0), "g", "k", "flagged", 5).count() == 0


def test_upper_median(spark):
    draw = random.Random(6)
    rows = [(g, draw.choice([draw.randrange(30), draw.randrange(10**6)]) if g else None) for g in range(6) for _ in range(draw.randrange(1, 300))]
    df = spark.createDataFrame(rows, "key long, v long")
    want = {}
    for g in range(1, 6):
        own = sorted(v for k, v in rows if k == g)
        want[g] = own[len(own) // 2]
    for width in (1, 7, 4096):
        assert {r["key"]: r["upper_median"] for r in I.upper_median(df, F.col("v"), width=width).collect()} == want
    plan = R.config_metrics(spark.createDataFrame([("c", 1, 1, 1, 1, 1.0)], "config string, key long, windows long, candidates long, stitched long, wall_s double"), spark.createDataFrame([("c", 1, 0, 5, "a", "low", ["x"])], "config string, key long, start long, end long, action string, confidence string, flags array<string>"))
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()


def test_a_task_has_a_bounded_number_of_rows(spark, tiny, monkeypatch):
    """Series and what follows in their partitions, however small these are in compressed bytes."""
    rows = T.read(spark, tiny, "events").count()
    assert T.dealt(T.read(spark, tiny, "events"), "user_id").rdd.getNumPartitions() == T.read(spark, tiny, "events").rdd.getNumPartitions()
    monkeypatch.setattr(T, "TASK_ROWS", rows // 30)
    assert T.frames(spark, tiny).rdd.getNumPartitions() == -(-rows // (rows // 30))


def test_letters_are_never_sent_whole(spark):
    """As many letters as votes, from a source that looks small, and a letter that its key lacks."""
    votes = spark.range(40).selectExpr("id AS key", "'A' AS best", "'Z' AS worst")
    letters = spark.range(40).selectExpr("id AS key", "'A' AS letter", "'config ' || id AS config")
    out = J.unblind(votes, letters)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["key"], r["best_config"], r["worst_config"]) for r in out.collect()) == [(i, f"config {i}", None) for i in range(40)]


def test_a_worker_is_given_one_labeler_for_all_its_keys(spark, tmp_path):
    """And short prompts of many keys are dealt to all tasks; sentences before are the key's own."""
    folder = str(tmp_path)

    def make():
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return lambda prompt: json.dumps({"action": "reach", "hand": "left", "object": "cup", "sentence": prompt.replace("\n", "/"), "confidence": "low"})

    rows = spark.range(120).selectExpr("id % 40 AS key", "id DIV 40 AS id", "'k' || id % 40 AS prompt").coalesce(1)
    got = {(r["key"], r["id"]): r["sentence"] for r in L.label_segments(rows, make, wait_s=0.0).collect()}
    assert len(got) == 120 and all(got[k, 1] == f"Before: k{k}/k{k}" and got[k, 2].count("Before: k") >= 2 for k in range(40))
    assert 2 <= len(list(tmp_path.iterdir())) <= L.tasks_of(rows)
