"""Decontamination against brute force over all windows."""

import random
import re
from collections import Counter

from framewell.llm import decontaminate, queries
from pyspark.sql import functions as F


def bag(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(docs, items, least=0.8):
    """Pairs with a window of similarity ``least``."""
    tokens = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    index, out = {}, set()
    bags = {i: Counter(bag(tokens(t))) for i, t in items}
    for i, b in bags.items():
        for s in b:
            index.setdefault(s, set()).add(i)
    for d, text in docs:
        own = bag(tokens(text))
        for i in {i for s in own for i in index.get(s, ())}:
            n = sum(bags[i].values())
            for at in range(len(own) - n + 1):
                w = Counter(own[at : at + n])
                k = sum((w & bags[i]).values())
                if k / (2 * n - k) >= least:
                    out.add((d, i))
                    break
    return out


def test_exact_and_near(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 60)))) for i in range(40)] + [(50, "too short an item"), (51, None), (52, ""), (53, " ".join(["echo"] * 20))]
    items.append((60, items[0][1].upper() + "!"))
    docs = []
    for d in range(120):
        w = [word() for _ in range(rng.randint(0, 150))]
        if d % 2:
            inner = items[d % 40][1].split()
            if d % 4 == 1:
                inner[rng.choice([0, 1, -1, -2])] = word()
            w[len(w) // 2 : len(w) // 2] = inner
        docs.append((d, " ".join(w)))
    docs += [(200, None), (201, ""), (None, items[3][1]), (202, "echo " * 500), (203, items[5][1].replace(" ", ",\n")), (203, items[5][1].replace(" ", ",\n"))]
    table = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    leaks = decontaminate.find_leaks(table, bench)
    got = {(r["doc_id"], r["item_id"]) for r in leaks.collect()}
    want = brute(docs, items)
    sure = brute(docs, items, 0.88)
    assert sure <= got <= want and len(got) >= 0.95 * len(want)
    again = decontaminate.find_leaks(table, bench, broadcast_rows=3)
    assert {(r["doc_id"], r["item_id"]) for r in again.collect()} == got
    clean = decontaminate.decontaminate(table, bench)
    assert clean.columns == table.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _ in docs if d is not None and d not in {x for x, _ in got})
    assert decontaminate.find_leaks(table.limit(0), bench).count() == decontaminate.find_leaks(table, bench.limit(0)).count() == 0


def test_passages_cut_at_an_edge(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(12)]
    docs = []
    for i, text in items:
        w, rest = text.split(), [word() for _ in range(30)]
        # Begins or ends inside the item with one or two words missing, or is no more than a part of it.
        docs += [(10 * i, " ".join(w[1 + i % 2 :] + rest)), (10 * i + 1, " ".join(rest + w[: -1 - i % 2])), (10 * i + 2, " ".join(w[:-1])), (10 * i + 3, " ".join(w[2:])), (10 * i + 4, " ".join(w[1:-1]))]
        docs += [(10 * i + 5, " ".join(w[:20])), (10 * i + 6, " ".join(w[20:] + rest)), (10 * i + 7, " ".join(w[:6]))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(10 * i + k, i) for i, _ in items for k in range(5)}
    assert {p for p in want if p[0] % 10 < 2} == brute(docs, items)
    for bound in (decontaminate.BROADCAST_ROWS, 3):
        leaks = decontaminate.find_leaks(table, bench, broadcast_rows=bound).collect()
        assert {(r["doc_id"], r["item_id"]) for r in leaks} == want
        found = {r["doc_id"]: (round(r["similarity"], 6), r["start"]) for r in leaks}
        assert (found[0], found[1], found[2]) == ((round(35 / 37, 6), 0), (round(35 / 37, 6), 29), (round(35 / 36, 6), 0))
    assert {r["doc_id"] for r in decontaminate.decontaminate(table, bench).collect()} == {d for d, _ in docs if d % 10 > 4}


def test_reordered_items(spark):
    """A window counts by its bag of shingles, in whatever order they come."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    items, docs = [], []
    for i in range(12):
        w = [word() for _ in range(rng.randint(60, 110))]
        items.append((i, " ".join(w)))
        turned = {0: w[len(w) // 2 :] + w[: len(w) // 2], 1: w[5:] + w[:5], 2: w[-1:] + w[:-1], 3: w[20:40] + w[:20] + w[40:]}
        for k, t in turned.items():
            docs.append((10 * i + k, " ".join([word() for _ in range(rng.randint(0, 40))] + t + [word() for _ in range(rng.randint(0, 40))])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert len(want) > 36 and brute(docs, items, 0.85) <= got <= want


def test_recall_at_the_threshold(spark):
    """Of pairs whose similarity is only just enough, few are beyond the radius."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items, docs = [], []
    for i in range(150):
        w = [word() for _ in range(44)]
        # 36 of 40 shingles stay: a similarity of 36 / 44.
        items.append((i, " ".join(w)))
        docs.append((i, " ".join([word() for _ in range(20)] + [word() for _ in range(4)] + w[4:] + [word() for _ in range(20)])))
    want = brute(docs, items)
    assert len(want) == 150
    leaks = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert leaks.count() >= 148


def test_repeated_shingles(spark):
    items = [(1, "a b c d e a b c d e a b c d e x y z"), (2, " ".join(["echo"] * 30))]
    docs = [(1, "a b c d e a b c d e a b c d e x y z"), (2, " ".join(["echo"] * 26)), (3, " ".join(["echo"] * 20)), (4, "a b c d e " * 9), (5, "long " * 30000 + items[0][1])]
    leaks = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in leaks.collect()} == {(1, 1), (2, 2), (5, 1)}


def test_blocks_guarantee_the_radius(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << k
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    shared = F.size(F.array_intersect(decontaminate.probes(F.col("a")), decontaminate.blocks(F.col("b"))))
    assert df.select(F.min(shared)).first()[0] >= 1


def test_query(spark, tiny):
    read = lambda t: spark.read.parquet(f"{tiny}/{t}.parquet").collect()
    want = brute([(r["doc_id"], r["text"]) for r in read("documents")], [(r["item_id"], r["text"]) for r in read("benchmark")])
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_decontamination(spark, tiny).collect()}
    assert want and got == want
