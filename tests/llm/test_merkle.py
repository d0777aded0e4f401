"""The manifest against a tree built level by level in Python."""

import hashlib
import zlib

from framewell.llm import merkle as M
from framewell.llm import queries
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def walk(levels, i, node):
    proof = []
    for nodes in levels[:-1]:
        run = nodes[i // 2 * 2 : i // 2 * 2 + 2]
        proof += [x for k, x in enumerate(run) if k != i % 2]
        run[i % 2] = node
        node, i = h(*run), i // 2
    return node, proof


def brute(rows):
    """rows of doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted((((r[0] is not None, r[0] or 0, leaf_of(r)), r) for r in groups[g]), key=lambda x: x[0])
        trees[g] = ([r for _, r in own], climb([k[2] for k, _ in own]))
    top = climb([trees[g][1][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        own, levels = trees[g]
        for i, r in enumerate(own):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            shown = leaf_of((*r[:3], r[3] + 1, r[4])) if hit else leaf_of(r)
            sub, low = walk(levels, i, shown)
            root, high = walk(top, at, sub)
            out.append((r[0], leaf_of(r), levels[-1][0], top[-1][0], h(*low, *high), root, root == top[-1][0]))
    return sorted(map(str, out))


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(str(tuple(r)) for r in queries.op13_merkle(spark, str(tmp_path)).collect())


def test_sizes_of_all_kinds(spark, tmp_path):
    """Trees of one to over 65,536 leaves would take long; one of 70,000 needs three rounds, and smaller ones have every shape. Languages: null, empty, and beyond ASCII."""
    rows, n = [], 0
    for lang, size in ((None, 3), ("", 1), ("a", 256), ("ab", 257), ("é", 513), ("z", 1), ("\U00010000", 2), ("￿", 7)):
        for _ in range(size):
            rows.append((n, f"s{n % 3}", lang, n * 2 if n % 5 else None, f"text é {n}" if n % 11 else None))
            n += 1
    assert run(spark, rows, tmp_path) == brute(rows)


def test_ties_nulls_and_repeats(spark, tmp_path):
    """Null ids come first, equal ids by leaf, equal rows each for itself; long and empty texts."""
    rows = [(None, "s", "en", 1, "a"), (None, None, "en", None, None), (5, "s", "en", 1, "b"), (5, "s", "en", 1, "a"), (5, "s", "en", 1, "a"), (7, None, None, None, ""), (-3, "s", "en", 2, "x" * 300_000)] + [(9, "s", "en", 4, "same")] * 300
    assert run(spark, rows, tmp_path) == brute(rows)


def test_files_of_few_rows(spark, tmp_path):
    """Tasks that write many files each keep the order."""
    rows = [(i * 37 % 1009, "s", "en" if i % 3 else "de", i, f"t{i}") for i in range(1009)]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        assert run(spark, rows, tmp_path) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_three_rounds(spark):
    """70,000 leaves of one group: every proof folds to the root, and a changed leaf to another one."""
    docs = spark.range(70_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang"), F.lit("clash").alias("leaf"), F.lit("clash").alias("path"))
    proofs = M.manifest(docs, M.row_digest([F.col("doc_id")]), keep={"root": F.col("doc_id")}).proofs()
    levels = climb([leaf_of((i,)) for i in range(70_000)])
    got = proofs.select(F.col("row.root").alias("doc_id"), "leaf", "root", M.folded(F.col("leaf"), F.col("path")).alias("whole"), M.folded(F.lit("0" * 64), F.col("path")).alias("forged"), F.size("path").alias("steps"), M.proof_digest(F.col("path")).alias("proof"))
    assert got.count() == 70_000
    assert got.filter("whole <> root").count() == 0 and got.filter("forged = root").count() == 0 and got.filter("steps <> 17").count() == 0
    rows = {r[0]: r for r in got.collect()}
    for i in (0, 255, 256, 65_535, 65_536, 69_999):
        assert rows[i]["proof"] == h(*walk(levels, i, levels[0][i])[1]) and rows[i]["whole"] == levels[-1][0]


def test_positions(spark):
    """The closed form against a log written one node at a time."""
    for size in (1, 2, 3, 5, 8, 13, 256):
        height = max(size - 1, 0).bit_length()
        want = []
        for e in range(size):
            want.append((0, e))
            level = 1
            while level <= height and (e == size - 1 or (e + 1) % (1 << level) == 0):
                want.append((level, e >> level))
                level += 1
        asked = spark.createDataFrame([(level, i, at, size) for at, (level, i) in enumerate(want)], "level int, i long, at int, size long")
        assert asked.filter(M.position(F.col("level"), F.col("i"), F.col("size")) != F.col("at")).count() == 0
