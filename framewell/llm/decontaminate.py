"""Benchmark decontamination: SimHash fingerprints of item-sized windows, looked up in blocks that guarantee every fingerprint within a radius, then verified exactly."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import content_key, let, spare, table

#: Words of a shingle, the least similarity, and the most bits in which fingerprints of a window and an item may differ.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 17
#: Blocks of a fingerprint, and in how many bits one of them may differ: two fingerprints within RADIUS agree in one block up to that many bits, for (SLACK + 1) * BLOCKS > RADIUS.
BLOCKS, SLACK = 6, 2
#: Rows up to this many are broadcast, of the benchmark's shingles, its index and the windows that are looked up; beyond, both sides are shuffled.
BROADCAST_ROWS = 400_000
EDGES = [64 * i // BLOCKS for i in range(BLOCKS + 1)]


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingle_hashes(tokens: Column) -> Column:
    """Hashes of all runs of SHINGLE words, in order."""

    def runs(h: Column) -> Column:
        return F.when(F.size(h) >= SHINGLE, F.transform(F.slice(h, F.lit(1), F.size(h) - (SHINGLE - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), runs)


def simhash(hashes: Column) -> Column:
    """64 bits: each is set where it is in more than half of the hashes, repeated ones counted as often as they come. Two bits are counted at a time, in the halves of a long."""
    two = F.lit(1 | 1 << 32)
    counted = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + F.call_function("shiftrightunsigned", h, k).bitwiseAND(two)))
    half = F.size(hashes) / 2

    def bits(s: Column, k: Column) -> Column:
        low = F.when(s.bitwiseAND(F.lit((1 << 32) - 1)) > half, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        high = F.when(F.shiftrightunsigned(s, 32) > half, F.lit(1 << 32)).otherwise(F.lit(0).cast("long"))
        return F.call_function("shiftleft", low.bitwiseOR(high), k)

    return F.aggregate(F.transform(counted, bits), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def blocks(fingerprint: Column) -> Column:
    """The fingerprint's BLOCKS blocks as (block, bits)."""
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))])


def probes(fingerprint: Column) -> Column:
    """Its blocks and all that differ from them in up to SLACK bits, as (block, bits)."""
    masks = [[sum(1 << k for k in flips) for n in range(SLACK + 1) for flips in itertools.combinations(range(b - a), n)] for a, b in zip(EDGES, EDGES[1:], strict=False)]
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in masks])
    return F.flatten(F.transform(blocks(fingerprint), lambda x: F.transform(F.get(table, x["block"]), lambda m: F.struct(x["block"].alias("block"), x["bits"].bitwiseXOR(m).alias("bits")))))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two bags of hashes: each distinct one weighs as often as it comes; the sum of the smaller weights over that of the larger ones.

    Where one of the bags repeats nothing, that is a count of common hashes.
    """
    count = lambda bag, h: F.size(F.filter(bag, lambda x: x == h))
    common = F.array_intersect(a, b)
    single = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    weights = F.aggregate(F.transform(common, lambda h: F.least(count(a, h), count(b, h))), F.lit(0), lambda s, x: s + x)
    shared = F.when(single, F.size(common)).otherwise(weights)
    return let(shared, lambda s: s / (F.size(a) + F.size(b) - s).cast("double"))


def window_starts(places: Column, size: Column, n: Column, similarity: float) -> Column:
    """Where windows of n shingles begin that hold enough of ``places``, a text's sorted places of shared shingles, to be similar; a text of fewer is one window, at 0.

    A window with k shared shingles has a similarity of at most k / (2 n - k). The i-th place is the first of a window from behind the place before up to itself, and
    the window must reach the last place that it needs.
    """
    need = lambda length: F.ceil(F.lit(similarity / (1 + similarity)) * (n + length) - 1e-9).cast("int")
    least = F.greatest(need(n), F.lit(1))

    def begins(place: Column, i: Column) -> Column:
        low = F.greatest(F.lit(0), F.coalesce(F.get(places, i - 1) + 1, F.lit(0)), F.get(places, i + least - 1) - n + 1)
        high = F.least(place, size - n)
        return F.when((i + least <= F.size(places)) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    whole = F.when(F.size(places) >= need(size), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when(size < n, whole).otherwise(F.flatten(F.transform(places, begins)))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    items = benchmark.select(F.col(item_col).alias("item_id"), shingle_hashes(words(F.col(text_col))).alias("bag")).filter(F.size("bag") > 0)
    return items.withColumns({"n": F.size("bag"), "print": simhash(F.col("bag"))})


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, which are counted first."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, key, item_id, similarity, start): every benchmark item that some window of a document repeats, with the best window's first word, from 0.

    A window has as many words as the item; a text shorter than the item is one window. Windows are laid at every place of a text where they hold enough shingles of items of
    that length, in any order, to be similar; all others are below the similarity. A window's 64-bit SimHash is looked up by BLOCKS blocks, up to SLACK bits off, which finds
    every item of that length within RADIUS bits; candidates must then have a weighted similarity of ``similarity`` or more by their bags of SHINGLE-word shingles. A pair at 0.8
    is beyond the radius about four times in a thousand, one at 0.85 hardly ever. An item of fewer than SHINGLE words has no shingle and is never found; neither is anything in
    a null or empty text. Items with equal texts are all reported. key is content_key of id and text; rows that are equal in both are reported once. Very long texts are taken whole.
    """
    items = table(_items(benchmark, item_col, item_text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), content_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    bag = shingle_hashes(words(F.col("text"))).alias("bag")
    known = items.select("n", F.explode("bag").alias("shingle")).distinct()
    hits = rows.select("key", bag).select("key", F.size("bag").alias("size"), F.posexplode("bag").alias("place", "shingle")).join(_bounded(known, broadcast_rows), "shingle")
    placed = hits.groupBy("key", "n", "size").agg(F.array_sort(F.collect_set("place")).alias("places"))
    starts = table(placed.select("key", "n", F.explode(window_starts(F.col("places"), F.col("size"), F.col("n"), similarity)).alias("start")))
    # Few texts have such a place, so they are read once more and cut up only then.
    asked = _bounded(starts.groupBy("key").agg(F.collect_list(F.struct("n", "start")).alias("asked")), broadcast_rows)
    cut = rows.join(asked, "key").dropDuplicates(["key"]).select("doc_id", "key", bag, "asked").select("doc_id", "key", "bag", F.explode("asked").alias("w"))
    windows = cut.select("doc_id", "key", "w.start", "w.n", F.slice("bag", F.col("w.start") + 1, F.col("w.n")).alias("window")).withColumn("print", simhash(F.col("window")))
    index = items.select("item_id", "n", F.col("print").alias("item_print"), F.explode(probes(F.col("print"))).alias("b")).select("item_id", "n", "item_print", "b.block", "b.bits")
    looked = windows.withColumn("b", F.explode(blocks(F.col("print")))).select("doc_id", "key", "start", "n", "print", "window", "b.block", "b.bits")
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    pairs = looked.join(_bounded(index, broadcast_rows), ["n", "block", "bits"]).filter(near)
    scored = pairs.join(items.select("item_id", "n", F.col("print").alias("item_print"), "bag"), ["item_id", "n", "item_print"])
    scored = scored.withColumn("similarity", weighted_jaccard(F.col("window"), F.col("bag"))).filter(F.col("similarity") >= similarity)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start"))
    return scored.groupBy("doc_id", "key", "item_id").agg(best.alias("best")).select("doc_id", "key", "item_id", (-F.col("best.s")).alias("similarity"), F.col("best.start").alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which find_leaks finds nothing, with all their columns, whatever their names; null and empty texts stay."""
    key = spare(docs.columns, "key")
    leaks = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("key").alias(key)).distinct()
    keyed = docs.withColumn(key, content_key(F.col(id_col), F.col(text_col)))
    return keyed.join(leaks, key, "left_anti").select(*docs.columns)
