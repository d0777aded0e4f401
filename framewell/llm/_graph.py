"""Connected components of a graph in a table, without collecting any part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Alternates two steps until nothing changes: every node's larger neighbours are tied to its smallest one, then its smaller neighbours are.
    Each step is a partial minimum, written as a table, and a join between two shuffles, of which Spark splits the parts of nodes with very many neighbours. A round's tables are
    deleted once the next one's are written.
    """
    now, path = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low, lows = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")))
        large, larges = stored(both.join(low, "a").filter("b > a").select(F.col("low").alias("a"), "b").distinct())
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("low"))
        small = large.withColumnRenamed("b", "u").join(low, "u")
        small = small.select(F.col("low").alias("a"), "u").union(small.filter("a <> low").select("low", "a")).toDF("a", "b").distinct()
        last = path
        now, path = stored(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        for old in (last, lows, larges):
            discard(edges.sparkSession, old)
        if state == known:
            break
        known = state
    # All that is left are stars: every node is tied to its component's smallest.
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
