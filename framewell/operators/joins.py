"""Relations between keyed tables: pairing, dimensions, bands, as-of, division, and agreement of boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpaired(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """JN1, SET1: keys that only one side has, with ``side`` a or b."""
    both = a.select(*on, F.lit(True).alias("_a")).distinct().join(b.select(*on, F.lit(True).alias("_b")).distinct(), on, "full_outer")
    return both.filter("_a IS NULL OR _b IS NULL").select(*on, F.when(F.col("_b").isNull(), "a").otherwise("b").alias("side"))


def with_dimension(df: DataFrame, dimension: DataFrame, on: str) -> DataFrame:
    """JN2, SEL5: left join; unmapped rows have NULLs. The dimension's own statistics decide whether it is broadcast."""
    return df.join(dimension, on, "left")


def with_overrides(df: DataFrame, overrides: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """JN3, SEL4: a sparse table's values replace the defaults where there are any."""
    joined = df.join(overrides.select(on, *[F.col(c).alias(f"_{c}") for c in columns]), on, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def load_categories(df: DataFrame, task: str, category: str) -> DataFrame:
    """SRC11: tasks that more than one row maps, which make a category table invalid."""
    return df.groupBy(task).agg(F.count(F.lit(1)).alias("rows"), F.min(category).alias("first_category")).filter("rows > 1")


def near(left: DataFrame, right: DataFrame, tolerance: int, how: str = "inner") -> DataFrame:
    """Band join on key and |frame - other| <= tolerance: frames fall in buckets of the tolerance, and the right side goes to three of them, so that it is an equi-join.

    ``right`` has key and other, besides its own columns. ``how`` may be inner or left_semi.
    """
    width = tolerance + 1
    a = left.withColumn("_bucket", F.floor(F.col("frame") / width))
    b = right.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("other") / width) + d for d in (-1, 0, 1)]))).withColumnRenamed("key", "_key")
    close = (a["key"] == b["_key"]) & (a["_bucket"] == b["_bucket"]) & (F.abs(F.col("frame") - F.col("other")) <= tolerance)
    return a.join(b, close, how).drop("_bucket", "_key")


def segments_with_event_near(segments: DataFrame, events: DataFrame, place: str, tolerance: int) -> DataFrame:
    """JN5: segments with an event within ``tolerance`` frames of their ``place`` (start or end)."""
    return near(segments.withColumn("frame", F.col(place)), events.select("key", F.col("frame").alias("other")), tolerance, "left_semi").drop("frame")


def handovers(events: DataFrame, positions: DataFrame, *, frames: int, distance: float) -> DataFrame:
    """JN6: grasps and releases by different hands within ``frames`` of each other, whose hands are at most ``distance`` apart half way: key, grasp, release.

    ``positions`` has key, frame and apart, the hands' distance.
    """
    grasp = events.filter("type = 'grasp'").select("key", "frame", F.col("hand").alias("_h"))
    release = events.filter("type = 'release'").select("key", F.col("frame").alias("other"), F.col("hand").alias("_g"))
    pairs = near(grasp, release, frames).filter("_h <> _g").withColumn("_mid", F.floor((F.col("frame") + F.col("other")) / 2))
    where = positions.select(F.col("key").alias("_k"), F.col("frame").alias("_f"), "apart")
    return pairs.join(where, (F.col("key") == F.col("_k")) & (F.col("_mid") == F.col("_f"))).filter(F.col("apart") <= distance).select("key", F.col("frame").alias("grasp"), F.col("other").alias("release"))


def as_of(frames: DataFrame, captions: DataFrame) -> DataFrame:
    """JN7: for every frame the caption of the segment that holds it, else of the last one that began; captions have key, start and caption."""
    rows = captions.select("key", F.col("start").alias("frame"), "caption", F.lit(0).alias("_o")).unionByName(frames.select("key", "frame", F.lit(1).alias("_o")), allowMissingColumns=True)
    line = Window.partitionBy("key").orderBy("frame", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("caption", F.last("caption", ignorenulls=True).over(line)).filter("_o = 1").select("key", "frame", "caption")


def in_all(df: DataFrame, item: str, group: str) -> DataFrame:
    """JN11: relational division: items that come with every value of ``group``."""
    wanted = df.agg(F.count_distinct(group).alias("_k"))
    counts = df.groupBy(item).agg(F.count_distinct(group).alias("_n"))
    return counts.join(wanted, F.col("_n") == F.col("_k")).select(item)


def missing(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """JN14, JN16, SEL12, SET2: distinct values of ``on`` that the right side lacks: unmapped tasks, ghosts, keys still to do."""
    return left.select(on).distinct().join(right.select(on).distinct(), on, "left_anti")


def verdicts_of_subtasks(verdicts: DataFrame, subtasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN12: verdicts (key, id, and axes) with the subtasks (key, id, and more) that they judge, and the keys of verdicts without any annotation, which are reported."""
    absent = verdicts.select("key").distinct().join(subtasks.select("key").distinct(), "key", "left_anti")
    return verdicts.join(subtasks, ["key", "id"]), absent


def unblind(votes: DataFrame, letters: DataFrame) -> DataFrame:
    """JN13: votes (key, best, worst: letters) with the configurations that stood behind their letters (key, letter, config); a letter that the key lacks gives NULL.

    There are letters for every key: they are merged, for rows that are made from a small file look small enough to broadcast, however many they are.
    """
    out = votes
    for side in ("best", "worst"):
        named = letters.select("key", F.col("letter").alias(side), F.col("config").alias(f"{side}_config"))
        out = out.join(named.hint("merge"), ["key", side], "left")
    return out


def unknown_verbs(df: DataFrame, verbs: str, allowed: list[str]) -> DataFrame:
    """JN15: rows with verbs outside a vocabulary, and which."""
    return df.withColumn("unknown", F.array_except(verbs, F.array(*map(F.lit, allowed)))).filter("size(unknown) > 0")


def mutual_hits(boundaries: DataFrame, tolerance: int) -> DataFrame:
    """JN9: for each two configurations a < b of ``boundaries`` (config, key, frame) and each key with a boundary of either: how many boundaries a and b have (n_a, n_b), and how many of
    each lie within ``tolerance`` of one of the other (hits_a, hits_b).

    The nearest boundary of the other on either side decides. One pass forward and one back over the boundaries of both give both directions, so that no boundary meets another.
    """
    configs = boundaries.select("config").distinct()
    pairs = configs.select(F.col("config").alias("a")).join(configs.select(F.col("config").alias("b")), F.col("a") < F.col("b"))
    side = lambda c: F.struct(F.col(c).alias("config"), F.lit(c).alias("side"))
    sides = pairs.select("a", "b", F.explode(F.array(side("a"), side("b"))).alias("s")).select("a", "b", "s.*")
    rows = boundaries.join(sides, "config")
    so_far = (Window.unboundedPreceding, 0)
    forward = Window.partitionBy("a", "b", "key").orderBy("frame").rangeBetween(*so_far)
    back = Window.partitionBy("a", "b", "key").orderBy(F.desc("frame")).rangeBetween(*so_far)
    of: dict[str, Column] = {s: F.when(F.col("side") == s, F.col("frame")) for s in "ab"}
    rows = rows.withColumns({f"_before_{s}": F.max(of[s]).over(forward) for s in "ab"}).withColumns({f"_after_{s}": F.min(of[s]).over(back) for s in "ab"})
    near = lambda s: F.coalesce(F.least(F.col("frame") - F.col(f"_before_{s}"), F.col(f"_after_{s}") - F.col("frame")) <= tolerance, F.lit(False))
    own = lambda s: F.col("side") == s
    return rows.groupBy("a", "b", "key").agg(*[F.count_if(own(s)).alias(f"n_{s}") for s in "ab"], *[F.count_if(own(s) & near(o)).alias(f"hits_{s}") for s, o in ("ab", "ba")])
