"""Choosing rows: seeded samples, round-robins, keyframes, and what is still to do. Every choice is by a hash of the key, so it is repeatable and needs no driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, key: str) -> Column:
    """A key's place in a seeded shuffle: an md5, which any engine can compute."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def sample_groups(df: DataFrame, group: str, key: str, n: int, *, seed: int = 42, size: str | None = None, least: int = 0) -> DataFrame:
    """SEL7: one key from each of n groups; where sizes are given, one that is long enough, or the longest. The n is the operator's."""
    if size:
        long = F.col(size) >= least
        order = [F.desc(long), F.when(~long, -F.col(size)), F.col("_draw"), F.col(key)]
    else:
        order = [F.col("_draw"), F.col(key)]
    drawn = df.withColumn("_draw", draw(seed, key))
    first = drawn.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("_i = 1")
    return first.withColumn("_g", draw(seed, group)).orderBy("_g", group).limit(n).drop("_draw", "_i", "_g")


def pick_spread(df: DataFrame, done: DataFrame, group: str, key: str, n: int, *, seed: int = 42, round_robin: bool = False) -> DataFrame:
    """SEL8, SEL9: n keys that are not done: one of each group first and then any, or in turn over the sorted groups."""
    todo = df.join(done.select(key).distinct(), key, "left_anti").withColumn("_draw", draw(seed, key))
    nth = todo.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy("_draw", key)))
    order = [F.col("_i"), F.col(group)] if round_robin else [F.col("_i") > 1, F.col("_draw"), F.col(key)]
    return nth.orderBy(*order).limit(n).drop("_draw", "_i")


def take_turns(pools: list[list[tuple]], n: int) -> list[tuple]:
    """SEL10 for two pools of (group, item), shuffled: in turn each gives its first item of a group that neither has given yet, else its first item; n in all, or all there are.

    In a pool, items of groups that have been seen go behind the others, each time in the order in which they stand.
    """
    seen: set = set()
    out: list[tuple] = []
    while len(out) < n and any(pools):
        for i, pool in enumerate(pools):
            if pool and len(out) < n:
                pools[i] = [x for x in pool if x[0] not in seen] + [x for x in pool if x[0] in seen]
                picked = pools[i].pop(0)
                out.append(picked)
                seen.add(picked[0])
    return out


def review_order(df: DataFrame, group: str, key: str, flagged: str, n: int, *, seed: int = 42) -> DataFrame:
    """SEL10: n keys for review, flagged and clean ones in turn, of groups not yet seen as long as there are any: the rows with ``turn``, from 1.

    Of each class, n picks need at most the first n keys of each of the 2 n groups that come first in the shuffle: n groups may have been seen by then, and a class with more still has
    fresh ones. So tasks keep their own first n of each group and class, and what is left, 4 n * n rows at most, is picked in one.
    """
    drawn = df.withColumn("_draw", draw(seed, key)).filter(F.col(flagged).isNotNull())
    firsts = drawn.groupBy(flagged, group).agg(F.min(F.struct("_draw", key)).alias("_first"))
    groups = [firsts.filter(F.col(flagged) == side).orderBy("_first").limit(2 * n) for side in (True, False)]
    wanted = groups[0].unionByName(groups[1]).select(F.col(flagged).alias("_f"), F.col(group).alias("_g"))
    nth = F.row_number().over(Window.partitionBy(flagged, group).orderBy("_draw", key))
    few = drawn.withColumn("_nth", nth).filter(F.col("_nth") <= n).join(F.broadcast(wanted), (F.col(flagged) == F.col("_f")) & F.col(group).eqNullSafe(F.col("_g")), "left_semi")
    rows = few.select(F.col(flagged).alias("f"), F.col(group).cast("string").alias("g"), "_draw", F.col(key).alias("k"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([pd.DataFrame(columns=["f", "g", "_draw", "k"]), *batches]).sort_values(["_draw", "k"])
        pools = [[(None if r.g is None else r.g, r.k) for r in pdf[pdf["f"] == side].itertuples()] for side in (True, False)]
        out = take_turns(pools, n)
        if out:
            yield pd.DataFrame({"k": [k for _, k in out], "turn": range(1, len(out) + 1)})

    kind = df.schema[key].dataType.simpleString()
    turns = rows.coalesce(1).mapInPandas(pick, f"k {kind}, turn int")
    return df.join(F.broadcast(turns.withColumnRenamed("k", "_k")), F.col(key) == F.col("_k")).drop("_k")


def folder_name(category: Column, tasks: Column, first_task: Column) -> Column:
    """SEL11: the category, or the only task, or mixed_tasks."""
    return F.coalesce(category, F.when(tasks == 1, first_task).otherwise("mixed_tasks"))


def keyframes(segments: DataFrame, events: DataFrame, most: int) -> DataFrame:
    """SEL17: up to ``most`` frames of each segment: its ends, its events by falling magnitude, and the middle if there is room: key, id, frame, tag.

    ``events`` has key, id, frame and magnitude. The first tag of a frame stays; frames are taken by rank.
    """
    ends = [segments.select("key", "id", F.col(c).alias("frame"), F.lit(c).alias("tag"), F.lit(i).alias("_p"), F.lit(0.0).alias("_m")) for i, c in enumerate(("start", "end"))]
    inner = events.select("key", "id", "frame", F.lit("event").alias("tag"), F.lit(2).alias("_p"), (-F.col("magnitude")).alias("_m"))
    middle = segments.select("key", "id", F.floor((F.col("start") + F.col("end")) / 2).alias("frame"), F.lit("middle").alias("tag"), F.lit(3).alias("_p"), F.lit(0.0).alias("_m"))
    rows = ends[0].unionByName(ends[1]).unionByName(inner).unionByName(middle)
    order = F.struct("_p", "_m", "frame")
    first = rows.groupBy("key", "id", "frame").agg(F.min_by("tag", order).alias("tag"), F.min(order).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("key", "id").orderBy("_o"))
    return first.withColumn("_r", rank).filter(F.col("_r") <= most).select("key", "id", "frame", "tag")


def budget(bonus: Column, base: int = 4, most: int = 6) -> Column:
    """SEL20: keyframes of a segment with its category's bonus."""
    return F.least(F.lit(base) + F.coalesce(bonus, F.lit(0)), F.lit(most))


def in_windows(events: DataFrame, windows: DataFrame) -> DataFrame:
    """SEL16: ``events`` (key, w, frame, and more) that lie in their own window (key, w, w_start, w_end; both ends belong to it); the others, and those of unknown windows, go."""
    bounds = windows.select("key", "w", F.col("w_start").alias("_a"), F.col("w_end").alias("_b"))
    return events.join(bounds, ["key", "w"]).filter(F.col("frame").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
