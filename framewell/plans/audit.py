"""Audits of inputs: of series, and of the table that maps tasks to categories. Each gives a row for every check, with how many keys fail it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J


def _checked(facts: DataFrame, failing: dict[str, Column]) -> DataFrame:
    counts = facts.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(name) for name, c in failing.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failing")) for n in failing]))
    return counts.select(rows.alias("r")).select("r.check", "r.failing", (F.col("r.failing") == 0).alias("passed"))


def audit_series(series: DataFrame, declared: DataFrame, *, most_invalid: float = 0.05, least_frames: int = 15) -> DataFrame:
    """CON4: checks of series (key, frame, x, valid) against their declared lengths (key, n_frames): both sides present, frames dense and single, at most one frame off the
    declared length, values finite, few invalid frames, and long enough. A check that a key has no facts for fails."""
    facts = series.groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("frame").alias("distinct"),
        F.max("frame").alias("last"),
        F.count_if(F.isnan("x") | F.col("x").isNull()).alias("broken"),
        F.avg((~F.col("valid")).cast("double")).alias("invalid"),
    )
    both = facts.join(declared.select("key", "n_frames"), "key", "full_outer")
    return _checked(
        both,
        {
            "paired": F.col("rows").isNull() | F.col("n_frames").isNull(),
            "dense": F.col("distinct") != F.col("last") + 1,
            "single": F.col("rows") != F.col("distinct"),
            "length": F.abs(F.col("rows") - F.col("n_frames")) > 1,
            "finite": F.col("broken") > 0,
            "invalid_share": F.col("invalid") > most_invalid,
            "long_enough": F.col("rows") < least_frames,
        },
    )


def audit_level0(unpaired: DataFrame, probed: DataFrame, sanity: DataFrame, lengths: DataFrame, *, most_invalid: float = 0.05, least_travel: float = 0.01) -> DataFrame:
    """CON4: the checks of raw inputs before anything is built on them, each with how many keys fail it.

    From ``unpaired`` keys (joins.unpaired), what files hold (files.probe_keys), statistics (signals.sanity with camera and height) and ``lengths`` (n_frames and declared): both files are
    there; wrists, pinch tips and camera are in them; invalid frames can be told, by confidences or by entries that are no numbers; poses are of the world, that is the camera moves and
    is above the wrists; lengths differ by a frame at most; few frames are invalid. What is unknown of a key fails it.
    """
    lacks = lambda part: F.exists("missing", lambda m: m.contains(part))
    counted = [unpaired.agg(F.count(F.lit(1)).alias("failing")).select(F.lit("paired").alias("check"), "failing", (F.col("failing") == 0).alias("passed"))]
    counted.append(_checked(probed, {"wrists": lacks("Hand"), "pinch": lacks("Tip"), "camera": lacks("camera")}))
    counted.append(_checked(sanity, {"encoding": F.col("invalid_share").isNull(), "world_frame": ~((F.col("camera_travel") > least_travel) & F.col("camera_above")), "invalid_share": F.col("invalid_share") >= most_invalid}))
    counted.append(_checked(lengths, {"length": F.abs(F.col("n_frames") - F.col("declared")) > 1}))
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def audit_categories(tasks: DataFrame, categories: DataFrame, allowed: list[str]) -> DataFrame:
    """CON3: tasks (task) without a category, categories' tasks (task, category, verbs) that don't exist, tasks mapped twice, and verbs outside the vocabulary."""
    parts = {
        "unmapped": J.missing(tasks, categories, "task"),
        "ghost": J.missing(categories, tasks, "task"),
        "mapped_twice": J.load_categories(categories, "task", "category"),
        "unknown_verb": J.unknown_verbs(categories, "verbs", allowed),
    }
    counted = [df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("failing")) for name, df in parts.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out.withColumn("passed", F.col("failing") == 0)
