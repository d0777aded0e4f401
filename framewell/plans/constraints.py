"""Constraints of finished annotations, as tables of violations, and the split of valid keys from quarantined ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V


#: By how many seconds a time may differ from its frame's.
TIME_TOLERANCE = 1e-6


def violations(df: DataFrame, *, least: int = 0, fps: float = V.FPS, keys: DataFrame | None = None) -> DataFrame:
    """CON1, CON2: (key, id, rule) for every broken rule of rows (key, id, start, end, action, hand, n_frames).

    Rules: known words; ids from 0 without gaps; the first row starts at 0 and the last ends on the last frame; each row starts where the one before ends; none is empty or
    shorter than ``least``, unless the whole series is. Where the rows have them, a confidence is known, a sentence is not blank, and start_time, end_time and duration are those of
    the frames at ``fps``. What a null leaves undecided counts as broken. Keys of ``keys`` without rows break the rule no_rows, with a null id.
    """
    line = Window.partitionBy("key").orderBy("id", "start", "end")
    place, before = F.row_number().over(line) - 1, F.lag("end").over(line)
    last = F.lead(F.lit(1)).over(line).isNull()
    rules = {
        "action": ~F.col("action").isin(V.ACTIONS),
        "hand": ~F.col("hand").isin(V.HANDS),
        "ids": F.col("id") != F.col("_place"),
        "start": (F.col("_place") == 0) & (F.col("start") != 0),
        "contiguous": (F.col("_place") > 0) & (F.col("start") != F.col("_before")),
        "end": F.col("_last") & (F.col("end") != F.col("n_frames") - 1),
        "empty": F.col("end") <= F.col("start"),
        "length": (F.col("end") - F.col("start") < least) & (F.col("n_frames") - 1 >= least),
    }
    if "confidence" in df.columns:
        rules["confidence"] = ~F.col("confidence").isin(V.CONFIDENCES)
    if "sentence" in df.columns:
        rules["sentence"] = F.coalesce(F.trim("sentence"), F.lit("")).rlike(r"^\s*$")
    for name, frames in (("start_time", F.col("start")), ("end_time", F.col("end")), ("duration", F.col("end") - F.col("start"))):
        if name in df.columns:
            rules[name] = F.abs(F.col(name) - frames / fps) > TIME_TOLERANCE
    rows = df.withColumns({"_place": place, "_before": before, "_last": last})
    named = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    broken = rows.select("key", "id", F.explode(named).alias("rule"))
    if keys is None:
        return broken
    absent = keys.select("key").distinct().join(df.select("key").distinct(), "key", "left_anti")
    return broken.unionByName(absent.withColumn("rule", F.lit("no_rows")), allowMissingColumns=True)


def split_valid(df: DataFrame, *, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """SNK4, DRV2: rows of keys without violations, and rows of the others. A null key is a key."""
    bad = violations(df, least=least).select(F.col("key").alias("_bad")).distinct()
    same = F.col("key").eqNullSafe(F.col("_bad"))
    return df.join(bad, same, "left_anti"), df.join(bad, same, "left_semi")


def bad_queue(annotations: DataFrame) -> DataFrame:
    """CON2, SET2: annotations (key, ids, review_queue) whose queue names an id that they lack."""
    return annotations.withColumn("unknown", F.array_except("review_queue", "ids")).filter("size(unknown) > 0")
