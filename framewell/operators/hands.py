"""Which hand does a segment's work, from the series inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V


#: Frames of a block, by which frames meet segments that overlap others.
BLOCK = 1024


def _held(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """``frames`` (``_o`` 1) and the segments' own rows (``_o`` 0), with an array ``_held`` of the segments (id, start, end) that hold each: at most the last to start, and the one that ends there."""
    marks = segments.select("key", F.col("start").alias("frame"), F.struct("id", "start", "end").alias("_s"), F.lit(0).alias("_o"))
    line = Window.partitionBy("key").orderBy("frame", "_o")
    rows = marks.unionByName(frames.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    now = F.last("_s", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    # The segment before is the one of the last frame before this one's start.
    rows = rows.withColumn("_now", now).withColumn("_last", F.when(F.col("_o") == 0, F.lag("_now").over(line)))
    rows = rows.withColumn("_before", F.last(F.when(F.col("_o") == 0, F.struct(F.col("frame").alias("at"), F.col("_last").alias("s"))), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.array_compact(F.array(F.when(F.col("frame") <= F.col("_now.end"), F.col("_now")), F.when((F.col("_before.at") == F.col("frame")) & (F.col("_before.s.end") == F.col("frame")), F.col("_before.s"))))
    return rows.withColumn("_held", F.when(F.col("_o") == 0, F.array("_s")).otherwise(held))


def frames_inside(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """``frames`` (key, frame, and more) with the id of the segment (key, id, start, end; closed) that holds each; a frame where one ends and the next starts comes twice."""
    rest = [c for c in frames.columns if c not in ("key", "frame")]
    return _held(segments, frames).filter("_o = 1").select("key", "frame", *rest, F.explode("_held.id").alias("id"))


def inside_sums(segments: DataFrame, frames: DataFrame, values: dict[str, Column], steps: dict[str, Column] | None = None) -> DataFrame:
    """For each segment (key, id, start, end; closed) ``frames``, how many frames lie in it, and the sums of ``values`` over them; of ``steps``, which lead from the frame before, without the first frame's.

    A segment's own values are added, in the order of frames, so that a sum is no less exact in a long series and ties are what the plain sum gives. A window deals frames to segments;
    those that overlap one before in more than its last frame meet the frames block by block instead.
    """
    steps = steps or {}
    named = {f"_{n}": c.cast("double") for n, c in {**values, **steps}.items()}
    rows = frames.select("key", F.col("frame").cast("long").alias("frame"), *[c.alias(n) for n, c in named.items()])
    line = Window.partitionBy("key").orderBy("start", "end")
    over = (F.col("start") < F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))) | (F.col("start") == F.lag("start").over(line))
    placed = segments.select("key", "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).withColumn("_over", F.coalesce(over, F.lit(False)))
    alone = _held(placed.filter("NOT _over"), rows).select("key", "frame", "_o", *named, F.explode("_held").alias("_s")).select("key", "_s.id", "_s.start", "frame", "_o", *named)
    block = lambda c: F.floor(F.col(c) / BLOCK)
    spread = placed.filter("_over").select("key", "id", "start", "end", F.explode(F.sequence(block("start"), F.greatest(block("start"), block("end")))).alias("_block"))
    met = spread.alias("s").join(rows.withColumn("_block", block("frame")).alias("f"), F.expr("s.key = f.key AND s._block = f._block AND frame BETWEEN start AND end"), "left")
    others = met.select("s.key", "id", "start", "frame", F.col("frame").isNotNull().cast("int").alias("_o"), *named)
    sums = [F.sum(F.when(F.col("_o") == 1, F.col(f"_{n}"))) for n in values] + [F.sum(F.when((F.col("_o") == 1) & (F.col("frame") > F.col("start")), F.col(f"_{n}"))) for n in steps]
    return alone.unionByName(others).groupBy("key", "id").agg(F.sum("_o").cast("double").alias("frames"), *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in zip((*values, *steps), sums, strict=True)])


def activity(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """FN8: for each segment (key, id, start, end; closed) and side: score in units of the series' medians, and whether it moved at all.

    ``frames`` has key, frame, and speed and aperture speed of both sides. A segment without any frame has no row.
    """
    names = ("speed_left", "speed_right", "aperture_left", "aperture_right")
    medians = frames.groupBy("key").agg(*[F.median(F.abs(c)).alias(f"m_{c}") for c in names])
    sums = inside_sums(segments, frames, {c: F.abs(c) for c in names}).filter("frames > 0")
    means = sums.select("key", "id", *[(F.col(c) / F.col("frames")).alias(c) for c in names]).join(medians, "key")

    def score(side: str) -> Column:
        return F.col(f"speed_{side}") / F.greatest(F.col(f"m_speed_{side}"), F.lit(0.01)) + F.col(f"aperture_{side}") / F.greatest(F.col(f"m_aperture_{side}"), F.lit(0.005))

    active = lambda side: (F.col(f"speed_{side}") > 0.04) | (F.col(f"aperture_{side}") > 0.04)
    return means.select("key", "id", score("left").alias("score_left"), score("right").alias("score_right"), active("left").alias("active_left"), active("right").alias("active_right"))


def carried_together(apart: DataFrame, *, tolerance: float = 0.15, share: float = 0.70) -> DataFrame:
    """FN9: segments (key, id) whose hands' distance ``apart`` stays within a tolerance of its mean in more than a share of the frames."""
    mean = apart.groupBy("key", "id").agg(F.avg("apart").alias("mean"))
    near = F.abs(F.col("apart") - F.col("mean")) < tolerance * F.col("mean")
    out = apart.join(mean, ["key", "id"]).groupBy("key", "id").agg(((F.first("mean") >= 1e-6) & (F.avg(near.cast("double")) > share)).alias("joint_carry"))
    return out.select("key", "id", F.coalesce("joint_carry", F.lit(False)).alias("joint_carry"))


def decide(score_left: Column, score_right: Column, active_left: Column, active_right: Column, handover: Column, joint_carry: Column, ratio: float = 3.0) -> Column:
    """FN10: the only active hand; by score if none moved; the dominant one; else both, coordinating where they hand over or carry together."""
    return (
        F.when(active_left & ~active_right, "left")
        .when(active_right & ~active_left, "right")
        .when(~active_left & ~active_right, F.when(score_left >= score_right, "left").otherwise("right"))
        .when(score_left > ratio * score_right, "left")
        .when(score_right > ratio * score_left, "right")
        .when(handover | joint_carry, "both_coordinating")
        .otherwise("both")
    )


def coordination(hand: Column, handover: Column) -> Column:
    """FN10: how both hands work together, if they do."""
    return F.when(hand == "both_coordinating", F.when(handover, "handover").otherwise("joint_carry"))


def kinematic_summary(hand: Column, together: Column, paths: dict[str, Column], events: Column, fps: float = V.FPS) -> Column:
    """FN7: what a prompt tells of a segment's motion: the active hand, and for each hand of ``paths`` how far it went and its events (frame, type, hand), with times. Fixed formats."""

    def side(name: str, path: Column) -> Column:
        own = F.filter(events, lambda e: e["hand"] == name)
        moved = F.when(path < 0.05, F.lit("mostly static")).otherwise(F.format_string("moved %.2fm", path))
        told = F.transform(own, lambda e: F.format_string("%s event at %.1fs", e["type"], e["frame"] / fps))
        return F.concat(F.lit(f"{name.capitalize()} hand: "), F.array_join(F.concat(F.array(moved), told), ", "), F.lit("."))

    how = F.coalesce(F.concat(F.lit(" ("), together, F.lit(")")), F.lit(""))
    return F.concat_ws(" ", F.concat(F.lit("Active hand (computed from motion): "), hand, how, F.lit(".")), *[side(n, p) for n, p in paths.items()])
