"""Level drivers: from series to boundaries and segments, and from labelled segments to finished annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..operators import events as E
from ..operators import intervals as I
from ..operators import signals as G
from ..operators.prominence import with_prominence


def propose_segments(series: DataFrame, events: DataFrame | None = None, *, fps: float = V.FPS, least: int = V.MIN_SEGMENT, window: int = V.MERGE_WINDOW, pause_speed: float = V.PAUSE_SPEED_MAX, prominence: float = V.PAUSE_PROMINENCE, gaze_floor: float = V.GAZE_FLOOR, move: float = V.MOVE_SPEED, errors: bool = False, longest: int | None = None) -> DataFrame:
    """EVT15: segments of series (key, frame, speed, turn, masked_left, masked_right) with start_source and end_source.

    EVT4: pauses in ``speed`` are candidates unless the wrists of both hands are masked there. Grasps and releases (``events``: key, frame, type, magnitude) are, and shifts in
    ``turn``, which no mask concerns. EVT6, EVT7: in this order, each with its source's priority, they are fused into boundaries. ``errors`` as in fold_keys,
    ``longest`` as in with_prominence.

    Peaks of both signals, the masks, and the running count of moving frames come from one pass over the series; events meet that count by a join.
    """
    facts = series.select("key", F.col("frame").cast("long").alias("frame"), F.col("speed").cast("double").alias("speed"), (-F.col("speed").cast("double")).alias("_low"), F.col("turn").cast("double").alias("turn"), (~(F.col("masked_left") & F.col("masked_right"))).alias("seen"))
    facts = facts.withColumns({"limit": E.gaze_limit("turn", floor=gaze_floor), "moved": E.moved_before("speed", move), "last": F.max("frame").over(G.whole())})
    marked = E.mark_peaks(facts, ["_low", "turn"])
    pause = F.col("_low_peak") & (F.col("speed") < pause_speed) & F.col("seen")
    # Frames that are no candidates go no further than their blocks.
    kept = marked.withColumns({"_gaze": F.col("turn_peak") & (F.col("turn") >= F.col("limit")), "_pause": F.coalesce(pause, F.lit(False)), "_end": F.col("frame") == F.col("last")})
    wanted = with_prominence(kept.withColumn("_top", F.col("_pause") | F.col("_gaze") | F.col("_end")), "_low", "_top", ["_pause", "_gaze", "_end", "speed", "turn", "moved"], longest=longest)
    candidate = lambda when, order, prio, magnitude, source: F.when(when, F.struct(F.lit(order).alias("ord"), prio.cast("int").alias("prio"), magnitude.alias("magnitude"), source.cast("string").alias("source")))
    named = lambda source: E.priority(F.lit(source))
    of_frame = F.array_compact(
        F.array(
            candidate(F.col("_pause") & (F.col("prominence") >= prominence), 0, named("pause"), F.col("speed") * -1, F.lit("pause")),
            candidate(F.col("_gaze"), 2, named("gaze"), F.col("turn"), F.lit("gaze")),
            candidate(F.col("_end"), -1, F.lit(-1), F.lit(0.0), F.lit(None)),
        )
    )
    rows = wanted.select("key", "frame", "moved", F.explode(of_frame).alias("c")).select("key", "frame", "moved", "c.*")
    if events is not None:
        own = events.select("key", F.col("frame").cast("long").alias("frame"), F.lit(1).alias("ord"), E.priority(F.col("type")).cast("int").alias("prio"), F.col("magnitude").cast("double").alias("magnitude"), F.col("type").alias("source"))
        rows = rows.unionByName(own.join(facts.select("key", "frame", "moved"), ["key", "frame"]))
    segments = E.segments_between(E.fuse_counted(rows, window=window, least=least, errors=errors), fps=fps)
    return segments if events is None else E.events_inside(segments, events)


def assemble(labels: DataFrame, events: DataFrame | None = None, *, fps: float = V.FPS, least: int = 10, absorb: bool = True, keep_events_apart: bool = False, merge_gap_s: float = V.MERGE_GAP_S, idle_gap_s: float = V.IDLE_GAP_S, idle_source: str = "idle_gap") -> DataFrame:
    """INT14: merge, absorb, fill and flag: the finished rows of each key, with ids, times, sentences, sources and flags.

    With ``events`` (key, frame, type) flags are FN11's, for labels with hand_disagreement; without, they are FN12's.
    """
    merged = I.merge_adjacent(labels, fps=fps, gap_s=merge_gap_s, keep_events_apart=keep_events_apart)
    if absorb:
        merged = I.enforce_min_length(merged, least=least)
    return finish(merged, events, fps=fps, idle_gap_s=idle_gap_s, idle_source=idle_source)


def finish(merged: DataFrame, events: DataFrame | None = None, *, fps: float = V.FPS, idle_gap_s: float = V.IDLE_GAP_S, idle_source: str = "idle_gap") -> DataFrame:
    """INT14 from merged and absorbed rows on: gaps filled, rows flagged, times added."""
    filled = I.insert_idle(merged, fps=fps, idle_gap_s=idle_gap_s, idle_source=idle_source)
    out = I.flagged(filled) if events is None else I.cross_flagged(filled, events)
    return out.withColumns({"start_time": F.col("start") / fps, "end_time": F.col("end") / fps, "duration": (F.col("end") - F.col("start")) / fps})


def annotations(rows: DataFrame) -> DataFrame:
    """FN13: one nested row for each key, with the ids that need review."""
    sources = [c for c in ("start_source", "end_source", "style_id") if c in rows.columns]
    item = F.struct("id", "action", "hand", "object", "sentence", "start", "end", "start_time", "end_time", "duration", *sources, "confidence", "flags")
    review = F.array_compact(F.collect_list(F.when(F.size("flags") > 0, F.col("id"))))
    return rows.groupBy("key").agg(F.first("n_frames").alias("n_frames"), F.array_sort(F.collect_list(item)).alias("subtasks"), F.array_sort(review).alias("review_queue"))


def boundary_record(segments: DataFrame, *, fps: float = V.FPS) -> DataFrame:
    """SNK1: one row for each key from its segments (key, id, start, end, sources, n_frames): its boundaries with times and sources, the last frame among them, and its segments."""
    item = F.struct("id", "start", "end", S.seconds(F.col("start"), fps).alias("start_time"), S.seconds(F.col("end"), fps).alias("end_time"), "start_source", "end_source")
    at = lambda frame, source: F.struct(frame.alias("frame"), S.seconds(frame, fps).alias("time"), source.alias("source"))
    grouped = segments.groupBy("key").agg(F.max("n_frames").alias("n_frames"), F.array_sort(F.collect_list(item)).alias("segments"))
    starts = F.transform("segments", lambda s: at(s["start"], s["start_source"]))
    last = F.element_at("segments", -1)
    return grouped.select("key", "n_frames", F.lit(fps).alias("fps"), F.concat(starts, F.array(at(last["end"], last["end_source"]))).alias("boundaries"), "segments")


def label_record(labels: DataFrame, *, fps: float = V.FPS) -> DataFrame:
    """SNK2: one row for each key from its labelled segments: each segment's span and sources, its label, and how many attempts that took."""
    label = F.struct("action", "hand", "object", "sentence", "confidence").alias("label")
    item = F.struct("id", "start", "end", "start_source", "end_source", label, "attempts", "fell_back")
    return labels.groupBy("key").agg(F.max("n_frames").alias("n_frames"), F.array_sort(F.collect_list(item)).alias("segments")).select("key", "n_frames", F.lit(fps).alias("fps"), "segments")


def boundary_mirror(subtasks: DataFrame, *, fps: float = V.FPS) -> DataFrame:
    """SNK3: boundaries from labelled rows (key, id, start, n_frames): frame 0, the starts of all but the first row, and the last frame: key, frame, time, to four places."""
    inner = subtasks.filter("id > 0").select("key", F.col("start").alias("frame"))
    ends = subtasks.groupBy("key").agg(F.max("n_frames").alias("n")).select("key", F.explode(F.array(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))
    return inner.unionByName(ends).withColumn("time", F.bround(F.col("frame") / fps, 4))


def signals(series: DataFrame, position: list[str], rotation: str, *, fps: float = V.FPS) -> DataFrame:
    """SIG3 to SIG8 and SIG12 for one tracked point and one rotation: gaps filled, then smoothed speed and turning, and the time axis."""
    filled = series
    for p in position:
        filled = G.fill_gaps(filled, p, "valid", into=f"{p}_f", mask="masked")
    fast = G.smooth(G.speed(filled, [f"{p}_f" for p in position], fps=fps, into="_v"), "_v", into="speed")
    turned = G.smooth(G.angular_speed(fast, rotation, fps=fps, into="_w"), "_w", into="turn")
    return turned.withColumn("t", F.col("frame") / fps).drop("_v", "_w")
