"""Events and boundaries of series: peaks, detectors, fusion of candidates, and segments between boundaries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from .folds import fold_keys
from .prominence import with_prominence
from .signals import line, whole


def mark_peaks(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """EVT1: ``df`` with ``<value>_peak`` for each of ``values``: whether the frame is a strict local maximum, of a plateau its middle, rounded down. The first and last runs are never peaks.

    Two passes over each key's frames, one in each direction, serve all values: no grouping, no join, and no exchange if ``df`` is dealt by key.
    """
    back = Window.partitionBy("key").orderBy(F.desc("frame"))
    neighbours = {f"_{side}_{v}": f(v).over(line()) for v in values for side, f in (("p", F.lag), ("n", F.lead))}
    out = df.withColumns(neighbours)

    def edge(v: str, side: str) -> Column:
        beside = F.col(f"_{side}_{v}")
        return F.last(F.when(F.coalesce(F.col(v) != beside, F.lit(True)), F.struct(F.col("frame").alias("at"), beside.alias("x"))), ignorenulls=True)

    so_far = (Window.unboundedPreceding, 0)
    out = out.withColumns({f"_a_{v}": edge(v, "p").over(line().rowsBetween(*so_far)) for v in values})
    out = out.withColumns({f"_b_{v}": edge(v, "n").over(back.rowsBetween(*so_far)) for v in values})
    peak = lambda v: (F.col(v) > F.col(f"_a_{v}.x")) & (F.col(v) > F.col(f"_b_{v}.x")) & (F.col("frame") == S.midpoint(F.col(f"_a_{v}.at"), F.col(f"_b_{v}.at")))
    return out.withColumns({f"{v}_peak": F.coalesce(peak(v), F.lit(False)) for v in values}).drop(*neighbours, *[f"_{e}_{v}" for e in "ab" for v in values])


def peaks(df: DataFrame, value: str, height: float | Column | None = None) -> DataFrame:
    """EVT1: strict local maxima of ``value``: key, frame, height, which is at least ``height`` where that is given."""
    found = mark_peaks(df, [value]).filter(F.col(f"{value}_peak"))
    if height is not None:
        found = found.filter(F.col(value) >= height)
    return found.select("key", "frame", F.col(value).alias("height"))


def prominent_minima(df: DataFrame, value: str, *, prominence: float, longest: int | None = None) -> DataFrame:
    """EVT2, EVT4: minima at least as prominent: key, frame, depth (the value), prominence. ``longest`` is the greatest frame, if known."""
    marked = mark_peaks(df.select("key", "frame", F.col(value).alias("depth"), (-F.col(value)).alias("_low")), ["_low"])
    return with_prominence(marked, "_low", "_low_peak", ["depth"], longest=longest).filter(F.col("prominence") >= prominence)


def grasp_release(df: DataFrame, *, aperture_speed: str, wrist_speed: str, masked: str, hand: str, threshold: float = V.APERTURE_SPEED, release_speed_max: float | None = None) -> DataFrame:
    """EVT3: closing peaks are grasps and opening ones releases, unless the pinch is masked; a release by a fast wrist is dropped where a limit is set."""
    facts = df.select("key", "frame", F.col(masked).alias("_masked"), F.col(wrist_speed).alias("_wrist"), F.col(aperture_speed).alias("_open"), (-F.col(aperture_speed)).alias("_close"))
    marked = mark_peaks(facts, ["_open", "_close"]).filter(~F.col("_masked"))
    slow = F.col("_wrist") <= release_speed_max if release_speed_max else F.lit(True)
    event = lambda kind, c, more: F.when(F.col(f"{c}_peak") & (F.col(c) >= threshold) & more, F.struct(F.lit(kind).alias("type"), F.col(c).alias("magnitude")))
    found = marked.select("key", "frame", F.explode(F.array_compact(F.array(event("grasp", "_close", F.lit(True)), event("release", "_open", slow)))).alias("e"))
    return found.select("key", "frame", F.lit(hand).alias("hand"), "e.type", "e.magnitude")


def gaze_limit(value: str, *, percentile: float = V.GAZE_PERCENTILE / 100, floor: float = V.GAZE_FLOOR) -> Column:
    """EVT5: how high a peak of ``value`` must be: the series' own percentile, or the floor."""
    return F.greatest(F.percentile(value, percentile).over(whole()), F.lit(floor))


def gaze_shifts(df: DataFrame, value: str, *, percentile: float = V.GAZE_PERCENTILE / 100, floor: float = V.GAZE_FLOOR) -> DataFrame:
    """EVT5: peaks at or above the series' own percentile and the floor."""
    limited = df.select("key", "frame", value).withColumn("_limit", gaze_limit(value, percentile=percentile, floor=floor))
    return peaks(limited, value, F.col("_limit")).withColumnRenamed("height", "magnitude")


def union_candidates(*parts: DataFrame) -> DataFrame:
    """EVT6: detections of all detectors, with their place among the detectors as ``ord`` for stable order."""
    tagged = [p.withColumn("ord", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def priority(source: Column) -> Column:
    """EVT7."""
    return F.coalesce(F.try_element_at(F.create_map(*[v for k, p in V.PRIORITY.items() for v in (F.lit(k), F.lit(p))]), source), F.lit(0))


def merge_near(rows: Iterable[tuple], window: int) -> Iterator[tuple]:
    """EVT8 for one key's candidates (frame, prio, magnitude, and more) in order: one within ``window`` frames of the one that is held competes with it; the better is held on,
    the earlier of equals. Only one is ever held."""
    held: tuple | None = None
    for row in rows:
        if held is None or row[0] - held[0] > window:
            if held is not None:
                yield held
            held = row
        elif row[1:3] > held[1:3]:
            held = row
    if held is not None:
        yield held


def merge_candidates(df: DataFrame, *, window: int = V.MERGE_WINDOW) -> DataFrame:
    """EVT8: candidates (key, frame, ord, prio, magnitude) without those that a better one within ``window`` frames of the last kept one displaces.

    The kept frame moves when a better candidate wins, so this is a fold, over each key's sorted candidates.
    """
    typed = df.select("key", F.col("frame").cast("long"), F.col("prio").cast("int"), F.col("magnitude").cast("double"), F.col("ord").cast("int"))
    out = fold_keys(typed, ["frame", "prio", "magnitude", "ord"], ["frame", "ord", "prio", "magnitude"], lambda rows: list(merge_near(rows, window)), "frame long, prio int, magnitude double, ord int")
    return out.select("key", "frame", "ord", "prio", "magnitude")


def thin_boundaries(frames: Sequence[int], rank: Sequence[tuple], least: int) -> list[int]:
    """EVT10: places that stay: the leftmost pair of neighbours closer than ``least`` loses its weaker member, the earlier of equals, until no pair is that close.

    One pass with a stack: everything before the pair is already far enough apart, so only the new neighbours need another look.
    """
    kept: list[int] = []
    for i in range(len(frames)):
        kept.append(i)
        while len(kept) > 1 and frames[kept[-1]] - frames[kept[-2]] < least:
            # A removal among earlier ones may only widen gaps to the right.
            del kept[-2 if rank[kept[-2]] <= rank[kept[-1]] else -1]
    return kept


def drop_static(frames: Sequence[int], moved: Sequence[int], last: tuple[int, int]) -> list[int]:
    """EVT11: places that stay: a boundary goes if no frame moves in the stretch on either side of it.

    ``moved`` holds how many frames move before each boundary, and ``last`` the last frame and how many move before that; stretches of fewer than two frames count as moving.
    A boundary that goes joins two static stretches to a static one, so that its neighbours stand as before, and one look at each is enough.
    """
    edges = [(0, 0), *zip(frames, moved, strict=True), last]
    lively = [b[0] - a[0] < 2 or b[1] > a[1] for a, b in zip(edges, edges[1:], strict=False)]
    return [i for i in range(len(frames)) if lively[i] or lively[i + 1]]


def moved_before(speed: str, move: float = V.MOVE_SPEED) -> Column:
    """How many frames of the key move before each one, which tells for any two frames whether one between them moves."""
    before = line().rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum((F.col(speed) >= move).cast("long")).over(before), F.lit(0))


def fuse_counted(rows: DataFrame, *, window: int = V.MERGE_WINDOW, least: int = V.MIN_SEGMENT, errors: bool = False) -> DataFrame:
    """EVT8 to EVT13: as ``fuse``, for candidates that come with ``moved`` and a row with ord -1 for each key's last frame."""

    def fused(rows: list[tuple]) -> list[tuple]:
        end = next(r for r in rows if r[1] < 0)
        inside = [r for r in merge_near((r for r in rows if r[1] >= 0), window) if least <= r[0] <= end[0] - least]
        inside = [inside[i] for i in thin_boundaries([r[0] for r in inside], [r[1:3] for r in inside], least)]
        inside = [inside[i] for i in drop_static([r[0] for r in inside], [r[4] for r in inside], (end[0], end[4]))]
        return [(0, 0, 0.0, "episode_start"), *(r[:4] for r in inside), (end[0], 0, 0.0, "episode_end")]

    columns = ["frame", "prio", "magnitude", "source", "moved"]
    return fold_keys(rows.select("key", *columns, "ord"), [*columns, "ord"], ["frame", "ord", "prio", "magnitude"], fused, "frame long, prio int, magnitude double, source string", errors=errors)


def fuse(candidates: DataFrame, series: DataFrame, *, window: int = V.MERGE_WINDOW, least: int = V.MIN_SEGMENT, move: float = V.MOVE_SPEED, speed: str = "speed", errors: bool = False) -> DataFrame:
    """EVT8 to EVT13: fused boundaries of each key: key, frame, prio, magnitude, source; the series' first and last frames are added with prio 0.

    ``candidates`` has key, frame, ord, prio, magnitude, and source if it is known; ``series`` key, frame (from 0) and ``speed``. A running count of moving frames answers every
    stretch, so that one fold sees a key's candidates only, never its frames. ``errors`` as in fold_keys.
    """
    counted = series.select("key", "frame", moved_before(speed, move).alias("moved"))
    totals = counted.groupBy("key").agg(F.max("frame").alias("last"), F.max("moved").alias("last_moved"))
    source = F.col("source") if "source" in candidates.columns else F.lit(None).cast("string")
    typed = candidates.select("key", F.col("frame").cast("long"), F.col("ord").cast("int"), F.col("prio").cast("int"), F.col("magnitude").cast("double"), source.alias("source"))
    ends = totals.select("key", F.col("last").alias("frame"), F.lit(-1).alias("ord"), F.lit(-1).alias("prio"), F.lit(0.0).alias("magnitude"), F.lit(None).cast("string").alias("source"), F.col("last_moved").alias("moved"))
    return fuse_counted(typed.join(counted, ["key", "frame"]).unionByName(ends), window=window, least=least, errors=errors)


def segments_between(boundaries: DataFrame, *, fps: float = V.FPS, order: Sequence[str] = ("frame",)) -> DataFrame:
    """EVT14 without events: a segment from every boundary to the next: key, id, start, end, start_time, end_time, duration; empty ones are skipped (EVT16).

    Where boundaries have a source, segments have start_source and end_source; what else a boundary has goes to the segment on its right. Rows with an error stay as they are.
    ``order`` says how boundaries on one frame follow each other, of which the last one counts.
    """
    in_line = Window.partitionBy("key").orderBy(*order)
    pairs = boundaries.withColumn("end", F.lead("frame").over(in_line))
    if "source" in boundaries.columns:
        pairs = pairs.withColumn("end_source", F.lead("source").over(in_line)).withColumnRenamed("source", "start_source")
    pairs = pairs.filter("end > frame OR error IS NOT NULL" if "error" in boundaries.columns else "end > frame").withColumnRenamed("frame", "start")
    number = (F.row_number().over(Window.partitionBy("key").orderBy("start")) - 1).cast("long")
    return pairs.withColumns({"id": number, "start_time": S.seconds(F.col("start"), fps), "end_time": S.seconds(F.col("end"), fps), "duration": F.bround((F.col("end") - F.col("start")) / fps, 4)})


def events_inside(segments: DataFrame, events: DataFrame) -> DataFrame:
    """EVT14, JN4: segments with an array of the events (frame, type, magnitude, and the hand where it is known) in [start, end). Segments touch, so an event's is the last one that starts at or before it: a window, not a range join."""
    starts = segments.select("key", F.col("start").alias("frame"), F.struct(*[c for c in segments.columns if c != "key"]).alias("segment"), F.lit(0).alias("_o"))
    marked = events.select("key", "frame", F.struct("frame", "type", "magnitude", *[c for c in ("hand",) if c in events.columns]).alias("event"), F.lit(1).alias("_o"))
    so_far = Window.partitionBy("key").orderBy("frame", "_o").rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.unionByName(marked, allowMissingColumns=True).withColumn("segment", F.last("segment", ignorenulls=True).over(so_far)).filter("_o = 0 OR event.frame < segment.end")
    # Segments ride along with their own rows, so that they are computed once and those without events stay.
    whole_rows = placed.groupBy("key", F.col("segment.start").alias("_start")).agg(F.first("segment").alias("segment"), F.array_sort(F.collect_list("event")).alias("events_inside"))
    return whole_rows.select("key", *[f"segment.{c}" for c in segments.columns if c != "key"], "events_inside")
