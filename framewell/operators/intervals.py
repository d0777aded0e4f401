"""Interval transforms: merging, absorbing, filling, stitching and clamping of labelled segments.

Segments have key, start, end, action, hand, object and confidence; other columns ride along where stated. What depends on a growing result is a fold over one key's rows.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from .folds import fold_keys

#: Columns that a label decides, and those that the first and the last of joined segments and all of them give, where a table has them.
_SAYS = ("action", "hand", "object", "confidence", "sentence", "style_id", "hand_disagreement")
_FIRST, _LAST, _ALL = ("start_source",), ("end_source", "transition_after"), ("events",)
_RANK = {c: i for i, c in enumerate(V.CONFIDENCES)}


def _of(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [c for c in names if c in df.columns]


def order(df: DataFrame | None = None) -> WindowSpec:
    """A key's segments in order; those of ``df`` with equal spans by what they say, so that they stand alike in every run."""
    return Window.partitionBy("key").orderBy("start", "end", *(_of(df, ("action", "object", "hand", "confidence", "sentence")) if df is not None else []))


def merge_adjacent(df: DataFrame, *, fps: float = V.FPS, gap_s: float = V.MERGE_GAP_S, keep_events_apart: bool = False) -> DataFrame:
    """INT3, INT4: neighbours with equal action, object and hand less than gap_s apart become one; the most confident member's labels stay, the earliest of equals.
    Its source is the first member's, what ends it the last one's, and events are those of all.

    ``keep_events_apart``: a segment that starts at a grasp or release (``start_source``) never joins the one before. Being mergeable is an equality of neighbours and a gap
    to the neighbour's end, so merged segments are islands and need no fold.
    """
    label = F.struct("action", S.strip_articles(F.col("object")).alias("object"), "hand")
    near = F.col("start") - F.lag("end").over(order(df)) < gap_s * fps
    joins = near & (label == F.lag(label).over(order(df)))
    if keep_events_apart:
        joins &= ~F.col("start_source").isin("grasp", "release")
    islands = df.withColumn("_island", F.sum(F.coalesce((~joins).cast("int"), F.lit(1))).over(order(df))).withColumn("_nth", F.row_number().over(order(df)))
    best = F.max_by(F.struct(*_of(df, _SAYS)), F.struct(S.rank_of(F.col("confidence")), -F.col("_nth"))).alias("best")
    edges = [F.min_by(c, "_nth").alias(c) for c in _of(df, _FIRST)] + [F.max_by(c, "_nth").alias(c) for c in ("end", *_of(df, _LAST))]
    lists = [F.flatten(F.array_sort(F.collect_list(F.struct("_nth", c)))[c]).alias(c) for c in _of(df, _ALL)]
    merged = islands.groupBy("key", "_island").agg(F.min("start").alias("start"), best, *edges, *lists, F.first("n_frames").alias("n_frames"), F.count(F.lit(1)).alias("members"))
    return merged.select("key", "start", "end", "best.*", *_of(df, _FIRST + _LAST + _ALL), "n_frames", "members")


def joined(left: dict, right: dict, says: dict) -> dict:
    """Two neighbours as one: the labels of ``says``, the outer bounds, sources and events of both."""
    outer = {c: left[c] for c in ("start", *_FIRST) if c in left} | {c: right[c] for c in ("end", *_LAST) if c in right}
    return says | outer | {c: [*left[c], *right[c]] for c in _ALL if c in left}


def absorb(rows: list[dict], least: int) -> list[dict]:
    """INT5 for one key's rows: the first shortest of those under ``least`` joins its more confident neighbour, the longer and then the left of equals; of the two the more
    confident one's labels stay, the longer and then the left of equals. Ends when none is short or one is left. A heap holds the lengths, and rows know their neighbours."""
    rows: list[dict | None] = list(rows)
    weight = lambda i: (_RANK[rows[i]["confidence"]], rows[i]["end"] - rows[i]["start"])
    n = len(rows)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r["end"] - r["start"], i) for i, r in enumerate(rows)]
    heapq.heapify(heap)
    while n > 1 and heap and heap[0][0] < least:
        length, i = heapq.heappop(heap)
        if rows[i] is None or rows[i]["end"] - rows[i]["start"] != length:
            continue  # joined since it was put there
        left, right = before[i], after[i]
        a = left if right == len(rows) or (left >= 0 and weight(left) >= weight(right)) else i
        b = after[a]
        rows[a] = joined(rows[a], rows[b], rows[a] if weight(a) >= weight(b) else rows[b])
        rows[b], after[a] = None, after[b]
        if after[b] < len(rows):
            before[after[b]] = a
        heapq.heappush(heap, (rows[a]["end"] - rows[a]["start"], a))
        n -= 1
    return [r for r in rows if r is not None]


def enforce_min_length(df: DataFrame, *, least: int = 10, errors: bool = False) -> DataFrame:
    """INT5: short segments are absorbed by neighbours; keys are independent. The columns stay as they are; ``errors`` as in fold_keys."""
    columns = [c for c in df.columns if c != "key"]
    return _folded(df, columns, lambda rows: absorb(rows, least), errors=errors)


def _folded(df: DataFrame, columns: list[str], fold: Callable[[list[dict]], list[dict]], order: tuple[str, ...] | list[str] = ("start", "end"), errors: bool = False) -> DataFrame:
    """fold_keys for folds over dicts that keep the columns."""
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    return fold_keys(df, columns, list(order), lambda rows: [tuple(r[c] for c in columns) for r in fold([dict(zip(columns, r, strict=True)) for r in rows])], schema, errors=errors)


def insert_idle(df: DataFrame, *, fps: float = V.FPS, idle_gap_s: float = V.IDLE_GAP_S, name: Column | None = None, idle_source: str = "idle_gap") -> DataFrame:
    """INT6, INT7: gaps over idle_gap_s become idle segments; shorter ones go to the segment before, or after at the start; the same holds up to the last frame.

    Gaps are known from the neighbours, so every segment is stretched and gives at most one idle row before it, and the last one a row after it. ``name``: the key as text.
    Labelled rows keep their sentences, sources and events; idle ones get an idle sentence, ``idle_source`` on both sides and no events.
    """
    limit = idle_gap_s * fps
    name = F.col("key").cast("string") if name is None else name
    before, after = F.lag("end").over(order(df)), F.lead("start").over(order(df))
    end_frame = F.col("n_frames") - 1
    rows = df.withColumns({"_prev": F.coalesce(before, F.lit(0)), "_first": before.isNull(), "_next": F.coalesce(after, end_frame), "_last": after.isNull()})
    lead_gap, tail_gap = F.col("start") - F.col("_prev"), F.col("_next") - F.col("end")
    start = F.when(F.col("_first") & (lead_gap > 0) & (lead_gap <= limit), F.col("_prev")).otherwise(F.col("start"))
    end = F.when((tail_gap > 0) & (tail_gap <= limit), F.col("_next")).otherwise(F.col("end"))
    idle_values = {"action": "idle", "hand": "both", "object": "none", "confidence": "high", "style_id": -1, "hand_disagreement": False, **dict.fromkeys(("start_source", "end_source"), idle_source)}
    rides = _of(df, _SAYS + _FIRST + _LAST + _ALL)
    kinds = {f.name: f.dataType for f in df.schema}
    blank = [(F.array() if c in _ALL else F.lit(idle_values.get(c))).cast(kinds[c]).alias(c) for c in rides]
    own = F.struct(start.alias("start"), end.alias("end"), *rides, F.lit("label").alias("source"))
    idle = lambda a, b: F.struct(a.alias("start"), b.alias("end"), *blank, F.lit("idle_gap").alias("source"))
    pieces = F.array_compact(F.array(F.when(lead_gap > limit, idle(F.col("_prev"), F.col("start"))), own, F.when(F.col("_last") & (tail_gap > limit), idle(F.col("end"), end_frame))))
    out = rows.select("key", "n_frames", F.explode(pieces).alias("s")).select("key", "n_frames", "s.*")
    number = (F.row_number().over(order(df)) - 1).cast("long")
    said = F.col("sentence") if "sentence" in df.columns else F.lit(None).cast("string")
    return out.withColumn("id", number).withColumn("sentence", F.when(F.col("source") == "idle_gap", S.idle_sentence(name, F.col("id"))).otherwise(said))


def clamp_overlaps(df: DataFrame) -> DataFrame:
    """INT12: each segment starts no earlier than the end of all before it; contained and empty ones go."""
    sane = df.filter("end > start")
    reach = F.max("end").over(order(df).rowsBetween(Window.unboundedPreceding, -1))
    return sane.withColumn("start", F.greatest("start", F.coalesce(reach, F.col("start")))).filter("end > start")


def _label(row: dict) -> tuple[str, str]:
    """What tells candidates apart: the action and the object, not the hand."""
    name = row["object"].lower().strip()
    return row["action"], next((name[len(a) :] for a in ("the ", "a ", "an ") if name.startswith(a)), name)


def _surer(row: dict, other: dict) -> dict:
    """What ``other`` says if it is strictly more confident than ``row``, else what that says."""
    return {c: (other if _RANK[other["confidence"]] > _RANK[row["confidence"]] else row)[c] for c in _SAYS if c in row}


def common_share(a: dict, b: dict) -> float:
    """The overlap of two spans by the length that both cover together."""
    low, high = min(a["start"], b["start"]), max(a["end"], b["end"])
    return max(min(a["end"], b["end"]) - max(a["start"], b["start"]), 0) / (high - low) if high > low else -1.0


def place_in(alike: list[dict], row: dict, share: float) -> dict | None:
    """INT9 for one candidate among the clusters of its label, oldest first: the first one that it overlaps by ``share`` takes it, and grows; None if it founds one, which is added.

    Candidates come by start, so a cluster of which less than ``share`` lies beyond this start can take no later one, whatever its end, and leaves the list.
    """
    at = row["start"]
    alike[:] = [c for c in alike if c["end"] - at >= share * (c["end"] - c["start"])]
    for home in alike:
        if common_share(home, row) >= share:
            home.update(_surer(home, row), start=min(home["start"], at), end=max(home["end"], row["end"]))
            return home
    alike.append(row)
    return None


def clusters(rows: list[dict], share: float) -> list[dict]:
    """INT9: each candidate, in order, goes to the oldest cluster of its label that it overlaps by ``share`` of the common span, or founds one. Clusters are kept by label, for
    others cannot match, as long as they can take more; one that takes a candidate covers both, so the order counts."""
    alive: dict[tuple[str, str], list[dict]] = defaultdict(list)
    founded = [own for row in rows if place_in(alive[_label(row)], own := dict(row), share) is None]
    return sorted(founded, key=lambda r: (r["start"], r["end"]))


def met(last: dict, row: dict) -> tuple[dict | None, dict]:
    """INT10 for the open row and the next one: what is finished of the open one, and which is open now.

    A row that begins inside the open one extends it (same label), lies within it and goes, or meets it half way.
    """
    if row["start"] >= last["end"]:
        return last, row
    if _label(row) == _label(last):
        return None, last | _surer(last, row) | {"end": max(last["end"], row["end"])}
    if row["end"] <= last["end"]:
        return None, last
    half = (row["start"] + last["end"]) // 2
    cut = min(max(half, last["start"] + 1), row["end"] - 1)
    return last | {"end": cut}, row | {"start": cut}


def resolved(rows: list[dict]) -> Iterator[dict]:
    """INT10: sorted rows without overlaps. Only the last one is open."""
    last: dict | None = None
    for row in rows:
        done, last = (None, row) if last is None else met(last, row)
        if done is not None:
            yield done
    if last is not None:
        yield last


def stitch_order(columns: list[str]) -> list[str]:
    """The order of candidates: by span, then by what they say, then by all other columns."""
    first = ["start", "end", "action", "object", "hand", "confidence"]
    return first + sorted(set(columns) - set(first))


def stitch(df: DataFrame, *, share: float = V.IOU) -> DataFrame:
    """INT9, INT10: overlapping candidates of windows become non-overlapping segments, key by key. Empty candidates play no part; equal spans are taken by label, hand, confidence and
    then all else that they have, so that the order of rows in the table doesn't matter."""
    columns = [c for c in df.columns if c != "key"]
    return _folded(df.filter("end > start"), columns, lambda rows: list(resolved(clusters(rows, share))), order=stitch_order(columns))


def same_label_overlaps(df: DataFrame, *, share: float = V.IOU) -> DataFrame:
    """JN8: pairs of candidates of one key with the same action and object whose overlap is ``share`` (above 0) of the common span or more: key, id, other, iou. ``df`` has a unique id.

    A pair's lengths differ by a factor of 1 / share at most, and both hold a common frame. So a candidate stands, at the level of its length's binary logarithm, in the one or two
    cells of that width which it touches, and looks up the cells that it touches at its own level and the few below: an equi-join, in which a long candidate meets no short ones.
    """
    if share <= 0:
        raise ValueError("share must be above 0")
    label, reach = S.strip_article(F.col("object")), math.ceil(math.log2(1 / share)) + 1
    rows = df.filter("end > start").select("key", "action", label.alias("_object"), "id", "start", "end", (F.length(F.bin(F.col("end") - F.col("start"))) - 1).alias("_level"))
    cell = lambda at, level: F.call_function("shiftright", at, level)
    names = ["key", "action", "_object", "_level", "_cell"]
    standing = rows.select("*", F.explode(F.sequence(cell(F.col("start"), F.col("_level")), cell(F.col("end") - 1, F.col("_level")))).alias("_cell"))
    lower = rows.withColumn("_own", F.col("_level")).withColumn("_level", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_level") - reach), F.col("_level"))))
    asking = lower.select("*", F.explode(F.sequence(cell(F.col("start"), F.col("_level")), cell(F.col("end") - 1, F.col("_level")))).alias("_cell"))
    asking = asking.select(*names, "_own", F.col("id").alias("other"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    begins = F.greatest("start", "b_start")
    once = (cell(begins, F.col("_level")) == F.col("_cell")) & ((F.col("_own") > F.col("_level")) | (F.col("id") < F.col("other")))
    pairs = standing.join(asking, names).filter(once & (F.col("id") != F.col("other")))
    pairs = pairs.withColumn("iou", S.iou(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))).filter(F.col("iou") >= share)
    return pairs.select("key", F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"), "iou")


def fallback(keys: DataFrame, segments: DataFrame) -> DataFrame:
    """INT13: keys (key, n_frames) without any segment get one over the whole series, action other and confidence low."""
    missing = keys.join(segments.select("key").distinct(), "key", "left_anti")
    whole = missing.select("key", F.lit(0).cast("long").alias("start"), (F.col("n_frames") - 1).cast("long").alias("end"), F.lit("other").alias("action"), F.lit("both").alias("hand"), F.lit("none").alias("object"), F.lit("low").alias("confidence"))
    return segments.select(*whole.columns).unionByName(whole)


def upper_median(df: DataFrame, value: Column, by: list[str] | None = None, *, width: int = 4096) -> DataFrame:
    """AGG18: for each key, or group of ``by``, the upper median of whole numbers: the element at n div 2 of the sorted values. Nulls are no values.

    Selection in two steps instead of a sort: how often each value occurs is counted in every task before it is dealt; counts by ranges of ``width`` values tell which range holds the
    middle, and the counts of that range tell which value does. A group of any size is spread, and what meets in one row are its ranges, or ``width`` values.
    """
    by = by or ["key"]

    def nth(entries: Column, at: Column) -> Column:
        """The entry (v, k), by v, that holds the element ``at`` when each stands for k, and which of its own that is."""
        start = F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("struct<v:bigint,rest:bigint>").alias("hit"))
        within = lambda s, e: F.when(s["below"] + e["k"] > at, F.struct(e["v"].alias("v"), (at - s["below"]).alias("rest")))
        return F.aggregate(F.array_sort(entries), start, lambda s, e: F.struct((s["below"] + e["k"]).alias("below"), F.coalesce(s["hit"], within(s, e)).alias("hit")))["hit"]

    listed = F.collect_list(F.struct(F.col("_v").alias("v"), F.col("_k").alias("k")))
    counts = df.select(*by, value.cast("long").alias("_v")).filter("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_k"))
    ranges = counts.groupBy(*by, F.floor(F.col("_v") / width).alias("_r")).agg(F.sum("_k").alias("_k")).withColumnRenamed("_r", "_v")
    middle = ranges.groupBy(*by).agg(listed.alias("_l"), F.sum("_k").alias("_n")).select(*by, nth(F.col("_l"), F.floor(F.col("_n") / 2)).alias("_m"))
    inside = counts.join(middle, by).filter(F.floor(F.col("_v") / width) == F.col("_m.v"))
    return inside.groupBy(*by).agg(listed.alias("_l"), F.first("_m.rest").alias("_rest")).select(*by, nth(F.col("_l"), F.col("_rest"))["v"].alias("upper_median"))


def flagged(df: DataFrame, *, short_share: float = V.SHORT_SHARE) -> DataFrame:
    """FN12, FN13: flags short_segment (under a share of the key's upper median length) and low_confidence."""
    length = F.col("end") - F.col("start")
    out = df.join(upper_median(df, length), "key")
    short = (F.col("upper_median") > 0) & (length < short_share * F.col("upper_median"))
    return out.withColumn("flags", S.flags([("short_segment", short), ("low_confidence", F.col("confidence") == "low")])).drop("upper_median")


def cross_flagged(df: DataFrame, events: DataFrame, *, tolerance: int = V.EVENT_NEAR_FRAMES) -> DataFrame:
    """FN11: flags kinematic_mismatch (a verb that needs a grasp or release, and none from ``tolerance`` frames before the start to as many behind the end), low_confidence and hand_disagreement.

    ``events`` has key, frame and type, and ``df`` a boolean hand_disagreement. The first event from there on decides, found by one window over both, so that no pairs are made.
    """
    points = events.select("key", F.col("frame").alias("_at"), F.col("type").alias("_type"))
    rows = df.withColumns({"_at": F.col("start") - tolerance, "_own": F.lit(True)}).unionByName(points, allowMissingColumns=True)
    ahead = Window.partitionBy("key").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    following = lambda kind: F.min(F.when(F.col("_type") == kind, F.col("_at"))).over(ahead)
    rows = rows.withColumns({"_grasp": following("grasp"), "_release": following("release")}).filter("_own")
    far = lambda at: F.coalesce(F.col(at) > F.col("end") + tolerance, F.lit(True))
    mismatch = (F.col("action").isin(V.NEEDS_GRASP) & far("_grasp")) | (F.col("action").isin(V.NEEDS_RELEASE) & far("_release"))
    named = [("kinematic_mismatch", mismatch), ("low_confidence", F.col("confidence") == "low"), ("hand_disagreement", F.col("hand_disagreement"))]
    return rows.withColumn("flags", S.flags(named)).select(*[c for c in df.columns if c != "flags"], "flags")
