"""Windows over frame indexes, story context, and the open tail that chunks hand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def sliding(df: DataFrame, n_frames: str = "n_frames", *, frames: int = V.WINDOW_FRAMES, skip: int = 1, overlap: float = 0.33) -> DataFrame:
    """WIN1: windows of frames * (skip + 1) frames that advance by what does not overlap: w, w_start, w_end (inclusive); the last ends on the last frame, and none begins after that."""
    span = frames * (skip + 1)
    advance = max(1, round(span * (1 - overlap)))
    count = F.greatest(F.lit(0), F.ceil((F.col(n_frames) - span) / advance)).cast("int") + 1
    out = df.withColumn("w", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("w") * advance
    return out.withColumns({"w_start": start, "w_end": F.least(start + span - 1, F.col(n_frames) - 1)})


def sweep(df: DataFrame, grid: dict[str, tuple[int, int, float]], n_frames: str = "n_frames") -> DataFrame:
    """DRV3: the windows of every configuration of ``grid`` (name: frames, skip, overlap) over the same series, in one pass: ``df`` with config, w, w_start and w_end."""

    def planned(name: str, frames: int, skip: int, overlap: float) -> Column:
        span = frames * (skip + 1)
        advance = max(1, round(span * (1 - overlap)))
        count = F.greatest(F.lit(0), F.ceil((F.col(n_frames) - span) / advance)).cast("int") + 1
        window = lambda w: F.struct(F.lit(name).alias("config"), w.alias("w"), (w * advance).alias("w_start"), F.least(w * advance + span - 1, F.col(n_frames) - 1).cast("long").alias("w_end"))
        return F.transform(F.sequence(F.lit(0), count - 1), window)

    return df.withColumn("_w", F.explode(F.concat(*[planned(name, *c) for name, c in grid.items()]))).select(*df.columns, "_w.*")


def tumbling(df: DataFrame, n_frames: str = "n_frames", *, frames: int = V.WINDOW_FRAMES, skip: int = 0) -> DataFrame:
    """WIN2, WIN3: chunks back to back."""
    return sliding(df, n_frames, frames=frames, skip=skip, overlap=0.0)


def valid_candidates(df: DataFrame) -> DataFrame:
    """SEL13, SEL14: candidates (start, end, action, hand, confidence, sentence, w_start, w_end, ongoing) with whole frames and known words; ends are cut at the window's.

    A start before the window stays: it continues an open segment.
    """
    words = F.col("action").isin(V.ACTIONS) & F.col("hand").isin(V.HANDS) & F.col("confidence").isin(V.CONFIDENCES) & (F.length(F.trim("sentence")) > 0)
    cut = df.withColumns({"start": F.expr("try_cast(start AS bigint)"), "end": F.least(F.expr("try_cast(end AS bigint)"), F.col("w_end").cast("bigint")), "ongoing": F.coalesce("ongoing", F.lit(False))})
    return cut.filter(words & (F.col("end") > F.col("start")))


def story(df: DataFrame, text: str, *, count: int = V.STORY, into: str = "story") -> DataFrame:
    """WIN4: the texts of the last few segments before each one, in order; equal starts go by their other columns."""
    rest = sorted(set(df.columns) - {"key", "start"})
    before = Window.partitionBy("key").orderBy("start", *[c for c in rest if dict(df.dtypes)[c].split("<")[0] not in ("map", "variant")]).rowsBetween(-count, -1)
    return df.withColumn(into, F.array_join(F.collect_list(text).over(before), " "))


def hand_over(tail: dict | None, rows: list[dict], w_start: int) -> tuple[list[dict], dict | None]:
    """WIN6, INT12 for one chunk: finished segments and the new tail.

    A first candidate that begins before the chunk continues the tail: its words, the tail's start. Any other first candidate ends the tail as it was. Then starts are moved to
    the end of the one before, contained ones go, and a last one that is ongoing is the new tail. Without candidates the tail stays.
    """
    if not rows:
        return [], tail
    done, rows = [], [dict(r) for r in rows]
    if tail is not None:
        if rows[0]["start"] < w_start:
            rows[0]["start"] = tail["start"]
        else:
            done.append(tail)
    reach, clear = None, []
    for r in rows:
        r["start"] = r["start"] if reach is None else max(r["start"], reach)
        if r["end"] > r["start"]:
            clear.append(r)
            reach = r["end"]
    if clear and clear[-1]["ongoing"]:
        return done + clear[:-1], clear[-1]
    return done + clear, None


def fold_chunks(df: DataFrame) -> DataFrame:
    """WIN6, WIN7: segments of each key from its chunks' candidates (key, chunk, w_start, start, end, action, ongoing) in order; the tail is flushed at the end.

    The same segments as hand_over gives chunk by chunk. Within a chunk starts are moved to the furthest end so far. A chunk's first candidate continues what the chunk before
    left open if it begins before its own chunk, so continued segments are islands: each takes the first one's start and the last one's words and end.
    """
    line = Window.partitionBy("key", "chunk").orderBy("start", "end", "action", "ongoing")
    whole = Window.partitionBy("key").orderBy("chunk", "_nth")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumns({"_nth": F.row_number().over(line), "_reach": reach, "_open": F.col("start") < F.col("w_start")})
    rows = rows.withColumn("start", F.greatest("start", F.coalesce("_reach", "start"))).filter("end > start")
    tail = F.col("ongoing") & F.coalesce(F.lead("chunk").over(whole) != F.col("chunk"), F.lit(True))
    rows = rows.withColumn("_tail", tail)
    goes_on = F.coalesce((F.col("_nth") == 1) & F.col("_open") & F.lag("_tail").over(whole), F.lit(False))
    rows = rows.withColumn("_island", F.sum((~goes_on).cast("int")).over(whole))
    at = F.struct("chunk", "_nth")
    out = rows.groupBy("key", "_island").agg(F.min_by("start", at).alias("start"), F.max_by("end", at).alias("end"), F.max_by("action", at).alias("action"))
    return out.select("key", "start", "end", "action")


def continuation(start: Column, text: Column) -> Column:
    """WIN8: what a prompt says about an open segment; NULL without one."""
    return F.when(start.isNotNull(), F.format_string("A step began at frame %d and was still going on: %s. If it goes on, report it again with that start.", start, text))
