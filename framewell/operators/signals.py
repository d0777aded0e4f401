"""Per-frame signals of keyed series: gap filling, smoothing, derivatives, masks and runs.

Every function takes a table with ``key`` and ``frame`` columns and works by bounded window frames, one exchange by key for all of them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def line() -> WindowSpec:
    """A key's frames in order. Windows need a session, which workers lack, so they aren't made on import."""
    return Window.partitionBy("key").orderBy("frame")


def whole() -> WindowSpec:
    return Window.partitionBy("key")


def translation(pose: Column) -> Column:
    """SIG1: where a row-major 4 x 4 pose stands: x, y and z as doubles."""
    return F.struct(*[F.get(pose, F.lit(i)).cast("double").alias(n) for n, i in (("x", 3), ("y", 7), ("z", 11))])


def rotation(pose: Column) -> Column:
    """SIG2: the row-major 3 x 3 rotation of a row-major 4 x 4 pose, as doubles."""
    return F.transform(F.concat(F.slice(pose, 1, 3), F.slice(pose, 5, 3), F.slice(pose, 9, 3)), lambda v: v.cast("double"))


def joint_valid(confidence: Column, matrix: Column, least: float = V.CONFIDENCE_VALID_MIN) -> Column:
    """SEL6: a joint is valid by its confidence where it has one (NaN is none), else if no entry of its pose is NaN."""
    return F.when(confidence.isNotNull(), ~F.isnan(confidence) & (confidence >= least)).otherwise(~F.exists(matrix, F.isnan))


def fill_gaps(df: DataFrame, value: str, valid: str, *, max_gap: int = V.MAX_GAP, into: str = "filled", mask: str = "masked") -> DataFrame:
    """SIG3, SIG10: invalid runs of at most max_gap frames with neighbours on both sides are filled linearly; longer ones keep their values and stay masked."""
    before = line().rowsBetween(Window.unboundedPreceding, 0)
    # What follows a frame comes first in the other direction; a window that reaches ahead without end would start anew at every row.
    after = Window.partitionBy("key").orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(valid), F.struct(F.col("frame").alias("f"), F.col(value).cast("double").alias("v")))
    out = df.withColumns({"_p": F.last(known, ignorenulls=True).over(before), "_n": F.last(known, ignorenulls=True).over(after)})
    gap = F.col("_n.f") - F.col("_p.f") - 1
    fits = ~F.col(valid) & (gap <= max_gap)
    between = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("frame") - F.col("_p.f")) / (F.col("_n.f") - F.col("_p.f"))
    out = out.withColumns({into: F.when(fits, between).otherwise(F.col(value).cast("double")), mask: ~F.col(valid) & ~F.coalesce(fits, F.lit(False))})
    return out.drop("_p", "_n")


@lru_cache(maxsize=16)
def smoothing_rows(window: int, degree: int) -> list[list[float]]:
    """Row i has the weights of a window's values that give the fitted polynomial's value at its i-th place."""
    a = np.vander(np.arange(window) - window // 2, degree + 1).astype(float)
    return (a @ np.linalg.pinv(a)).tolist()


def smooth(df: DataFrame, value: str, *, window: int = V.SMOOTH_WINDOW, degree: int = V.SMOOTH_DEGREE, into: str = "smooth") -> DataFrame:
    """SIG4: Savitzky-Golay. The window shrinks to an odd length within short series, and values stay as they are where it would not exceed the degree.

    The first and last half windows take the values of the polynomial fitted to the first and last whole window. Only ``2 * window - 1`` neighbours are held for a row.
    """
    near = line().rowsBetween(1 - window, window - 1)
    x = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    out = df.withColumns({"_all": F.count(F.lit(1)).over(whole()), "_at": F.row_number().over(line()) - 1, "_near": F.collect_list(x).over(near)})
    width = F.least(F.lit(window), F.col("_all") - (F.col("_all") + 1) % 2).cast("int")
    out = out.withColumn("_w", width).withColumn("_s", F.greatest(F.lit(0), F.least(F.col("_at") - F.floor(F.col("_w") / 2), F.col("_all") - F.col("_w"))).cast("int"))
    sizes = [w for w in range(3, window + 1, 2) if w > degree]
    table = F.create_map(*[v for w in sizes for v in (F.lit(w), F.array(*[F.array(*map(F.lit, row)) for row in smoothing_rows(w, degree)]))])
    weights = F.get(F.try_element_at(table, F.col("_w")), F.col("_at") - F.col("_s"))
    first = F.col("_at") - F.least(F.col("_at"), F.lit(window - 1))
    values = F.slice("_near", (F.col("_s") - first + 1).cast("int"), F.col("_w"))
    fitted = F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return out.withColumn(into, F.when(F.col("_w") > degree, fitted).otherwise(x)).drop("_all", "_at", "_near", "_w", "_s")


def _doubled_first(step: Column) -> Column:
    """A difference has no value on the first frame; it takes the second's."""
    return F.when(F.row_number().over(line()) == 1, F.lead(step).over(line())).otherwise(step)


def speed(df: DataFrame, position: list[str], *, fps: float = V.FPS, into: str = "speed") -> DataFrame:
    """SIG5 before smoothing: distance from the last frame times fps."""
    square = sum((F.pow(F.col(p) - F.lag(p).over(line()), 2) for p in position), F.lit(0.0))
    out = df.withColumn("_step", F.sqrt(square) * fps)
    return out.withColumn(into, _doubled_first(F.col("_step"))).drop("_step")


def angular_speed(df: DataFrame, rotation: str, *, fps: float = V.FPS, into: str = "angular_speed") -> DataFrame:
    """SIG6 before smoothing: the angle between a row-major rotation and the last frame's, times fps. The trace of a product with a transpose is a sum of products."""
    trace = F.aggregate(F.zip_with(F.col(rotation), F.col("_last"), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    out = df.withColumn("_last", F.lag(rotation).over(line()))
    out = out.withColumn("_step", F.when(F.col("_last").isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))) * fps))
    return out.withColumn(into, _doubled_first(F.col("_step"))).drop("_last", "_step")


def distance(a: list[str], b: list[str]) -> Column:
    """SIG7 before smoothing: the distance of two points."""
    return F.sqrt(sum((F.pow(F.col(p) - F.col(q), 2) for p, q in zip(a, b, strict=True)), F.lit(0.0)))


def gradient(df: DataFrame, value: str, *, fps: float = V.FPS, into: str = "gradient") -> DataFrame:
    """SIG8: central differences inside, one-sided ones at the ends, times fps."""
    back, ahead, x = F.lag(value).over(line()), F.lead(value).over(line()), F.col(value)
    return df.withColumn(into, F.when(back.isNull(), ahead - x).when(ahead.isNull(), x - back).otherwise((ahead - back) / 2) * fps)


def runs(df: DataFrame, mask: str) -> DataFrame:
    """SIG11: maximal runs of frames in which ``mask`` holds: key, start, stop (exclusive)."""
    numbered = df.filter(F.col(mask)).withColumn("_island", F.col("frame") - F.row_number().over(line()))
    return numbered.groupBy("key", "_island").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop")).drop("_island")


def combined_speed(left: Column, right: Column) -> Column:
    """SIG9: the faster hand's speed."""
    return F.greatest(left, right)


def hand_masks(wrist: Column, thumb: Column, index: Column) -> dict[str, Column]:
    """SIG10: a hand's masks from those of its joints: mask_wrist for the wrist's signals, mask_pinch for the aperture, which needs both fingertips, and mask_any for reports only."""
    return {"mask_wrist": wrist, "mask_pinch": thumb | index, "mask_any": wrist | thumb | index}


def sanity(df: DataFrame, position: list[str], valid: str, *, confidence: str | None = None, camera: list[str] | None = None, height: str | None = None) -> DataFrame:
    """SIG13, SIG14: for each key its frames, range, median and 95th percentile of steps, invalid share and longest invalid run, in one pass and one join of sums.

    With ``confidence`` its least, median and greatest value, NaN left out; with ``camera`` the length of its way; with ``height``, a coordinate of the camera less that of the
    wrists, whether the camera's median is above.
    """
    stepped = speed(df, position, fps=1.0, into="step")
    low, high = F.least(*position) if len(position) > 1 else F.col(position[0]), F.greatest(*position) if len(position) > 1 else F.col(position[0])
    stats = [
        F.count(F.lit(1)).alias("frames"),
        F.min(low).alias("low"),
        F.max(high).alias("high"),
        F.percentile("step", 0.5).alias("median_step"),
        F.percentile("step", 0.95).alias("p95_step"),
        F.avg((~F.col(valid)).cast("double")).alias("invalid_share"),
    ]
    if confidence:
        known = F.nanvl(F.col(confidence).cast("double"), F.lit(None).cast("double"))
        stats += [F.min(known).alias("confidence_min"), F.median(known).alias("confidence_median"), F.max(known).alias("confidence_max")]
    if camera:
        square = sum((F.pow(F.col(c) - F.lag(c).over(line()), 2) for c in camera), F.lit(0.0))
        stepped = stepped.withColumn("_way", F.sqrt(square))
        stats.append(F.sum("_way").alias("camera_travel"))
    if height:
        stats.append((F.median(height) > 0).alias("camera_above"))
    longest = runs(df.withColumn("_bad", ~F.col(valid)), "_bad").groupBy("key").agg(F.max(F.col("stop") - F.col("start")).alias("longest_invalid"))
    return stepped.groupBy("key").agg(*stats).join(longest, "key", "left").fillna(0, ["longest_invalid"])
