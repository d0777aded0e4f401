"""Prominence of peaks by blocks of frames: what decides it is looked up in the highest and lowest values of blocks, of blocks of blocks, and so on, so that a key of any length is spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames in a block, and blocks in the one above it.
BLOCK = 256
_SIDES = ("left", "right")


def _part(values: Column, place: Column, side: str) -> Column:
    """The elements before the one at ``place`` (from 1), or behind it."""
    return F.slice(values, F.lit(1), place - 1) if side == "left" else F.slice(values, place + 1, F.size(values) - place)


def _nearest(highs: Column, height: Column, side: str) -> Column:
    """The place of the last element above ``height``, or of the first one, from 1; NULL where none is."""
    hits = F.transform(highs, lambda v, i: F.when(v > height, i + 1))
    return F.array_max(hits) if side == "left" else F.array_min(hits)


def _between(lows: Column, at: Column, side: str) -> Column:
    """The least of the elements from the one at ``at`` to the peak's side, without it; of all where ``at`` is NULL."""
    if side == "left":
        return F.array_min(F.slice(lows, F.coalesce(at, F.lit(0)) + 1, F.size(lows)))
    return F.array_min(F.slice(lows, F.lit(1), F.coalesce(at - 1, F.size(lows))))


def _by_side(make) -> Column:
    return F.when(F.col("side") == "left", make("left")).otherwise(make("right"))


def with_prominence(df: DataFrame, value: str, peak: str, keep: list[str], *, longest: int | None = None) -> DataFrame:
    """EVT2: the rows of ``df`` (key, frame, value, and a boolean ``peak``) at peaks, with ``keep`` and ``prominence``: the height over the higher of the two lowest points before a higher
    sample, or the end, on either side.

    Frames are dealt to blocks of BLOCK, which share the key's partitioning. A peak's own block answers for most; where it has no higher sample on a side, the search climbs to the blocks
    beside it, and from a block that has one down again to the first such sample, each step an equi-join by key and block. ``longest`` is the greatest frame, if it is known; else it is
    looked up, for it decides how many levels there are. All work is in the JVM, and no row holds more than BLOCK frames or blocks.
    """
    x = F.col(value).cast("double")
    item = F.struct(F.col("frame").alias("id"), x.alias("x"), F.col(peak).alias("peak"), F.struct(*keep).alias("rest"))
    blocks = df.groupBy("key", F.floor(F.col("frame") / BLOCK).alias("group")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    last = longest if longest is not None else (df.agg(F.max("frame")).first()[0] or 0)
    levels = 1
    while last >= BLOCK**levels:
        levels += 1

    def side(of: str, place: Column, height: Column) -> Column:
        part = _part(F.col("values"), place, of)
        at = _nearest(part, height, of)
        return F.struct(F.least(_between(part, at, of), height).alias("low"), at.isNotNull().alias("found"))

    tops = F.filter(F.transform("items", lambda e, i: F.struct(e.alias("e"), (i + 1).alias("place"))), lambda p: p["e"]["peak"])
    found = blocks.withColumn("values", F.col("items.x")).select("key", "group", F.explode(F.transform(tops, lambda p: F.struct(p["e"].alias("e"), *[side(s, p["place"], p["e"]["x"]).alias(s) for s in _SIDES]))).alias("p"))
    found = found.select("key", "group", F.col("p.e.id").alias("frame"), F.col("p.e.x").alias("height"), "p.e.rest", "p.left", "p.right")
    if levels == 1:
        return found.select("key", "frame", "rest.*", (F.col("height") - F.greatest("left.low", "right.low")).alias("prominence"))

    tables = [blocks.select("key", "group", F.col("items.id").alias("ids"), F.col("items.x").alias("highs"), F.col("items.x").alias("lows"))]
    for _ in range(1, levels):
        node = F.struct(F.col("group").alias("id"), F.array_max("highs").alias("high"), F.array_min("lows").alias("low"))
        up = tables[-1].groupBy("key", F.floor(F.col("group") / BLOCK).alias("above")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
        tables.append(up.select("key", F.col("above").alias("group"), F.col("nodes.id").alias("ids"), F.col("nodes.high").alias("highs"), F.col("nodes.low").alias("lows")))

    # One row for each side. ``node`` is where an open search stands, ``child`` the block of level ``at`` that holds the sample sought.
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}.low").alias("low"), F.col(f"{s}.found").alias("found")) for s in _SIDES])).alias("s")
    asks = found.select("key", "frame", "height", "rest", F.col("group").alias("node"), sides).select("key", "frame", "height", "rest", "node", "s.*").withColumns({"child": F.lit(None).cast("long"), "at": F.lit(None).cast("int")})

    def looked_up(rows: DataFrame, level: int, group: Column, active: Column) -> DataFrame:
        """``rows`` with the block of ``group`` where they are active; the others go by keys that no block has."""
        seek = F.when(active, group).otherwise(-1 - F.col("frame") % 1024)
        return rows.withColumn("group", seek).join(tables[level], ["key", "group"], "left")

    for level in range(1, levels):
        active = ~F.col("found")
        rows = looked_up(asks, level, F.floor(F.col("node") / BLOCK), active)
        place = F.array_position("ids", F.col("node")).cast("int")
        rows = rows.withColumn("hit", F.when(active, _by_side(lambda s: _nearest(_part(F.col("highs"), place, s), F.col("height"), s))))  # noqa: B023
        low = _by_side(lambda s: _between(_part(F.col("lows"), place, s), F.col("hit"), s))  # noqa: B023
        child = _by_side(lambda s: F.get(_part(F.col("ids"), place, s), F.col("hit") - 1))  # noqa: B023
        asks = rows.select(
            "key", "frame", "height", "rest", "side",
            F.when(active, F.floor(F.col("node") / BLOCK)).otherwise(F.col("node")).alias("node"),
            F.when(active, F.least("low", low)).otherwise(F.col("low")).alias("low"),
            (F.col("found") | F.col("hit").isNotNull()).alias("found"),
            F.when(F.col("hit").isNotNull(), child).otherwise(F.col("child")).alias("child"),
            F.when(F.col("hit").isNotNull(), F.lit(level)).otherwise(F.col("at")).alias("at"),
        )
    for level in range(levels - 1, 0, -1):
        active = F.coalesce(F.col("at") == level, F.lit(False))
        rows = looked_up(asks, level - 1, F.col("child"), active)
        rows = rows.withColumn("hit", F.when(active, _by_side(lambda s: _nearest(F.col("highs"), F.col("height"), s))))
        low = _by_side(lambda s: _between(F.col("lows"), F.col("hit"), s))
        asks = rows.select(
            "key", "frame", "height", "rest", "side", "found",
            F.when(active, F.least("low", low)).otherwise(F.col("low")).alias("low"),
            F.when(active, F.get("ids", F.col("hit") - 1)).otherwise(F.col("child")).alias("child"),
            F.when(active, F.lit(level - 1)).otherwise(F.col("at")).alias("at"),
        )
    both = asks.groupBy("key", "frame").agg(F.first("height").alias("height"), F.first("rest").alias("rest"), F.max("low").alias("base"))
    return both.select("key", "frame", "rest.*", (F.col("height") - F.col("base")).alias("prominence"))
