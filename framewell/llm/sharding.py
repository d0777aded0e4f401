"""Shards that all hold the corpus's mixture of sources.

Rows are shuffled within their source by a seeded hash, ranked, and ordered by fractional rank over all sources; equal cuts of that order are the shards.
Every step works on hash ranges of a source or ranges of the fractional rank, so that a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hash ranges within a source, ranges of the fractional rank, and phases of the sources. Ranks up to 10**11 keep whole numbers in 64 bits with it, and a range holds 1/4096 of a source.
RANGES = 4096


def interleave_shards(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``shard`` (int, 0 to n_shards - 1) and ``slot`` (long, gapless from 0 in each shard) to every row of ``docs``.

    The shards' row counts differ by one at most. A row's place in its source follows md5(seed:id); equal ids are ordered by ``tie_cols``, which also stand in for a null id.
    The r-th of the n rows of a source stands at (r - phase) / n of the order, where the phase in (0, 1] comes from the source's own hash:
    without it all sources of one row would meet at one point. A null source is a source of its own. Texts play no part, however long.
    Repeated rows are rows like others. Columns named shard or slot are replaced, others are kept whatever their names; an empty table gives an empty one.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    docs = docs.drop("shard", "slot")
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    ties = F.concat_ws(":", F.lit(""), *[F.col(c).cast("string") for c in tie_cols])
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), ties)).cast("binary"))
    named = [F.col(c).alias(f"tie{i}") for i, c in enumerate((id_col, *tie_cols))]
    rows = docs.select(F.struct("*").alias("row"), *named, key.alias("source"), order.alias("order"))
    rows = rows.withColumn("range", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))

    counts = rows.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    phase = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("source")).cast("binary")), 1, 3), 16, 10).cast("long") + 1
    counts = counts.select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("source")).alias("total"), phase.alias("phase"))

    place = Window.partitionBy("source", "range").orderBy("order", *[f"tie{i}" for i in range(len(named))])
    ranked = rows.join(counts, ["source", "range"]).withColumn("rank", F.col("before") + F.row_number().over(place))
    part = f"({RANGES}L * rank - phase)"
    ranked = ranked.withColumns({"cut": F.expr(f"cast(({RANGES}L * {part}) div ({RANGES}L * total) as int)"), "share": F.expr(f"{part} / cast({RANGES}L * total as double)")})

    # How many ranks lie below each range of the fractional rank follows from the sources' counts: those of equal count and phase lie alike. A large source is told for every range by a
    # closed form, a small one rank by rank, so that there are never more entries than rows, however many sources there are.
    alike = counts.select("source", "total", "phase").distinct().groupBy("total", "phase").agg(F.count(F.lit(1)).alias("sources"))
    below = F.expr(f"sources * greatest(0L, ({RANGES}L * total * cut + phase * {RANGES}L - 1) div ({RANGES}L * {RANGES}L))")
    large = alike.filter(F.col("total") > RANGES).select("*", F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))).alias("cut"))
    large = large.groupBy("cut").agg(F.sum(below).alias("below"), F.sum(F.col("sources") * F.col("total")).alias("rows"))
    small = alike.filter(F.col("total") <= RANGES).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total"))).alias("rank"))
    small = small.groupBy(F.expr(f"cast(({RANGES}L * {part}) div ({RANGES}L * total) as int)").alias("cut")).agg(F.sum("sources").alias("here"))
    cuts = docs.sparkSession.range(RANGES).select(F.col("id").cast("int").alias("cut")).join(large, "cut", "left").join(small, "cut", "left").fillna(0, ["below", "rows", "here"])
    upward = Window.orderBy("cut")
    cuts = cuts.select("cut", (F.col("below") + F.sum("here").over(upward) - F.col("here")).alias("below"), (F.col("rows") + F.sum("here").over(upward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("all"))

    line = Window.partitionBy("cut").orderBy("share", "source", "rank")
    placed = ranked.join(F.broadcast(cuts), "cut").withColumn("at", F.col("below") + F.row_number().over(line) - 1)
    placed = placed.withColumn("shard", F.expr(f"cast((at * {n_shards}L) div all as int)"))
    placed = placed.withColumn("slot", F.expr(f"at - (shard * all + {n_shards - 1}L) div {n_shards}L"))
    return placed.select("row.*", "shard", "slot")
