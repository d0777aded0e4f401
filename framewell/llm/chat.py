"""Chat formatting: logged conversations that are a beginning of longer ones go, the others are rendered.

A conversation logged after every turn appears as many growing snapshots. Rolling hashes of its turns identify each beginning; an anti-join keeps the maximal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import table

#: Turns of a conversation that one rendered row holds at most.
BLOCK = 256
#: Parts in which equal turns of a conversation may be dealt.
SALTS = 1024
#: Marks around a turn, and what stands for them inside a text.
OPEN, CLOSE, HIDDEN = "<|im_start|>", "<|im_end|>", "<im>"


def render_turn(role: Column, text: Column) -> Column:
    """A turn with its role in marks. Marks inside the text are hidden, so that no text can open or close a turn."""
    safe = F.coalesce(text, F.lit(""))
    for mark in (OPEN, CLOSE):
        safe = F.replace(safe, F.lit(mark), F.lit(HIDDEN))
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), safe, F.lit(CLOSE + "\n"))


def _positions(turns: DataFrame) -> DataFrame:
    """Adds ``_at``, a turn's place from 0, and ``_all``, the number of its conversation's turns, block by block: one conversation may hold a third of all rows."""
    counts = turns.groupBy("_conv", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_conv", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_conv")).alias("_all"))
    place = Window.partitionBy("_conv", "_block").orderBy("turn", "role", "text", "_salt")
    return turns.join(counts, ["_conv", "_block"]).withColumn("_at", F.col("_before") + F.row_number().over(place) - 1)


def _prefix_hashes(placed: DataFrame) -> DataFrame:
    """For every turn the hash of its conversation up to it: four sums of 31 bits of hashed (place, role, text), about 124 bits in all."""
    null = [F.col(c).isNull() for c in ("role", "text")]
    a, b = F.xxhash64("_at", "role", "text", *null), F.xxhash64(*null, "text", "role", "_at", F.lit(7))
    lanes = {f"_l{i}": F.shiftrightunsigned(h, s).bitwiseAND(F.lit((1 << 31) - 1)) for i, (h, s) in enumerate(((a, 0), (a, 32), (b, 0), (b, 32)))}
    turns = placed.select("_conv", "_block", "conv_id", "_at", "_all", *[v.alias(k) for k, v in lanes.items()])
    blocks = turns.groupBy("_conv", "_block").agg(*[F.sum(c).alias(f"{c}_sum") for c in lanes])
    earlier = Window.partitionBy("_conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_conv", "_block", *[F.coalesce(F.sum(f"{c}_sum").over(earlier), F.lit(0)).alias(f"{c}_base") for c in lanes])
    within = Window.partitionBy("_conv", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rolling = F.struct((F.col("_at") + 1).alias("n"), *[(F.col(f"{c}_base") + F.sum(c).over(within)).alias(c) for c in lanes])
    return turns.join(blocks, ["_conv", "_block"]).select("_conv", "conv_id", (F.col("_at") + 1 == F.col("_all")).alias("_last"), rolling.alias("hash"))


def _prepared(turns: DataFrame) -> DataFrame:
    """The turns as a table, dealt to ranges of (conversation, turn, role, text): ``_block`` is a row's range, so that a block is bounded however the turns are numbered."""
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    rows = turns.select("conv_id", "turn", "role", "text", conv.alias("_conv"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("_salt"))
    return table(rows.repartitionByRange("_conv", "turn", "role", "text", "_salt").withColumn("_block", F.spark_partition_id()))


def maximal_conversations(placed: DataFrame) -> DataFrame:
    """``_conv`` keys of the conversations of _positions that are no beginning of another; of equal ones the smallest conv_id's stays."""
    hashes = _prefix_hashes(placed)
    whole = hashes.filter("_last").groupBy("hash").agg(F.min(F.struct(F.col("conv_id").isNull(), F.col("conv_id"), F.col("_conv"))).alias("first"))
    beginnings = hashes.filter(~F.col("_last")).select("hash").distinct()
    return whole.join(beginnings, "hash", "left_anti").select(F.col("first._conv").alias("_conv"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Rendered maximal conversations: conv_id, chunk (int, from 0), n_turns (long, of the conversation) and rendered.

    ``turns`` has conv_id, turn, role and text; other columns play no part. Turns are ordered by turn, nulls first, then role and text. Two conversations are equal, and one
    begins another, by roles and texts alone; null and empty ones differ. Rows with a null conv_id are one conversation. A repeated row is one more turn. A conversation comes
    in one row for each BLOCK turns, which for most is a single one, so that no row or task holds an unbounded conversation, also where turns have equal or null numbers.
    An empty table gives an empty one.
    """
    placed = _positions(_prepared(turns))
    kept = placed.join(maximal_conversations(placed), "_conv", "left_semi").withColumn("chunk", F.floor(F.col("_at") / BLOCK).cast("int"))
    chunks = kept.groupBy("_conv", "chunk").agg(
        F.first("conv_id").alias("conv_id"),
        F.first("_all").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", render_turn(F.col("role"), F.col("text")).alias("line")))), lambda x: x["line"]), "").alias("rendered"),
    )
    return chunks.select("conv_id", "chunk", "n_turns", "rendered")
