"""Reading tables, and views of them as keyed, frame-indexed series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The most rows of a table that a task deals with at once where a series' windows, and what follows, keep to its partitions.
TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many partitions by ``keys`` as its rows need, if those of the session's cores would hold more than TASK_ROWS each; partitions that are joined by their compressed bytes hold any number."""
    rows = df.count()
    return df.repartition(-(-rows // TASK_ROWS), *keys) if rows > TASK_ROWS * df.sparkSession.sparkContext.defaultParallelism else df


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as series: key, frame (from 0), x and kind, one series for each user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = dealt(read(spark, sf_dir, "events"), "user_id")
    return events.select(F.col("user_id").alias("key"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.col("value").alias("x"), F.col("event_type").alias("kind"), (F.col("event_type") != "error").alias("valid"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal kinds as segments: key, start, end (touching the next start), action, hand, object, confidence and n_frames."""
    series = frames(spark, sf_dir)
    line = Window.partitionBy("key").orderBy("frame")
    new = F.coalesce((F.col("kind") != F.lag("kind").over(line)).cast("int"), F.lit(1))
    runs = series.withColumn("run", F.sum(new).over(line)).groupBy("key", "run").agg(F.min("frame").alias("start"), F.max("frame").alias("last"), F.first("kind").alias("kind"), F.max_by("x", "frame").alias("x"))
    after = Window.partitionBy("key").orderBy("run")
    total = F.max("last").over(Window.partitionBy("key"))
    return runs.select(
        "key",
        F.col("start"),
        F.coalesce(F.lead("start").over(after), F.col("last")).alias("end"),
        F.when(F.col("kind").isin("view", "click"), "reach").when(F.col("kind") == "purchase", "grasp").otherwise("place").alias("action"),
        F.when(F.col("x") < 20, "left").otherwise("right").alias("hand"),
        F.when(F.col("x") < 60, "the cup").otherwise("cup").alias("object"),
        F.when(F.col("x") < 15, "low").when(F.col("x") < 50, "medium").otherwise("high").alias("confidence"),
        F.concat_ws(" ", "kind", F.col("start").cast("string")).alias("sentence"),
        F.col("kind").alias("start_source"),
        F.coalesce(F.lead("kind").over(after), F.lit("episode_end")).alias("end_source"),
        (total + 1).alias("n_frames"),
    ).filter("end > start")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping labelled candidates: key, start, end, action, hand, object, sentence and confidence, from every event; many differ in hand and article only."""
    f = frames(spark, sf_dir)
    return f.select(
        "key",
        F.col("frame").alias("start"),
        (F.col("frame") + 1 + F.floor(F.col("x") / 50)).alias("end"),
        F.col("kind").alias("action"),
        F.when(F.col("frame") % 2 == 0, "left").otherwise("both").alias("hand"),
        F.when(F.col("frame") % 3 == 0, "The cup").otherwise("cup").alias("object"),
        F.concat_ws(" ", "kind", F.col("frame").cast("string")).alias("sentence"),
        F.when(F.col("x") < 15, "low").when(F.col("x") < 50, "medium").otherwise("high").alias("confidence"),
    )
