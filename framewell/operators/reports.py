"""Aggregate reports: histograms, rates, entropy, agreement and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from .intervals import upper_median
from .joins import mutual_hits


def segment_stats(df: DataFrame, *, fps: float) -> DataFrame:
    """AGG1: for each key its segments, their rate a minute, shortest, median and longest duration, coverage, and how many boundaries each source gave (``sources``, by name),
    if the segments have a start_source: starts after the series' first frame, as the end of one segment is the start of the next."""
    length = F.col("end") - F.col("start")
    out = df.groupBy("key").agg(
        F.count(F.lit(1)).alias("segments"),
        F.min(length / fps).alias("shortest"),
        F.median(length / fps).alias("median"),
        F.max(length / fps).alias("longest"),
        F.sum(length).alias("_covered"),
        F.max("n_frames").alias("n_frames"),
    )
    rate, coverage = F.col("segments") / (F.col("n_frames") / fps / 60), F.col("_covered") / (F.col("n_frames") - 1)
    stats = out.select("key", "segments", F.round(rate, 6).alias("per_minute"), *[F.round(c, 6).alias(c) for c in ("shortest", "median", "longest")], F.round(coverage, 6).alias("coverage"))
    if "start_source" not in df.columns:
        return stats
    counts = df.filter("start > 0").groupBy("key", "start_source").agg(F.count(F.lit(1)).alias("n"))
    named = counts.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("start_source", "n")))).alias("sources"))
    return stats.join(named, "key", "left").withColumn("sources", F.coalesce("sources", F.create_map().cast("map<string,bigint>")))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """AGG2, AGG17: counts of a column's values and their share."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def rate(condition: Column) -> Column:
    """AGG3: share of rows for which a condition holds, NULLs left out."""
    return F.avg(condition.cast("double"))


def judged(df: DataFrame, by: list[str], axis: str) -> DataFrame:
    """AGG8, AGG10: accuracy and number of judged rows by group; NULL is not judged."""
    return df.groupBy(*by).agg(F.round(rate(F.col(axis)), 6).alias("accuracy"), F.count(axis).alias("judged"))


def top_opening(df: DataFrame, text: str) -> DataFrame:
    """AGG4: the commonest first two words and their share; of equal ones the first in the alphabet."""
    counts = df.groupBy(S.first_two_words(F.col(text)).alias("opening")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.orderBy(F.desc("n"), "opening").limit(1).join(F.broadcast(total), F.lit(True)).select("opening", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def naming_inconsistent(df: DataFrame, name: str) -> DataFrame:
    """AGG5: keys with more distinct names than max(2, two thirds of their rows); only a leading 'the ' is dropped."""
    plain = F.regexp_replace(F.lower(F.trim(F.col(name))), "^the ", "")
    out = df.groupBy("key").agg(F.count_distinct(plain).alias("names"), F.count(F.lit(1)).alias("rows"))
    return out.filter(F.col("names") > F.greatest(F.lit(2), F.floor(F.col("rows") * 2 / 3)))


def entropy(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """AGG12: bits of a value's distribution in each group."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("weighted"))
    return whole.select(*by, F.round(F.log2("total") - F.col("weighted") / F.col("total"), 6).alias("bits"))


def top_values(df: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """AGG14, TOP1: the k commonest values of each group; equal ones by value."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def boundary_f1(boundaries: DataFrame, keys: DataFrame, tolerance: int) -> DataFrame:
    """AGG13, JN9, JN10: mean agreement of each ordered pair of configurations over ``keys``: config, other, f1.

    A boundary is matched if the other side has one within the tolerance. Two empty sides agree, one empty side does not.
    """
    found = mutual_hits(boundaries.join(keys.select("key"), "key", "left_semi"), tolerance)
    share = lambda hits, n: F.col(hits) / F.nullif(F.col(n), F.lit(0))
    p, r = share("hits_a", "n_a"), share("hits_b", "n_b")
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    sums = found.groupBy("a", "b").agg(F.sum(f1).alias("sum"), F.count(F.lit(1)).alias("n"))
    # Keys of which neither side has a boundary are in no row, and agree. Agreement is the same both ways.
    total = keys.agg(F.count(F.lit(1)).alias("keys"))
    mean = F.round((F.col("sum") + F.col("keys") - F.col("n")) / F.col("keys"), 6)
    way = lambda x, y: F.struct(F.col(x).alias("config"), F.col(y).alias("other"), mean.alias("f1"))
    return sums.join(F.broadcast(total), F.lit(True)).select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("r")).select("r.*")


def tally(df: DataFrame, best: str, worst: str) -> DataFrame:
    """AGG15: best, worst and net votes of each configuration, where a row counts if both its votes are valid."""
    valid = df.filter(F.col(best).isNotNull() & F.col(worst).isNotNull())
    votes = valid.select(F.explode(F.array(F.struct(F.col(best).alias("config"), F.lit(1).alias("b"), F.lit(0).alias("w")), F.struct(F.col(worst).alias("config"), F.lit(0).alias("b"), F.lit(1).alias("w")))).alias("v"))
    return votes.groupBy("v.config").agg(F.sum("v.b").alias("best"), F.sum("v.w").alias("worst"), F.sum(F.col("v.b") - F.col("v.w")).alias("net"))


def verb_agreement(df: DataFrame) -> DataFrame:
    """AGG6: of segments (action, start_source, end_source) that begin with a grasp, and of those that end with a release, how many have a verb that fits: side, agreement, n."""
    facts = F.array(
        F.struct(F.lit("grasp_start").alias("side"), (F.col("start_source") == "grasp").alias("counts"), F.col("action").isin(V.GRASP_START_VERBS).alias("fits")),
        F.struct(F.lit("release_end").alias("side"), (F.col("end_source") == "release").alias("counts"), F.col("action").isin(V.RELEASE_END_VERBS).alias("fits")),
    )
    return df.select(F.explode(facts).alias("f")).filter("f.counts").groupBy("f.side").agg(F.round(rate(F.col("f.fits")), 6).alias("agreement"), F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame) -> DataFrame:
    """AGG7: subtasks (key, action, flags), how many a key, the share with flags, and the verbs' counts, the commonest first."""
    by_verb = rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("flags") > 0).alias("bad"))
    sums = by_verb.agg(F.sum("n").alias("subtasks"), F.sum("bad").alias("bad"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "action"))).alias("verbs"))
    keys = rows.agg(F.count_distinct("key").alias("keys"))
    named = F.transform("verbs", lambda v: F.concat_ws(" ", v["action"], (-v["n"]).cast("string")))
    out = sums.join(F.broadcast(keys), F.lit(True))
    return out.select("subtasks", F.round(F.col("subtasks") / F.col("keys"), 6).alias("per_key"), F.round(F.col("bad") / F.col("subtasks"), 6).alias("flagged"), F.array_join(named, ",").alias("verbs"))


def config_metrics(windows: DataFrame, subtasks: DataFrame, *, fps: float = V.FPS) -> DataFrame:
    """AGG11: for each configuration what its windows (config, key, windows, candidates, stitched, wall_s) cost and what its subtasks (config, key, start, end, action, confidence,
    flags) are like: seconds a window, how much stitching merged, subtasks a key, upper median duration, idle share of frames, verbs and their entropy, and doubtful shares."""
    cost = windows.groupBy("config").agg(*[F.sum(c).alias(c) for c in ("windows", "candidates", "stitched", "wall_s")])
    length = F.col("end") - F.col("start")
    like = subtasks.groupBy("config").agg(
        F.round(F.count(F.lit(1)) / F.count_distinct("key"), 6).alias("per_key"),
        F.round(F.sum(F.when(F.col("action") == "idle", length).otherwise(0)) / F.greatest(F.sum(length), F.lit(1)), 6).alias("idle_share"),
        F.count_distinct("action").alias("verbs"),
        F.round(rate(F.col("confidence") == "low"), 6).alias("low_confidence"),
        F.round(rate(F.size("flags") > 0), 6).alias("flagged"),
    )
    median = upper_median(subtasks, length, ["config"]).select("config", F.round(F.col("upper_median") / fps, 6).alias("median_s"))
    out = cost.join(like, "config").join(median, "config").join(entropy(subtasks, ["config"], "action"), "config")
    paid = F.round(F.col("wall_s") / F.greatest("windows", F.lit(1)), 6).alias("s_per_window")
    merged = F.round(1 - F.col("stitched") / F.greatest("candidates", F.lit(1)), 6).alias("merge_ratio")
    return out.select("config", "windows", paid, merged, "per_key", "median_s", "idle_share", "verbs", "bits", "low_confidence", "flagged")


def throughput(runs: DataFrame) -> DataFrame:
    """AGG16: of runs (status, segments, wall_s) how many were done, skipped and failed, and the segments a minute of those done."""
    done = F.col("status") == "done"
    minutes = F.sum(F.when(done, F.col("wall_s"))) / 60
    return runs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("done", "skipped", "failed")], F.round(F.sum(F.when(done, F.col("segments"))) / minutes, 6).alias("segments_per_minute"))
