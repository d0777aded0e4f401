"""Listing and reading of episode folders and of records, and writing of annotations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICTS = "map<string,struct<episode_ok:boolean,note:string,segments:map<string,struct<boundary:boolean,label:boolean,sentence:boolean,note:string>>>>"


def load_config(path: str, overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """SRC1: parameters from a YAML file on the driver, with overrides merged over them block by block."""
    import yaml

    with open(path, encoding="utf-8") as file:
        out = yaml.safe_load(file) or {}
    for block, values in (overrides or {}).items():
        out[block] = {**out.get(block, {}), **values} if isinstance(values, dict) else values
    return out


def list_episodes(spark: SparkSession, folder: str, pattern: str = "*.hdf5") -> DataFrame:
    """SRC2, SRC3: task, idx, episode and size of the files <task>/<idx> under a folder. Only names and sizes are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    parts = F.split("path", "/")
    task, stem = F.element_at(parts, -2), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return files.select(task.alias("task"), stem.alias("stem"), F.expr("try_cast(regexp_replace(element_at(split(path, '/'), -1), '[.][^.]*$', '') AS int)").alias("idx"), F.concat_ws("/", task, stem).alias("episode"), "length")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: episodes of a text file, without blank lines and comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("episode")).filter((line != "") & ~line.startswith("#"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC10: one JSON document in each file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: review verdicts, exploded to (episode, segment, episode_ok, boundary, label, sentence)."""
    text = spark.read.option("wholetext", True).text(path).select(F.from_json("value", VERDICTS).alias("v"))
    episodes = text.select(F.explode("v").alias("episode", "e"))
    return episodes.select("episode", "e.episode_ok", F.explode_outer("e.segments").alias("segment", "s")).select("episode", "episode_ok", F.col("segment").cast("int").alias("segment"), "s.boundary", "s.label", "s.sentence")


def write_report(report: DataFrame, folder: str) -> None:
    """SNK8, SNK11: the rows of an audit, or of a sweep's configurations, as JSON in one file: they are as many as there are checks or configurations."""
    report.coalesce(1).write.mode("overwrite").json(folder)


def with_task_config(episodes: DataFrame, overrides: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """SRC12: episodes (task, and more) with the parameters of ``defaults``, over which a task's row of ``overrides`` (task, and some of them) goes; a task without one keeps them."""
    given = [c for c in defaults if c in overrides.columns]
    joined = episodes.join(overrides.select("task", *[F.col(c).alias(f"_{c}") for c in given]), "task", "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.lit(v)) if c in given else F.lit(v) for c, v in defaults.items()}).drop(*[f"_{c}" for c in given])


def debug_sample(df: DataFrame, n: int) -> DataFrame:
    """SNK7: a bounded capture for debugging; the n is the operator's."""
    return df.limit(n)


def probe_keys(entries: DataFrame, required: list[str], *, counted: str = "transforms/leftHand") -> DataFrame:
    """SRC7: for each episode of ``entries`` (episode, name, length: what its file holds) the required names that it lacks, the joints of each hand, how many frames ``counted`` has, and
    whether there are confidences. A required name is there if it is an entry or a folder of one. Joints are names in transforms that begin with a side, but for the hand itself."""
    name = F.col("name")
    joint = F.when(name.startswith("transforms/"), F.substring_index("name", "/", -1))
    of = lambda side: F.array_sort(F.collect_set(F.when(joint.startswith(side) & (joint != f"{side}Hand"), joint)))
    has = lambda wanted: F.max((name == wanted) | name.startswith(f"{wanted}/"))
    facts = entries.groupBy("episode").agg(
        F.array(*[F.struct(F.lit(r).alias("name"), has(r).alias("there")) for r in required]).alias("_found"),
        of("left").alias("joints_left"),
        of("right").alias("joints_right"),
        F.max(F.when(name == counted, F.col("length"))).alias("n_frames"),
        has("confidences").alias("has_confidences"),
    )
    lacking = F.transform(F.filter("_found", lambda f: ~f["there"]), lambda f: f["name"])
    return facts.select("episode", lacking.alias("missing"), "joints_left", "joints_right", "n_frames", "has_confidences")
