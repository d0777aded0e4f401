"""The levels one after the other over a table of series: boundaries, labels, annotations. Each level keeps what it has done by key, goes on where it stopped, and lets no key fail another."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import intervals as I
from ..sources.commits import Store
from . import assembly, constraints, labeling

_SPAN = "id long, start long, end long, start_source string, end_source string"
_LABEL = "action string, hand string, object string, confidence string, sentence string"
COLUMNS = {
    "boundaries": f"{_SPAN}, duration double, n_frames long",
    "labels": f"{_SPAN}, {_LABEL}, attempts int, fell_back boolean, n_frames long",
    "annotations": f"{_SPAN}, {_LABEL}, start_time double, end_time double, duration double, flags array<string>, n_frames long",
}


@dataclass
class Levels:
    """Where the levels keep their results, and their parameters: ``propose`` for assembly.propose_segments, ``label`` for labeling.label_segments, ``least``, merge and idle gaps for the last.

    ``folder`` is one that driver and executors share. ``mirror`` (SNK5) is a second folder for the annotations' JSON records.
    """

    spark: SparkSession
    folder: str
    make: Callable[[], labeling.Labeler]
    key_type: str = "long"
    fps: float = V.FPS
    least: int = 10
    merge_gap_s: float = V.MERGE_GAP_S
    idle_gap_s: float = V.IDLE_GAP_S
    mirror: str | None = None
    propose: dict[str, Any] = field(default_factory=dict)
    label: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.stores = {name: Store(self.spark, f"{self.folder}/{name}", self.key_type, columns) for name, columns in COLUMNS.items()}

    def boundaries(self, series: DataFrame, events: DataFrame | None, todo: DataFrame) -> DataFrame:
        """Level 1: segments of the series of ``todo``."""
        own = series.join(todo, "key", "left_semi")
        seen = None if events is None else events.join(todo, "key", "left_semi")
        found = assembly.propose_segments(own, seen, fps=self.fps, errors=True, **self.propose)
        sizes = own.groupBy("key").agg((F.max("frame") + 1).alias("n_frames"))
        return found.join(sizes, "key")

    def labels(self, todo: DataFrame) -> DataFrame:
        """Level 2: labels of the finished segments of ``todo``. A labeler that gives no usable answer fails its key."""
        segments = self.stores["boundaries"].read().join(todo, "key", "left_semi")
        said = labeling.label_segments(labeling.prompts(segments), self.make, strict=True, **self.label)
        return segments.drop("duration").join(said, ["key", "id"])

    def annotations(self, todo: DataFrame) -> DataFrame:
        """Level 3: merged, absorbed, filled and flagged rows of the labels of ``todo``; rows of keys that break a rule have its name as their error."""
        labels = self.stores["labels"].read().join(todo, "key", "left_semi")
        # By number, as in label_segments: folds take their time by rows, however few bytes these are.
        labels = labels.repartition(labeling.tasks_of(labels), "key")
        merged = I.merge_adjacent(labels.drop("attempts", "fell_back"), fps=self.fps, gap_s=self.merge_gap_s).drop("members")
        folded = I.enforce_min_length(merged, least=self.least, errors=True)
        path = f"{self.folder}/annotations/absorbed"
        folded.write.mode("overwrite").parquet(path)
        folded = self.spark.read.schema(folded.schema).parquet(path)
        rows = assembly.finish(folded.filter("error IS NULL").drop("error"), fps=self.fps, idle_gap_s=self.idle_gap_s)
        broken = constraints.violations(rows, fps=self.fps).groupBy("key").agg(F.min("rule").alias("error"))
        raised = folded.filter("error IS NOT NULL").select("key", "error")
        return rows.drop("source").join(broken, "key", "left").unionByName(raised, allowMissingColumns=True)

    def run(self, series: DataFrame, events: DataFrame | None = None, *, keys: DataFrame | None = None, levels: tuple[int, ...] = (1, 2, 3), force: bool = False) -> DataFrame:
        """DRV1, DRV2: runs the levels for ``keys``, or all of the series, that they have not done yet (all with ``force``): level, done, skipped, failed.

        A level takes what the one before has done; keys that this has not fail with no result. Stopped anywhere and started again, it ends with what one run gives.
        """
        asked = (series if keys is None else keys).select("key").distinct()
        total, out = asked.count(), []
        made = {1: lambda todo: self.boundaries(series, events, todo), 2: self.labels, 3: self.annotations}
        records = {1: assembly.boundary_record, 2: assembly.label_record, 3: lambda rows, fps: assembly.annotations(rows)}
        for level, name in enumerate(COLUMNS, 1):
            if level not in levels:
                continue
            store, path = self.stores[name], f"{self.folder}/{name}/asked"
            # What is to do is written down, for the level's own commit changes it.
            store.todo(asked, force=force).write.mode("overwrite").parquet(path)
            todo = self.spark.read.schema(asked.schema).parquet(path)
            if todo.isEmpty():
                out.append((name, 0, total, 0))
                continue
            run = store.commit(made[level](todo), todo)
            store.export(records[level](store.read().join(todo, "key", "left_semi"), fps=self.fps), run, f"{self.folder}/{name}/records", *([self.mirror] if self.mirror and level == 3 else []))
            counts = store.runs().filter(F.col("run") == run).agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed")).first()
            out.append((name, counts["done"], total - counts["done"] - counts["failed"], counts["failed"]))
        return self.spark.createDataFrame(out, "level string, done long, skipped long, failed long")
