"""Results by key, committed run by run: a run adds files and never touches those of others, and its keys count once its table of runs is there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders of local sessions without a shared one, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share: ``spark.checkpoint.dir``, or the context's. A local session without either, as in tests, gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="framewell-"))
    return f"{folder}/{uuid.uuid4().hex}"


class Store:
    """One level's results in a folder: ``rows``, by run, and ``runs``, what became of each key in each run.

    A run's number follows from the runs committed before. One that dies half way has left rows but no runs: they are not read, and the next run, which gets the same number, writes
    over them. So a job may be started again at any time, and a key has the rows of the last run in which it was done, whatever runs failed since.
    """

    def __init__(self, spark: SparkSession, folder: str, key_type: str, columns: str):
        self.spark, self.folder = spark, folder
        self.columns = f"key {key_type}, {columns}, error string, run long"
        self.states = f"key {key_type}, status string, error string, n long, run long"
        for kind, schema in (("rows", self.columns), ("runs", self.states)):
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy("run").parquet(f"{folder}/{kind}")

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(self.columns if kind == "rows" else self.states).parquet(f"{self.folder}/{kind}")

    def _put(self, kind: str, df: DataFrame, run: int) -> None:
        """The partition of one run, staged and moved in place at its end; the others stay as they are."""
        df.withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{self.folder}/{kind}")

    def runs(self) -> DataFrame:
        """key, status (done or failed), error, n (rows) and run."""
        return self._read("runs")

    def done(self) -> DataFrame:
        """Keys that are done, with the last run in which they were."""
        return self.runs().filter("status = 'done'").groupBy("key").agg(F.max("run").alias("run"))

    def todo(self, keys: DataFrame, *, force: bool = False) -> DataFrame:
        """SEL12: the keys that are not done yet, or with ``force`` all; failed ones are tried again."""
        asked = keys.select("key").distinct()
        return asked if force else asked.join(self.done(), "key", "left_anti")

    def commit(self, rows: DataFrame, keys: DataFrame) -> int:
        """DRV2: writes the ``rows`` of ``keys`` (key, the level's columns and error) and then what became of the keys; the run's number.

        A key with an error in any row has failed, with all its rows in quarantine, and so has one without rows. No key fails another.
        """
        run = (self.runs().agg(F.max("run")).first()[0] or 0) + 1
        names = [f.name for f in self._read("rows").schema if f.name != "run"]
        self._put("rows", rows.select(*names), run)
        found = self._read("rows").filter(F.col("run") == run).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("error"))
        states = keys.select("key").distinct().join(found, "key", "left").withColumn("error", F.when(F.col("n").isNull(), "no result").otherwise(F.col("error")))
        self._put("runs", states.select("key", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error", F.coalesce("n", F.lit(0).cast("long")).alias("n")), run)
        return run

    def read(self) -> DataFrame:
        """The rows of all keys that are done."""
        return self._read("rows").join(self.done(), ["key", "run"]).drop("error", "run")

    def quarantine(self) -> DataFrame:
        """SNK6: rows and errors of keys that were never done, from their last run; running a job again adds nothing."""
        line = Window.partitionBy("key").orderBy(F.desc("run"))
        last = self.runs().withColumn("_nth", F.row_number().over(line)).filter("_nth = 1 AND status = 'failed'").join(self.done(), "key", "left_anti")
        return last.select("key", "run", F.col("error").alias("reason")).join(self._read("rows"), ["key", "run"], "left").drop("run")

    def export(self, records: DataFrame, run: int, *folders: str) -> None:
        """SNK1, SNK2, SNK5: one JSON record for each key of a run that is done, in every folder; what earlier runs have put there stays."""
        kept = records.join(self.done().filter(F.col("run") == run).select("key"), "key", "left_semi").withColumn("run", F.lit(run))
        for folder in folders:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(folder)
