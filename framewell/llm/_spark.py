"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of sessions without a shared one, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder. A local session that has neither, as in tests, gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    name = spark.sparkContext.applicationId
    if name not in _own:
        _own[name] = tempfile.mkdtemp(prefix="framewell-")
    return _own[name]


def spare(taken: list[str], name: str) -> str:
    """``name``, or with underscores before it one that is not ``taken``, whatever the case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written into the shared folder and read back, and where it is: a lineage cut that outlives the executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def table(df: DataFrame) -> DataFrame:
    """As ``stored``, for tables that a result reads, which stay."""
    return stored(df)[0]


def bucketed(df: DataFrame, by: list[str], buckets: int, *, parts: list[str] | None = None) -> tuple[DataFrame, str]:
    """Writes ``df`` into the shared folder as a table of ``buckets`` buckets, each sorted by ``by``, and reads it back, with its name. Joins of such tables by ``by`` shuffle nothing."""
    name = f"framewell_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, *by).sortBy(*by).option("path", f"{shared_folder(df.sparkSession)}/{name}")
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
    return df.sparkSession.table(name), name


def drop_table(name: str) -> None:
    """Drops a table that ``bucketed`` has written, with its files."""
    spark = SparkSession.active()
    discard(spark, f"{shared_folder(spark)}/{name}")
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def content_key(*parts: Column) -> Column:
    """128 bits of what ``parts`` hold; nulls and empty strings differ."""
    tagged = [F.when(p.isNull(), F.lit(1)).otherwise(F.lit(2)) for p in parts]
    return F.struct(F.xxhash64(*parts, *tagged).alias("a"), F.xxhash64(*tagged, *reversed(parts)).alias("b"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it, also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(lengths: Column) -> Column:
    """For an array of longs, the sums of all elements up to and with each one.

    Works in blocks of about the square root of the length, so that a text with very many pieces costs far less than its square.
    """
    step = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))
    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(1), F.size(lengths), step)).otherwise(F.array().cast("array<int>"))

    def within(block: Column, base: Column) -> Column:
        empty = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(block, empty, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"] + n)).alias("out")))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    folded = F.aggregate(
        F.transform(starts, lambda i: F.slice(lengths, i, step)),
        begin,
        lambda s, block: let(within(block, s["at"]), lambda w: F.struct(w["at"].alias("at"), F.concat(s["out"], F.array(w["out"])).alias("out"))),
    )
    return F.flatten(folded["out"])


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """All leftmost non-overlapping matches as an array of (start, end, value), in code points, end exclusive.

    ``pattern`` must match no empty string. ``guard`` is a cheap test that is true wherever the pattern can match.
    What lies between the matches comes from ``split``, so the starts are sums of lengths.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def placed(x: Column) -> Column:
        sizes = F.transform(x["hits"], lambda m, i: (F.length(F.get(x["gaps"], i)) + F.length(m)).cast("long"))
        ends = let(sizes, running)
        return let(ends, lambda e: F.transform(x["hits"], lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("value"))))

    return F.when(guard & text.rlike(pattern), let(both, placed)).otherwise(none)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, by start and then by the kind's rank, joined by commas. Spans have start, rank, end and kind, in this order."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
