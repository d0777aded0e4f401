"""The open tail as keyed state of a stream: the same fold over chunks as the batch operator, chunk by chunk as they arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import hand_over

#: Rows of a stream of candidates. last marks a key's final chunk.
SCHEMA = "key long, chunk long, w_start long, start long, end long, action string, ongoing boolean, last boolean"


def read_chunks(spark: SparkSession, folder: str, *, files_per_batch: int = 1) -> DataFrame:
    """Candidates from a folder of Parquet files, a few files for each micro-batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def fold_stream(chunks: DataFrame) -> DataFrame:
    """WIN6, WIN7 on a stream: finished segments as soon as they are known. The state of a key is its open tail and its next chunk.

    Chunks of a key must arrive in order; several may come in one micro-batch. A chunk's candidates come in one micro-batch. The tail is flushed by the last chunk.
    """

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail = json.loads(state.get[0]) if state.exists else None
        rows, out, over = pd.concat(list(parts)), [], False
        for _, chunk in rows.sort_values(["chunk", "start", "end"]).groupby("chunk", sort=True):
            found = [{"start": int(r.start), "end": int(r.end), "action": r.action, "ongoing": bool(r.ongoing)} for r in chunk.itertuples()]
            done, tail = hand_over(tail, found, int(chunk["w_start"].iloc[0]))
            out += done
            over |= bool(chunk["last"].any())
        if over:
            out += [tail] if tail is not None else []
            state.remove()
        else:
            state.update((json.dumps(tail),))
        yield pd.DataFrame([{"key": key[0], "start": r["start"], "end": r["end"], "action": r["action"]} for r in out], columns=["key", "start", "end", "action"])

    return chunks.groupBy("key").applyInPandasWithState(run, "key long, start long, end long, action string", "tail string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, *, late: str = "1 hour", size: str = "6 hours") -> DataFrame:
    """Beyond batch windows: counts of kinds in event-time windows with a watermark; events has ts and kind."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "kind").agg(F.count(F.lit(1)).alias("n"))
