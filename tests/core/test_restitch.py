"""Stories of windows against stitching everything again before each window, in batch and as a stream."""

import random

from framewell import queries as core
from framewell.operators import intervals as I
from framewell.operators import restitch as RS
from framewell.streaming import restitch as stream
from pyspark.sql import functions as F


def draw_windows(draw, n):
    """Windows of one key; some candidates begin long before their window, some windows are empty."""
    out = []
    for w in range(n):
        begin = w * 10
        found = []
        for i in range(draw.choice([0, 1, 3, 5])):
            start = begin + draw.choice([0, 3, 5, 9, -2, -15, -60])
            start = max(start, 0)
            found.append({"start": start, "end": start + draw.choice([0, 1, 4, 8, 20, 40]), "action": draw.choice("ab"), "hand": "left", "object": draw.choice(["the cup", "cup"]), "sentence": f"s{w}.{i}", "confidence": draw.choice(["low", "medium", "high"])})
        out.append((begin, found))
    return out


def all_again(windows, share, count):
    out, seen = [], []
    for _, found in windows:
        rows = sorted((c for c in seen if c["end"] > c["start"]), key=lambda r: [r[c] for c in I.stitch_order(list(RS.COLUMNS))])
        out.append(RS.told(list(I.resolved(I.clusters(rows, share)))[-count:]))
        seen += found
    return out


def test_marks_change_nothing():
    draw = random.Random(1)
    for _ in range(300):
        windows, share, count = draw_windows(draw, 14), draw.choice([0.2, 0.5, 0.9]), draw.choice([1, 3])
        state, got = RS.Restitcher(share, count, {}, {}), []
        for begin, found in windows:
            got.append(RS.told(state.story()))
            state.add(begin, found)
        assert got == all_again(windows, share, count)


def test_a_window_costs_what_lies_behind_it():
    """A thousand windows: marks hold no more than what is open, and the last window folds its own candidates only."""
    draw = random.Random(2)
    state = RS.Restitcher(0.5, 3, {}, {})
    for w in range(1000):
        state.add(w * 10, [{"start": w * 10 + i, "end": w * 10 + i + 6, "action": draw.choice("ab"), "hand": "left", "object": "cup", "sentence": "s", "confidence": "low"} for i in range(5)])
    assert state.top >= 990 and len(state.rows[state.top]) <= 10 and max(len(m["queue"]) for m in state.marks.values()) <= 12


def test_stream_equals_batch(spark, tiny, tmp_path):
    """Each window in a micro-batch of its own; then silence, after which the timer gives the key's segments."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    candidates, windows = core.windowed(spark, tiny)
    candidates, windows = candidates.filter("key < 8"), windows.filter("key < 8")
    empty = windows.select("key", "w", "w_start", *[F.lit(0).cast("long").alias(c) for c in ("start", "end")], *[F.lit("low").alias(c) for c in RS.COLUMNS[2:]])
    rows = candidates.select(*empty.columns).unionByName(empty).cache()
    last = rows.agg(F.max("w")).first()[0]
    for w in range(last + 1):
        rows.filter(F.col("w") == w).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(stream.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running = stream.stories(source, share=0.3, silence_ms=15_000).writeStream.format("memory").queryName("told").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(processingTime="1 second").start()
    want = sorted((r["key"], r["w"], r["story"]) for r in RS.restitched(candidates, windows, share=0.3).collect())
    segments = sorted((r["key"], r["start"], r["end"], f"{r['action']}, {r['sentence']}") for r in I.stitch(candidates.select("key", *RS.COLUMNS), share=0.3).collect())
    try:
        for _ in range(150):
            running.awaitTermination(1)
            got = spark.table("told").collect()
            if sum(r["kind"] == "segment" for r in got) >= len(segments):
                break
    finally:
        running.stop()
    assert sorted((r["key"], r["w"], r["text"]) for r in got if r["kind"] == "story") == want
    # A key is silent once its own last window is past, while others still go on.
    assert sorted((r["key"], r["start"], r["end"], r["text"]) for r in got if r["kind"] == "segment") == segments
