"""Stories of windows as they arrive: the stitching's marks and candidates are a key's state, and a timer closes keys that fall silent."""

from __future__ import annotations

import json
from collections.abc import Iterator, MutableMapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import vocabulary as V
from ..operators import intervals as I
from ..operators.restitch import COLUMNS, Restitcher, told

#: Rows of a stream of candidates. An empty span stands for a window without candidates.
SCHEMA = "key long, w long, w_start long, start long, end long, action string, hand string, object string, sentence string, confidence string"
#: A window's story (kind story; w), and a key's segments when it is closed (kind segment; start, end and text).
OUTPUT = "key long, kind string, w long, start long, end long, text string"


class _Map(MutableMapping):
    """Numbers to values, kept as JSON in a map state: only what is touched is read."""

    def __init__(self, state: Any):
        self.state = state

    def __getitem__(self, k: int) -> Any:
        return json.loads(self.state.getValue((k,))[0])

    def __setitem__(self, k: int, v: Any) -> None:
        self.state.updateValue((k,), (json.dumps(v),))

    def __delitem__(self, k: int) -> None:
        self.state.removeKey((k,))

    def __contains__(self, k: object) -> bool:
        return self.state.containsKey((k,))

    def __iter__(self) -> Iterator[int]:
        return (k[0] for k in self.state.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self)


class Stories(StatefulProcessor):
    """WIN5 on a stream, by the batch operator's Restitcher. A key whose windows stop for ``silence_ms`` is stitched once more from its first candidate, put out and forgotten."""

    def __init__(self, share: float, count: int, silence_ms: int):
        self.share, self.count, self.silence_ms = share, count, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getMapState("marks", "epoch long", "mark string")
        self.rows = handle.getMapState("rows", "epoch long", "candidates string")
        self.top = handle.getValueState("top", "epoch long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = Restitcher(self.share, self.count, _Map(self.marks), _Map(self.rows), self.top.get()[0] if self.top.exists() else 0)
        out = []
        for w, part in pd.concat(list(rows)).groupby("w", sort=True):
            out.append((key[0], "story", int(w), None, None, told(state.story())))
            found = [{c: int(r[c]) if c in ("start", "end") else r[c] for c in COLUMNS} for r in part.to_dict("records")]
            state.add(int(part["w_start"].iloc[0]), found)
        self.top.update((state.top,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        yield pd.DataFrame(out, columns=["key", "kind", "w", "start", "end", "text"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        kept = _Map(self.rows)
        rows = sorted((c for epoch in list(kept) for c in kept[epoch]), key=lambda r: [r[c] for c in I.stitch_order(list(COLUMNS))])
        done = I.resolved(I.clusters(rows, self.share))
        for state in (self.marks, self.rows, self.top):
            state.clear()
        yield pd.DataFrame([(key[0], "segment", None, s["start"], s["end"], f"{s['action']}, {s['sentence']}") for s in done], columns=["key", "kind", "w", "start", "end", "text"])


def stories(candidates: DataFrame, *, share: float = V.IOU, count: int = V.STORY, silence_ms: int = 60_000) -> DataFrame:
    """Stories and, once a key is silent, segments of a stream of candidates (SCHEMA). Windows of a key arrive in order, each whole in one micro-batch; several may come in one.

    Needs the RocksDB state store, which keeps maps.
    """
    return candidates.groupBy("key").transformWithStateInPandas(Stories(share, count, silence_ms), OUTPUT, "Append", "ProcessingTime")
