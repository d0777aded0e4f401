"""Windows that see the stitched result of all windows before them, stitched again only from where a new window's candidates begin."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import MutableMapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from . import intervals as I
from .folds import fold_keys

SAYS = ("action", "hand", "object", "sentence", "confidence")
COLUMNS = ("start", "end", *SAYS)
_ORDER = I.stitch_order(list(COLUMNS))
#: What an empty key begins with. ``upto``: all candidates that start before it are folded in; ``queue``: their clusters, oldest first, that may still change or follow one that may;
#: ``last`` and ``tail``: the open row of the resolution and the finished ones before it.
START = {"upto": -(1 << 60), "queue": [], "last": None, "tail": []}


class Restitcher:
    """WIN5 for one key: epochs of candidates by start, and before each a mark, the state of the stitching up to there.

    A window's candidates may begin before it, in what earlier windows have covered. Then the marks behind their begin go, and their epochs are one again; all before stays as it is.
    ``marks`` and ``rows`` map an epoch to its mark and its candidates; ``top`` is the last epoch.
    """

    def __init__(self, share: float, count: int, marks: MutableMapping[int, dict], rows: MutableMapping[int, list], top: int = 0):
        self.share, self.count, self.marks, self.rows, self.top = share, count, marks, rows, top
        if top == 0 and 0 not in marks:
            marks[0], rows[0] = START, []

    def _founded(self, mark: dict, rows: list[dict]) -> list[dict]:
        """The clusters of a mark's queue and of ``rows``, in the order in which they were founded."""
        queue = [dict(c) for c in mark["queue"]]
        alive: dict[tuple[str, str], list[dict]] = defaultdict(list)
        for c in queue:
            alive[I._label(c)].append(c)
        for row in sorted(rows, key=lambda r: [r[c] for c in _ORDER]):
            if I.place_in(alive[I._label(row)], own := dict(row), self.share) is None:
                queue.append(own)
        return queue

    def _resolve(self, mark: dict, ready: list[dict]) -> tuple[list[dict], dict | None]:
        """The finished rows and the open one, when sorted clusters follow a mark."""
        tail, last = list(mark["tail"]), mark["last"]
        for row in sorted(ready, key=lambda r: (r["start"], r["end"])):
            done, last = (None, row) if last is None else I.met(last, row)
            if done is not None:
                tail = [*tail, done][-self.count :]
        return tail, last

    def story(self) -> list[dict]:
        """The last ``count`` segments of all candidates so far."""
        mark = self.marks[self.top]
        tail, last = self._resolve(mark, self._founded(mark, self.rows[self.top]))
        return ([*tail, last] if last else tail)[-self.count :]

    def add(self, begin: int, candidates: list[dict]) -> None:
        """Takes the candidates of the window that starts at ``begin``. Empty ones play no part."""
        new = [c for c in candidates if c["end"] > c["start"]]
        lowest = min([begin, *(c["start"] for c in new)])
        while self.top and self.marks[self.top]["upto"] > lowest:
            self.rows[self.top - 1] = [*self.rows[self.top - 1], *self.rows[self.top]]
            del self.marks[self.top], self.rows[self.top]
            self.top -= 1
        held, mark = [*self.rows[self.top], *new], self.marks[self.top]
        if begin <= mark["upto"]:
            self.rows[self.top] = held
            return
        early = [c for c in held if c["start"] < begin]
        queue = self._founded(mark, early)
        limit = min([begin, *(c["start"] for c in queue if c["end"] - begin >= self.share * (c["end"] - c["start"]))])
        tail, last = self._resolve(mark, [c for c in queue if c["start"] < limit])
        self.rows[self.top], self.rows[self.top + 1] = early, [c for c in held if c["start"] >= begin]
        self.marks[self.top + 1] = {"upto": begin, "queue": [c for c in queue if c["start"] >= limit], "last": last, "tail": tail}
        self.top += 1


def told(segments: list[dict]) -> str:
    """A story of segments, a line for each."""
    return "\n".join(f"frames {s['start']}-{s['end']}: {s['action']}, {s['sentence']}" for s in segments)


def restitched(candidates: DataFrame, windows: DataFrame, *, share: float = V.IOU, count: int = V.STORY) -> DataFrame:
    """WIN5: for every window (key, w, w_start, in order of w) the story that its prompt tells: the last ``count`` segments of all candidates of the windows before it, stitched.

    ``candidates`` has key, w and w_start besides what stitch needs. A key's fold remembers marks, so that a window costs what lies behind its first candidate, not all before it.
    """
    blank = {c: F.lit(0).cast("long") if c in ("start", "end") else F.lit("low") for c in COLUMNS}
    columns = ["w", "w_start", *COLUMNS]
    typed = candidates.select("key", *[F.col(c).cast("long").alias(c) if c in ("w", "w_start", "start", "end") else F.col(c) for c in columns])
    every = windows.select("key", F.col("w").cast("long").alias("w"), F.col("w_start").cast("long").alias("w_start"), *[v.alias(c) for c, v in blank.items()])

    def fold(rows: list[tuple]) -> list[tuple]:
        state, out, at = Restitcher(share, count, {}, {}), [], 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to][0] == rows[at][0]:
                to += 1
            out.append((rows[at][0], told(state.story())))
            state.add(rows[at][1], [dict(zip(COLUMNS, r[2:], strict=True)) for r in rows[at:to]])
            at = to
        return out

    return fold_keys(typed.unionByName(every), columns, ["w", *_ORDER], fold, "w long, story string")
