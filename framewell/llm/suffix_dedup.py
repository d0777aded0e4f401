"""Removal of every byte that a long string repeated anywhere in the corpus covers.

Every window of MATCH bytes has one anchor, the least hashed gram inside it, which its content alone decides; equal windows therefore have equal anchors. The suffixes that
start at anchors, or LEAD bytes before them, are indexed, about one for every 40 bytes. A window either holds the LEAD bytes before its anchor or reaches far behind it, so it
holds the first SHARED bytes of one of the two suffixes, and only windows whose suffix has that much in common with another can repeat. A batch of documents becomes a suffix
array: its suffixes in order of their first bytes. It is merge-scanned against the arrays of all levels, where suffixes with a long common prefix stand side by side, and
levels of equal size merge, so that a suffix is rewritten a logarithmic number of times. Windows of matched suffixes are then compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shingles
from ._shingles import mix
from ._spark import bucketed, drop_table, spare, table

#: Bytes of a repeated string, of a gram, and of grams in a window of that length.
MATCH, GRAM = 200, 32
WIDTH = MATCH - GRAM + 1
#: A window whose anchor lies at least so far in holds that many bytes before it; others hold more behind it.
LEAD = WIDTH // 2
#: Bytes that two suffixes share if windows of theirs can be equal.
SHARED = LEAD + GRAM
#: Batches of the index, in the query: with eight, levels of four, two and one merge.
BATCHES = 8
#: Matched suffixes up to this many are looked up in a broadcast filter of eight bits for each; beyond, the texts are joined with theirs by a shuffle.
FILTERED = 1 << 23
#: Suffixes that occur more often are compared by a shuffle of their windows' hashes instead of in one task.
HOT = 1_000
#: Windows of such a suffix that are compared at once by the bytes that all of them hold.
STRETCH = 11
#: Low bits of a gram's hash that hold its place instead; texts are anchored in pieces of fewer bytes than that counts.
PLACE_BITS = 24
#: Bytes of text that a task hashes at once, texts that it remembers in order to send the entries of equal ones once, and bytes of windows that it compares at once.
CHUNK, REMEMBERED, COMPARED = 1 << 20, 200_000, 4 << 20
_U = np.uint64


def _hash(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from begin to end, from running sums of the polynomial."""
    return mix((total[end] - total[begin]) * _shingles._inverse[begin] + (end - begin).astype(np.uint64))


def _totals(raw: np.ndarray) -> np.ndarray:
    _shingles._grow(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_PLAIN[raw] * _shingles._powers[: len(raw)], out=total[1:])
    return total


# Bytes stand for themselves here: no case is folded.
_PLAIN = _shingles._BYTES.copy()
_PLAIN[65:91] = mix(_shingles._BYTES[65:91] + _U(1))


def anchored(raw: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The suffixes of texts that lie one after the other in ``raw``: lead, key, text, the first and last window start that the suffix stands for, and core, how far it begins behind the first.

    lead is the suffix's first eight bytes as a number in the bytes' order, and key the fingerprint of its first SHARED bytes.
    """
    none = np.zeros(0, np.int64)
    empty = {"lead": none, "key": none.astype(np.uint64), "text": none, "first": none, "last": none, "core": none}
    n = len(raw)
    if n < MATCH:
        return empty
    low = _U((1 << PLACE_BITS) - 1)
    if n > int(low):
        raise ValueError(f"{n} bytes at once, where places have {PLACE_BITS} bits")
    total = _totals(raw)
    at = np.arange(n - GRAM + 1)
    least = (_hash(total, at, at + GRAM) & ~low) | at.astype(np.uint64)
    size = 1
    while size * 2 <= WIDTH:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < WIDTH:
        least = np.minimum(least[: len(least) - (WIDTH - size)], least[WIDTH - size :])
    anchor = (least & low).astype(np.int64)
    lengths = np.diff(starts)
    long = np.flatnonzero(lengths >= MATCH)
    windows = lengths[long] - MATCH + 1
    if not len(long):
        return empty
    text = np.repeat(long, windows)
    place = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts[long], windows)
    anchor = anchor[place]
    lead = anchor - place >= LEAD
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (lead[1:] != lead[:-1])]))
    last = np.append(new[1:], len(text)) - 1
    a, front = anchor[new], lead[new]
    begin = np.where(front, a - LEAD, a)
    key = mix(_hash(total, begin, begin + SHARED) + front.astype(np.uint64))
    ahead = np.zeros(len(begin), dtype=np.uint64)
    for k in range(8):
        ahead = ahead << _U(8) | raw[begin + k]
    return {"lead": (ahead ^ _U(1 << 63)).view(np.int64), "key": key, "text": text[new], "first": place[new], "last": place[last], "core": begin - place[new]}


def _texts(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows of an Arrow binary column: the first row, 0, their bytes, and where each begins, with the end last.

    A text that is too long to hash at once comes in pieces, each with the place where it begins. They overlap by MATCH - 1 bytes, so that every window is in one piece.
    """
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row, most = 0, min(CHUNK, (1 << PLACE_BITS) - 1)
    while row < n:
        if ends[row + 1] - ends[row] > most:
            for begin in range(int(ends[row]), int(ends[row + 1]) - MATCH + 1, most - MATCH + 1):
                piece = raw[begin : min(begin + most, int(ends[row + 1]))]
                yield row, begin - int(ends[row]), piece, np.array([0, len(piece)])
            row += 1
            continue
        stop = min(max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1), n)
        yield row, 0, raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def _fresh(batch: pa.RecordBatch, sent: set[bytes]) -> pa.RecordBatch:
    """The batch without texts that this task has seen: whatever such a text holds is repeated, and removed as a copy."""
    keep = []
    for i, key in enumerate(batch.column(0).to_pylist()):
        if key not in sent:
            if len(sent) >= REMEMBERED:
                sent.clear()
            sent.add(key)
            keep.append(i)
    return batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int32()))


def suffix_arrays(texts: DataFrame, batches: int, buckets: int) -> tuple[DataFrame, str]:
    """(batch, lead, key, n): for every batch of texts (text_key, data) its distinct suffixes and how often each occurs, in a table of that name.

    The suffixes of a batch are dealt to ``buckets`` arrays, each sorted by lead and key. One pass over the texts makes the arrays of all batches, and counts are added up in the
    tasks first, so that a suffix in a third of all texts comes to its bucket in few rows.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for part in parts:
            fresh = _fresh(part, sent)
            dealt = np.array([k[0] % batches for k in fresh.column(0).to_pylist()], dtype=np.int32)
            for row, _, raw, starts in _texts(fresh.column(1)):
                e = anchored(raw, starts)
                batch = dealt[e["text"] + row]
                order = np.lexsort((e["key"], e["lead"], batch))
                lead, key, batch = e["lead"][order], e["key"][order], batch[order]
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lead[1:] != lead[:-1]) | (batch[1:] != batch[:-1])])) if len(key) else order
                n = np.diff(np.append(new, len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(batch[new]), pa.array(lead[new]), pa.array(key[new].view(np.int64)), pa.array(n)], names=["batch", "lead", "key", "n"])

    counted = texts.mapInArrow(run, "batch int, lead long, key long, n long").repartition(buckets, "lead", "key").groupBy("batch", "lead", "key").agg(F.sum("n").alias("n"))
    return bucketed(counted.select("lead", "key", "n", "batch"), ["lead", "key"], buckets, parts=["batch"])


class Levels:
    """The index family: suffix arrays, each about twice as large as the next, and the suffixes that have been met twice or more.

    All arrays are dealt to the same buckets, so that a scan or a merge of two walks through a bucket of each in order, and nothing is shuffled.
    """

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.levels: list[tuple[int, DataFrame, str | None]] = []
        self.found: list[DataFrame] = []
        self.merges = 0

    def add(self, array: DataFrame) -> None:
        """Scans a batch's array (lead, key, n) against every level, and then keeps it as a level of its own. Levels of equal size merge before the next batch comes."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, small, name), (_, large, other) = self.levels.pop(), self.levels.pop()
            both = large.join(small.withColumnRenamed("n", "m"), ["lead", "key"], "full_outer")
            merged, new = bucketed(both.select("lead", "key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")), ["lead", "key"], self.buckets)
            self._drop(name, other)
            self.levels.append((2 * size, merged, new))
            self.merges += 1
        scanned = array
        for _, level, _ in self.levels:
            both = scanned.join(level.withColumnRenamed("n", "m"), ["lead", "key"], "left")
            scanned = both.select("lead", "key", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        self.found.append(table(scanned.filter("n > 1").select("key", "n")))
        self.levels.append((1, array, None))

    def repeated(self) -> DataFrame:
        """(key, n): suffixes that occur more than once, and how often: the scan of the last batch that has one counts all before."""
        rows = self.found[0]
        for more in self.found[1:]:
            rows = rows.unionByName(more)
        return rows.groupBy("key").agg(F.max("n").alias("n"))

    def drop(self) -> None:
        self._drop(*(name for _, _, name in self.levels))
        self.levels = []

    @staticmethod
    def _drop(*names: str | None) -> None:
        for name in names:
            if name is not None:
                drop_table(name)


def _filter(keys: DataFrame, size: int) -> np.ndarray:
    """A bit for each hashed key, ``size`` in all, a power of two."""
    words = keys.select(F.pmod(F.col("key"), F.lit(size)).alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))
    packed = words.groupBy((F.col("at") / 4096).cast("int").alias("part")).agg(F.collect_list("at").alias("at"), F.collect_list("bits").alias("bits"))
    out = np.zeros(size // 64, dtype=np.int64)
    for r in packed.toLocalIterator():
        out[r["at"]] = r["bits"]
    return out


_WINDOWS = "key long, context long, text_key binary, first int, size int, core int, data binary"


def _matched_windows(texts: DataFrame, repeated: DataFrame, filtered: int) -> DataFrame:
    """Rows (key, context, text_key, first, size, core, data) for the suffixes in ``repeated``, and for those that its filter takes for them.

    data holds the bytes that the suffix's windows cover, size of them from first on, and context is their hash; data is null where a task has sent the same before.
    Up to ``filtered`` matched suffixes are found by a filter; more than that are joined with the texts' suffixes, gathered by text, and joined with the texts.
    """
    known = repeated.count()
    if known > filtered:

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent: set[bytes] = set()
            for batch in batches:
                batch = _fresh(batch, sent)
                for row, _, raw, starts in _texts(batch.column(1)):
                    e = anchored(raw, starts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(e["text"] + row)), pa.array(e["key"].view(np.int64))], names=["text_key", "key"])

        held = texts.mapInArrow(place, "text_key binary, key long").join(repeated, "key", "left_semi")
        texts = texts.join(held.groupBy("text_key").agg(F.collect_set("key").alias("held")), "text_key")
        shared = None
    else:
        shared = texts.sparkSession.sparkContext.broadcast(_filter(repeated, 1 << max(6, (8 * known).bit_length())))

    def hits(batch: pa.RecordBatch, row: int, e: dict[str, np.ndarray]) -> np.ndarray:
        if shared is None:
            part = batch.column(2).slice(row, int(e["text"].max(initial=-1)) + 1)
            return np.flatnonzero(np.isin(e["key"].view(np.int64), part.flatten().to_numpy(zero_copy_only=False)))
        bits = shared.value.view(np.uint64)
        bit = e["key"] & _U(64 * len(bits) - 1)
        return np.flatnonzero((bits[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, contexts = set(), set()
        for batch in batches:
            batch = _fresh(batch, sent)
            for row, offset, raw, starts in _texts(batch.column(1)):
                e = anchored(raw, starts)
                hit = hits(batch, row, e)
                if not len(hit):
                    continue
                begin, end = e["first"][hit], e["last"][hit] + MATCH
                context = (_hash(_totals(raw), begin, end) ^ mix(e["key"][hit])).view(np.int64)
                data: list[bytes | None] = []
                for b, c, x in zip(begin.tolist(), end.tolist(), context.tolist(), strict=True):
                    if x in contexts:
                        data.append(None)
                    else:
                        if len(contexts) >= REMEMBERED:
                            contexts.clear()
                        contexts.add(x)
                        data.append(raw[b:c].tobytes())
                names = batch.column(0).take(pa.array(e["text"][hit] + row))
                columns = [pa.array(e["key"][hit].view(np.int64)), pa.array(context), names, pa.array((begin - starts[e["text"][hit]] + offset).astype(np.int32)), pa.array((end - begin).astype(np.int32)), pa.array(e["core"][hit].astype(np.int32)), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "context", "text_key", "first", "size", "core", "data"])

    return texts.mapInArrow(run, _WINDOWS)


def _window_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows in pieces of bytes: hash, piece, and place in the piece."""
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    total = _totals(np.frombuffer(b"".join(data), dtype=np.uint8))
    count = sizes - MATCH + 1
    piece = np.repeat(np.arange(len(data)), count)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    at = place + np.repeat(np.cumsum(sizes) - sizes, count)
    return _hash(total, at, at + MATCH), piece, place


def _spans(piece: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive places of a piece: piece, first and last."""
    if not len(piece):
        return piece, place, place
    new = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)]))
    last = np.append(new[1:], len(piece)) - 1
    return piece[new], place[new], place[last]


_SPAN = "text_key binary, start int, stop int"


def _compare(windows: DataFrame) -> DataFrame:
    """Spans (text_key, start, stop) of windows that occur twice. Rows of a key are dealt to one task in order, and whole keys are compared at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            first, size = t.column("first").to_numpy(), t.column("size").to_numpy()
            _, which, count = np.unique(t.column("context").to_numpy(), return_inverse=True, return_counts=True)
            # All windows of a context that comes twice repeat; those of the others are compared, one row for each context that has bytes.
            again = np.flatnonzero(count[which] > 1)
            given = np.flatnonzero(t.column("data").is_valid().to_numpy(zero_copy_only=False))
            given = given[np.unique(which[given], return_index=True)[1]]
            hashes, piece, place = _window_hashes(t.column("data").take(pa.array(given)).to_pylist())
            order = np.argsort(hashes, kind="stable")
            same = hashes[order][1:] == hashes[order][:-1]
            twice = np.zeros(len(hashes), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            twice &= count[which[given[piece]]] == 1
            piece, begin, end = _spans(piece[twice], place[twice])
            row = np.concatenate([again, given[piece]])
            start = np.concatenate([first[again], first[given[piece]] + begin])
            stop = np.concatenate([first[again] + size[again], first[given[piece]] + end + MATCH])
            names = t.column("text_key").take(pa.array(row)).combine_chunks()
            return pa.RecordBatch.from_arrays([names, pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["text_key", "start", "stop"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                held.append(part)
                size += part.nbytes
                if size >= COMPARED:
                    keys = pa.Table.from_batches(held).column("key").to_numpy()
                    cut = int(np.searchsorted(keys, keys[-1]))
                    if cut:
                        whole = pa.Table.from_batches(held).combine_chunks()
                        yield compared(whole.slice(0, cut).to_batches())
                        held = whole.slice(cut).to_batches()
                        size = sum(b.nbytes for b in held)
        if held:
            yield compared(held)

    dealt = windows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, _SPAN)


_PIECE = "context long, n long, text_key binary, stretch int, shared long, whole long, start int, stop int"


def _stretches(contexts: DataFrame) -> DataFrame:
    """Each STRETCH of a context's windows, counted back from its suffix: from where to where it goes, the fingerprint of the bytes that all windows of that stretch hold, and that of all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                core, first, data = part.column("core").to_numpy(), part.column("first").to_numpy(), part.column("data").to_pylist()
                sizes = np.array([len(d) for d in data], dtype=np.int64)
                low, high = (core - (sizes - MATCH)) // STRETCH, core // STRETCH
                row = np.repeat(np.arange(len(data)), high - low + 1)
                stretch = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[row]
                total, base = _totals(np.frombuffer(b"".join(data), dtype=np.uint8)), (np.cumsum(sizes) - sizes)[row]
                tag = mix(part.column("key").to_numpy().astype(np.int64).view(np.uint64)[row] + stretch.astype(np.uint64))
                begin = base + core[row] - STRETCH * stretch
                shared = mix(tag ^ _hash(total, begin, begin + MATCH - STRETCH + 1))
                start = np.maximum(core[row] - STRETCH * stretch - STRETCH + 1, 0)
                stop = np.minimum(core[row] - STRETCH * stretch + MATCH, sizes[row])
                whole = mix(tag ^ _hash(total, base + start, base + stop) ^ mix((core[row] - start).astype(np.uint64)))
                same = [part.column(c).take(pa.array(row)) for c in ("context", "n", "text_key")]
                made = [pa.array(stretch.astype(np.int32)), pa.array(shared.view(np.int64)), pa.array(whole.view(np.int64)), *(pa.array((first[row] + x).astype(np.int32)) for x in (start, stop))]
                yield pa.RecordBatch.from_arrays([*same, *made], names=["context", "n", "text_key", "stretch", "shared", "whole", "start", "stop"])

    return contexts.select("context", "n", "text_key", "key", "first", "core", "data").mapInArrow(run, _PIECE)


def _often(rows: DataFrame, column: str) -> DataFrame:
    """Values that come twice or more, as a table."""
    return table(rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(column))


def _compare_hot(windows: DataFrame) -> DataFrame:
    """As _compare, for suffixes that occur very often.

    A context that comes twice repeats as a whole. Of the distinct ones, stretches of windows whose shared bytes occur once are left out, and equal stretches repeat as a whole;
    the windows of one of each of the others are counted by their hashes. All counts are partial sums, and tables, so that the joins with them are between two shuffles, of which
    Spark splits the skewed parts.
    """
    one = F.first(F.when(F.col("data").isNotNull(), F.struct("key", "text_key", "first", "core", "data")), ignorenulls=True)
    contexts = table(windows.groupBy("context").agg(F.count(F.lit(1)).alias("n"), one.alias("one")).select("context", "n", "one.*"))
    again = windows.join(table(contexts.filter("n > 1").select("context")), "context").select("text_key", F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("stop"))
    pieces = table(_stretches(contexts))
    pieces = table(pieces.join(_often(pieces, "shared"), "shared"))
    equal = pieces.filter("n = 1").join(_often(pieces, "whole"), "whole").select("text_key", "start", "stop")
    left = pieces.groupBy("whole").agg(F.min(F.struct("context", "stretch")).alias("one")).groupBy("one.context").agg(F.collect_set("one.stretch").alias("stretches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                hashes, piece, place = _window_hashes(part.column("data").to_pylist())
                stretch = (part.column("core").to_numpy()[piece] - place) // STRETCH
                lists = part.column("stretches")
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                keep = np.flatnonzero(np.isin(piece * MATCH + stretch, owner * MATCH + lists.flatten().to_numpy()))
                piece = piece[keep]
                start = part.column("first").to_numpy()[piece] + place[keep]
                columns = [pa.array(hashes[keep].view(np.int64)), part.column("n").take(pa.array(piece)), part.column("text_key").take(pa.array(piece)), pa.array(start.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["hash", "n", "text_key", "start"])

    each = table(contexts.join(left, "context").select("n", "text_key", "first", "core", "data", "stretches").mapInArrow(run, "hash long, n long, text_key binary, start int"))
    some = each.filter("n = 1").join(_often(each, "hash"), "hash").select("text_key", "start", (F.col("start") + MATCH).alias("stop"))
    return some.unionByName(equal).unionByName(again)


def remove_repeats(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), batches: int = BATCHES) -> DataFrame:
    """For every row of ``docs``: ``keep``'s columns, n_bytes, n_removed, n_spans (long), ``kept`` (binary, the bytes that are left) and removed (array of start and stop).

    A byte goes if a string of MATCH bytes that also starts elsewhere, in the same text or another, covers it; strings are judged on the input. Texts are UTF-8 bytes, a null
    text is empty, and matches stay within a text. Repeated rows are copies of each other. What is left of a text need not be whole characters. An empty table gives an empty one.
    ``keep`` may have any names; a column of the result that would share one has underscores before its own.
    The corpus is indexed in ``batches`` batches of texts; their number changes no result. An array has as many buckets as a shuffle has partitions.
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*keep).alias("row"), data.alias("data"))
    rows = rows.withColumn("text_key", F.unhex(F.md5("data")))
    texts = rows.select("text_key", "data")
    index = Levels(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    arrays, name = suffix_arrays(texts, batches, index.buckets)
    for i in range(batches):
        index.add(arrays.filter(F.col("batch") == i).drop("batch"))
    repeated = table(index.repeated())
    index.drop()
    drop_table(name)
    windows = _matched_windows(texts, repeated, FILTERED)
    hot = repeated.filter(F.col("n") > HOT).select("key")
    if hot.isEmpty():
        spans = _compare(windows)
    else:
        # From the table's size the plan decides how to join the hot keys. The hot windows are a table, for three steps read them; a task has sent equal ones without bytes.
        hot = table(hot)
        spans = _compare(windows.join(hot, "key", "left_anti")).unionByName(_compare_hot(table(windows.join(hot, "key", "left_semi"))))
    marks = spans.groupBy("text_key").agg(F.collect_set(F.struct("start", "stop")).alias("marks"))
    copies = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    notes = marks.join(copies, "text_key", "full_outer").select("text_key", "marks", F.col("copies").isNotNull().alias("copied"))
    joined = rows.join(notes, "text_key", "left").select("row", "data", "marks", F.coalesce("copied", F.lit(False)).alias("copied"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for text, marks, copied in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                n = len(text)
                spans = [(0, n)] if copied and n >= MATCH else sorted((m["start"], m["stop"]) for m in marks or ())
                merged: list[list[int]] = []
                for start, stop in spans:
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], stop)
                    else:
                        merged.append([start, stop])
                edges = [0, *(x for m in merged for x in m), n]
                left = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                out.append((n, n - len(left), len(merged), left, [{"start": a, "stop": b} for a, b in merged]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["row", *names])

    names = ("n_bytes", "n_removed", "n_spans", "kept", "removed")
    out = joined.mapInArrow(run, f"row {joined.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start:int,stop:int>>")
    return out.select("row.*", *[F.col(n).alias(spare(list(keep), n)) for n in names])


def digest(out: DataFrame) -> DataFrame:
    """Counts and a digest of what remove_repeats left."""
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
