"""Encoding and decoding with a sentencepiece BPE model, with every piece traced to the bytes it came from.

The normaliser looks up the longest prefix in the model's compiled character map and notes, for every normalised character, the bytes of the text behind it.
Pieces then follow from merges within words: no piece of such a model runs from a word into the space after it, so words are independent and can be cached.
"""

from __future__ import annotations

import array
import functools
import heapq
import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import spare

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The rank of pairs that never merge.
NEVER = 1 << 30
#: Words kept in a worker's cache, and the longest word that goes there.
CACHE_WORDS, CACHE_CHARS = 200_000, 40
#: Rows in an Arrow batch, so that a batch of long texts fits in a worker.
BATCH_ROWS = 200


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


def character_map(compiled: bytes) -> dict[bytes, bytes]:
    """The replacements in a compiled character map: a double-array trie over UTF-8 bytes, then its strings, each ended by a zero byte."""
    if not compiled:
        return {}
    (size,) = struct.unpack_from("<I", compiled)
    units, strings = struct.unpack_from(f"<{size // 4}I", compiled, 4), compiled[4 + size :]
    out: dict[bytes, bytes] = {}
    step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    todo = [(step(units[0]), b"")]
    while todo:
        node, prefix = todo.pop()
        for byte in range(1, 256):
            at = node ^ byte
            if at < len(units) and units[at] & 0x800000FF == byte:
                word, child = prefix + bytes([byte]), at ^ step(units[at])
                if units[at] >> 8 & 1:
                    begin = units[child] & 0x7FFFFFFF
                    out[word] = strings[begin : strings.index(b"\0", begin)]
                todo.append((child, word))
    return out


@dataclass
class Model:
    """A parsed model: its pieces and the rules of its normaliser."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    charmap: dict[bytes, bytes] = field(default_factory=dict)
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                out.pieces.append(piece[1].decode())
                out.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                out.kinds.append(piece.get(3, NORMAL))
            elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("only BPE models are supported")
            elif number == 3:
                rules = dict(_fields(value))
                out.charmap = character_map(rules.get(2, b""))
                out.dummy_prefix, out.trim_spaces, out.escape_spaces = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        inner = [p for p, k in zip(out.pieces, out.kinds, strict=True) if k == NORMAL and SPACE in p.lstrip(SPACE)]
        if inner or not out.escape_spaces or USER in out.kinds or UNUSED in out.kinds:
            raise ValueError("models with pieces across spaces, plain spaces, user-defined or unused pieces aren't supported")
        return out


class Codec:
    """Encodes and decodes as the sentencepiece library does, for BPE models that Model.parse accepts."""

    def __init__(self, data: bytes):
        m = self.model = Model.parse(data)
        self.ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k == NORMAL}
        order = {score: i for i, score in enumerate(sorted(set(m.scores), reverse=True))}
        self.rank = {p: order[m.scores[i]] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k == BYTE}
        self.unknown = m.kinds.index(UNKNOWN)
        self.end = m.pieces.index("</s>")
        self.longest = max(map(len, m.charmap), default=0)
        self.raw = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]
        if BYTE not in m.kinds:
            raise ValueError("without byte pieces the length of an unknown piece can't be told")
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(m.pieces, m.kinds, strict=True)], dtype=np.int64)
        self.cache: dict[str, bytes] = {}

    # Normalising.

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text, and for each of its UTF-8 bytes, and the end, the byte of ``text`` it came from; None where both advance alike.

        At each place the longest entry of the character map that is a prefix of what is left is replaced, and everything it yields is aligned with its first byte.
        """
        m = self.model
        if not text:
            return "", None
        if not m.charmap and not m.trim_spaces:
            return (SPACE if m.dummy_prefix else "") + text.replace(" ", SPACE), None
        raw = text.encode("utf-8", "replace")
        out, source, at = bytearray(), [], 0
        while at < len(raw):
            for size in range(min(self.longest, len(raw) - at), 0, -1):
                if (new := m.charmap.get(raw[at : at + size])) is not None:
                    break
            else:
                size = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                new = raw[at : at + size]
            whole = size == len(new) and new == raw[at : at + size]
            out += new
            source += range(at, at + size) if whole else [at] * len(new)
            at += size
        source.append(len(raw))
        if m.trim_spaces:
            end = len(out.rstrip(b" "))
            keep = [i for i, c in enumerate(out) if c != 32 or (0 < i < end and out[i - 1] != 32)]
            out, source = bytearray(out[i] for i in keep), [source[i] for i in keep] + [source[keep[-1] + 1] if keep else 0]
        mark = SPACE.encode()
        final, origin = bytearray(), []
        if m.dummy_prefix and out:
            final, origin = bytearray(mark), [source[0]] * 3
        for byte, place in zip(out, source, strict=False):
            new = mark if byte == 32 else bytes([byte])
            final += new
            origin += [place] * len(new)
        return final.decode("utf-8", "replace"), [*origin, source[-1]]

    # Pieces.

    def _merge(self, word: str) -> list[str]:
        """The pieces of a word: the best-scored pair of neighbours merges first, the leftmost of equals."""
        parts = list(word)
        if len(parts) > 48:
            return self._merge_long(parts)
        rank = self.rank.get
        best = [rank(a + b, NEVER) for a, b in itertools.pairwise(parts)]
        while best and (low := min(best)) < NEVER:
            i = best.index(low)
            new = parts[i] = parts[i] + parts[i + 1]
            del parts[i + 1], best[i]
            if i < len(best):
                best[i] = rank(new + parts[i + 1], NEVER)
            if i:
                best[i - 1] = rank(parts[i - 1] + new, NEVER)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """As _merge, with a heap: for long words."""
        rank, n = self.rank, len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (r := rank.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return [p for p in parts if p]

    def word(self, word: str) -> bytes:
        """The ids of a word's pieces, four bytes each; a piece that the model lacks gives an id for each of its bytes."""
        ids: list[int] = []
        for piece in self._merge(word):
            if (known := self.ids.get(piece)) is not None:
                ids.append(known)
            else:
                ids += [self.bytes[b] for b in piece.encode("utf-8", "replace")]
        return array.array("i", ids).tobytes()

    def words(self, normalised: str) -> list[bytes]:
        """The ids of each word, where a word takes the spaces before it. The cache is keyed by words less their first space."""
        if not normalised.startswith(SPACE):
            normalised, head = normalised[(normalised + SPACE).index(SPACE) :], self.word(normalised.partition(SPACE)[0])
        else:
            head = b""
        cut = normalised[1:].split(SPACE) if normalised else []
        if "" in cut:
            joined, spaces = [], 0
            for word in cut:
                if word:
                    joined.append(SPACE * spaces + word)
                    spaces = 0
                else:
                    spaces += 1
            cut = [*joined, SPACE * (spaces - 1)] if spaces else joined
        found = list(map(self.cache.get, cut))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    word = cut[i]
                    if (ids := self.cache.get(word)) is None:
                        ids = self.word(SPACE + word)
                        if len(word) <= CACHE_CHARS:
                            if len(self.cache) >= CACHE_WORDS:
                                self.cache.clear()
                            self.cache[word] = ids
                    found[i] = ids
        return [head, *found]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids with an end id, and the bytes of ``text`` at which the pieces begin, with the text's length last for the end id.

        A piece's span runs from its own begin to the next one's; the dummy prefix's bytes are none of the text's.
        """
        normalised, origin = self.normalise(text)
        ids = np.frombuffer(b"".join(self.words(normalised)), dtype=np.int32)
        begins = self.project(normalised, text, self.sizes[ids], origin)
        return np.append(ids, np.int32(self.end)), begins

    def project(self, normalised: str, text: str, sizes: np.ndarray, origin: list[int] | None) -> np.ndarray:
        """Where pieces of ``sizes`` normalised bytes begin in the bytes of ``text``."""
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        if origin is not None:
            return np.array(origin, dtype=np.int32)[ends]
        # Without a character map only spaces differ: three bytes of a mark stand for one of a space, and the dummy prefix for none.
        raw = np.frombuffer(normalised.encode("utf-8", "replace"), dtype=np.uint8)
        marks = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)) if len(raw) > 2 else np.zeros(0, np.int64)
        spaces = marks
        if SPACE in text:
            own = np.frombuffer(text.encode("utf-8", "replace").replace(SPACE.encode(), b"\xff"), dtype=np.uint8)
            first = int(self.model.dummy_prefix)
            spaces = np.concatenate([marks[:first], marks[first:][own[(own == 32) | (own == 0xFF)] == 32]])
        shift = 2 * np.searchsorted(spaces, ends) + (self.model.dummy_prefix and len(raw) > 0) * (ends > 0)
        return np.maximum(ends - shift, 0).astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: control ids give nothing, and the space of a dummy prefix goes."""
        out = b"".join(map(self.raw.__getitem__, ids))
        first = next((i for i in ids if self.raw[i]), None)
        if first is not None and self.model.kinds[first] == NORMAL and (self.model.dummy_prefix or self.model.trim_spaces) and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a model file; one for each worker process."""
    with open(path, "rb") as file:
        return Codec(file.read())


def encode(docs: DataFrame, model_path: str, *, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``id_cols`` of every row with its ``ids`` (array of int, an end id last), ``begins`` and ``decoded``.

    ``begins`` holds, for each id, the byte of the UTF-8 text at which its piece begins, and the text's length for the end id. ``decoded`` is decode(ids).
    A null text counts as empty: its only id is the end id. Every row is encoded whole and by itself; repeated rows give equal results.
    ``id_cols`` may have any names; a column of the result that would share one has underscores before its own.
    ``model_path`` must be readable on every executor, as an installed file is. Batches are small, and the words' cache is bounded.
    """
    kept = docs.select(*id_cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    names = [spare(list(id_cols), name) for name in ("ids", "begins", "decoded")]
    schema += "".join(f", `{name}` {kind}" for name, kind in zip(names, ("array<int>", "array<int>", "string"), strict=True))
    n = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                done = [use.encode(text or "") for text in part.column(n).to_pylist()]
                offsets = np.cumsum([0, *(len(ids) for ids, _ in done)], dtype=np.int32)
                flat = [pa.ListArray.from_arrays(offsets, np.concatenate(x)) for x in zip(*done, strict=True)]
                made = [*flat, pa.array([use.decode(ids.tolist()) for ids, _ in done], pa.string())]
                columns = [part.column(i) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*id_cols, *names])

    return docs.select(*id_cols, F.col(text_col).cast("string")).mapInArrow(run, schema)


def digest(encoded: DataFrame) -> DataFrame:
    """Counts and digests of encoded rows."""
    line: Column = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(line.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.element_at("begins", -1).cast("long").alias("n_bytes"),
    )
