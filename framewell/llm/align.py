"""Alignment of two tokenizers' tokens of the same texts, and how often ids of one go with ids of the other over the whole corpus.

Both must split a text's bytes without loss and never join what a single space parts, as byte-level BPE (A) and sentencepiece BPE with byte pieces (B) do. A text is then cut into units at
single spaces between plain characters: both have an end there, so a unit's alignment is the same wherever it stands, and frequent ones are remembered.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import table
from .sentencepiece_codec import BYTE, SPACE, Model

#: Units that a worker remembers, bytes of theirs, and the longest of them.
CACHE_UNITS, CACHE_BYTES, CACHE_CHARS = 300_000, 8 << 20, 40
#: Rows and bytes of text of an Arrow batch, unless one text is longer; units that are aligned together; and bytes of text in a block, whose pairs of ids are counted and looked up together.
BATCH_ROWS, BATCH_BYTES, BATCH_UNITS, BLOCK_BYTES = 200, 4 << 20, 20_000, 8 << 20
#: A pair of ids as one number: A's shifted by this, and B's.
SHIFT = 32
#: Fixed value: how byte-level pre-tokenizers split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A single space between plain characters, which are letters, digits and printable ASCII; a unit with such characters at both ends; and a character whose class may change.
CUT, EDGES, UNSURE = re.compile(r" (?<=[\w!-~] )(?=[\w!-~])"), re.compile(r"(?s)[\w!-~](.*[\w!-~])?"), re.compile("[^\0-\u024f]")
#: What is held of a unit: tokens of A and of B, groups, bytes, where its groups begin, and how often it was met. A unit that is not aligned has no groups.
N_A, N_B, GROUPS, BYTES, START, USES = range(6)


def byte_table() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others for 256 and on in their order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the units seen lately.

    A batch's new units are aligned together in arrays, so that no token is a step of Python. ``seen`` gives a unit's place in ``rows`` and ``names``; ``pairs`` and ``ends`` hold its groups' pairs
    of ids and ends in bytes, from its start.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_b, "rb") as file:
            model = Model.parse(file.read())
        if not model.dummy_prefix or model.trim_spaces or model.charmap:
            raise ValueError("the second tokenizer must keep the text as it is and put a space before it")
        of = byte_table()
        bytes_a = [bytes(of[c] for c in self.a.id_to_token(i)) if all(c in of for c in self.a.id_to_token(i)) else self.a.id_to_token(i).encode() for i in range(self.a.get_vocab_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.large_binary()), pa.array(bytes_b, pa.large_binary())
        self.ranked = self._ranked(path_a, bytes_a)
        self.quick = self.ranked and self.ranked.encode_ordinary
        # An id in a group's text, with what follows it: A's inside a group, A's last, B's inside, B's last.
        self.text = pa.array([f"{i}{after}" for n, ends in ((len(bytes_a), ",|"), (len(bytes_b), ",;")) for after in ends for i in range(n)], pa.large_binary())
        self.seen: dict[str, int] = {}
        self.names: list[str] = []
        self.rows, self.pairs, self.ends = np.zeros((0, 6), np.int64), _NONE, _NONE
        self.groups = self.held = 0

    def _ranked(self, path: str, parts: list[bytes]):
        """A faster encoder for A's vocabulary, if its ids follow the order of its merges, so that ranks give the same tokens; it is used on letters whose classes never change."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
        if not plain or [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))):
            return None
        import tiktoken

        ranks = {parts[i]: i for i in range(256 + len(merged))}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def cut(self, text: str) -> list[str]:
        """A text's units. Single spaces part them if a letter, a digit or plain punctuation stands on both sides; all other spaces stay inside."""
        return CUT.split(text)

    def encode_a(self, joint: list[str], alone: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of a space and each unit, one unit after the other, and how many each has. The ``joint`` units, of ``sizes`` bytes with their spaces, are one text to the faster encoder."""
        ids = np.zeros(0, np.int64)
        if joint:
            ids = self.ranked.encode_to_numpy(" " + " ".join(joint), disallowed_special=()).astype(np.int64)
        to = np.searchsorted(_joined(self.bytes_a, ids)[1], np.cumsum(sizes[: len(joint)]))
        lists = [self.quick(" " + u) if self.quick and not UNSURE.search(u) else self.a.encode(" " + u, add_special_tokens=False).ids for u in alone]
        return np.concatenate([ids, *(np.array(x, np.int64) for x in lists)]), np.concatenate([np.diff(to, prepend=0), np.fromiter(map(len, lists), np.int64, len(lists))])

    def learn(self, new: list[str]) -> None:
        """Aligns units that are not remembered.

        All their tokens are laid end to end. Ends of A are looked up among those of B; the common ones cut both into groups, of which the last tokens end together, and so they are its link.
        Where the tokens' bytes differ from a space and the unit, the unit has no groups.
        """
        joins = [False] * len(new) if self.ranked is None else [EDGES.fullmatch(u) is not None and not UNSURE.search(u) for u in new]
        joint, alone = list(itertools.compress(new, joins)), [u for u, x in zip(new, joins, strict=True) if not x]
        new = joint + alone
        raw = [(" " + u).encode() for u in new]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        a, n_a = self.encode_a(joint, alone, sizes)
        lists = self.b.encode(new, num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(itertools.chain.from_iterable(lists), np.int64, n_b.sum())
        held, to = sizes, np.cumsum(sizes)
        made = [_joined(self.bytes_a, a), _joined(self.bytes_b, b)]
        if any(text != b"".join(raw) or np.any(at[np.cumsum(n)] != to) for (text, at), n in zip(made, (n_a, n_b), strict=True)):
            right = np.ones(len(new), bool)
            for (text, at), n in zip(made, (n_a, n_b), strict=True):
                edges = at[np.cumsum(n)].tolist()
                right &= [text[x:y] == r for x, y, r in zip([0, *edges], edges, raw, strict=False)]
            a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
            n_a, n_b, sizes = (np.where(right, x, 0) for x in (n_a, n_b, sizes))
            to = np.cumsum(sizes)
            made = [_joined(self.bytes_a, a), _joined(self.bytes_b, b)]
        ends_a, ends_b = (at[1:] for _, at in made)
        at = np.searchsorted(ends_b, ends_a)
        last_a = ends_b[at] == ends_a
        i, j = np.flatnonzero(last_a), at[last_a]
        last_b = np.zeros(len(b), bool)
        last_b[j] = True
        # A group's tokens of A stand after those of B of the groups before it, and its tokens of B after its tokens of A.
        group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], j + 1])[group_a]] = a + last_a * len(self.bytes_a)
        order[np.arange(len(b)) + (i + 1)[group_b]] = 2 * len(self.bytes_a) + b + last_b * len(self.bytes_b)
        text, place = _joined(self.text, order)
        text, edges = text.decode(), place[np.cumsum(n_a + n_b)].tolist()
        self.names += [text[x : max(x, y - 1)] for x, y in zip([0, *edges], edges, strict=False)]
        ends = ends_a[i]
        n = np.diff(np.searchsorted(ends, to, side="right"), prepend=0)
        rows = np.stack([n_a, n_b, n, held, self.groups + np.cumsum(n) - n, np.zeros_like(n)], axis=1)
        self.rows = _put(self.rows, len(self.seen), rows)
        self.pairs = _put(self.pairs, self.groups, a[i] << SHIFT | b[j])
        self.ends = _put(self.ends, self.groups, ends - np.repeat(to - sizes, n))
        self.groups, self.held = self.groups + len(i), self.held + int(held.sum())
        self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new)), strict=True))

    def forget(self) -> None:
        """Keeps short units that were met more than once lately, at most half of what may be held."""
        units, used = list(self.seen), self.rows[: len(self.seen), USES]
        kept = np.flatnonzero((used > 1) & np.fromiter((len(u) <= CACHE_CHARS for u in units), bool, len(units)))
        kept = kept[np.argsort(-used[kept], kind="stable")]
        total = np.cumsum(self.rows[kept, BYTES])
        kept = kept[: min(CACHE_UNITS // 2, int(np.searchsorted(total, CACHE_BYTES // 2, side="right")))]
        self.rows = self.rows[kept]
        self.rows[:, USES] >>= 1
        n = self.rows[:, GROUPS]
        at = _slices(self.rows[:, START], n)
        self.pairs, self.ends, self.groups, self.held = self.pairs[at], self.ends[at], len(at), int(self.rows[:, BYTES].sum())
        self.rows[:, START] = np.cumsum(n) - n
        kept = kept.tolist()
        self.names = [self.names[i] for i in kept]
        self.seen = {units[i]: to for to, i in enumerate(kept)}

    def places(self, units: list[str]) -> np.ndarray:
        """The units' places, after learning the new ones."""
        if len(self.seen) > CACHE_UNITS or self.held > CACHE_BYTES:
            self.forget()
        at = np.fromiter(map(self.seen.get, units, itertools.repeat(-1)), np.int64, len(units))
        if len(missing := np.flatnonzero(at < 0)):
            names = [units[i] for i in missing.tolist()]
            new = list(dict.fromkeys(names))
            for k in range(0, len(new), BATCH_UNITS):
                self.learn(new[k : k + BATCH_UNITS])
            at[missing] = list(map(self.seen.__getitem__, names))
        self.rows[: len(self.seen), USES] += np.bincount(at, minlength=len(self.seen))
        return at

    def documents(self, texts: list[str | None], with_ends: bool) -> list[tuple]:
        """For each text, tokens of A and B, groups, their number, distinct pairs, how often each occurs, and the groups' ends, if asked for; of one that is not aligned, nothing."""
        cut = [self.cut(t) if t else [] for t in texts]
        at = self.places(list(itertools.chain.from_iterable(cut)))
        rows, names = self.rows[at], list(map(self.names.__getitem__, at.tolist()))
        first = np.cumsum([0, *map(len, cut)])
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(rows[:, :START], axis=0)])[first]
        void = np.concatenate([[0], np.cumsum(rows[:, GROUPS] == 0)])[first]
        picks = _slices(rows[:, START], rows[:, GROUPS])
        pairs, ends = self.pairs[picks], _NONE
        if with_ends:
            ends = self.ends[picks] + np.repeat(np.cumsum(rows[:, BYTES]) - rows[:, BYTES], rows[:, GROUPS])
        out = []
        for k, (n_a, n_b, n, _) in enumerate(np.diff(sums, axis=0).tolist()):
            if void[k + 1] > void[k] or not n:
                out.append((0, 0, "", 0, _NONE, _NONE, _NONE))
                continue
            begin, end = sums[k, GROUPS], sums[k + 1, GROUPS]
            distinct, times = np.unique(pairs[begin:end], return_counts=True)
            where = ends[begin:end] - sums[k, BYTES] if with_ends else _NONE
            out.append((n_a, n_b, ";".join(names[first[k] : first[k + 1]]), n, distinct, times, where))
        return out


_NONE = np.zeros(0, np.int64)


def _joined(table: pa.Array, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The entries of ``ids`` in one, and where each begins, with the end of the last."""
    taken = table.take(pa.array(ids))
    at = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]
    return memoryview(taken.buffers()[2])[: at[-1]].tobytes() if len(ids) else b"", at if len(ids) else np.zeros(1, np.int64)


def _slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all slices that begin at ``starts``, one slice after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of rows of ``sizes`` bytes for an Arrow batch each."""
    at = total = 0
    for to, size in enumerate(sizes):
        if to > at and (to - at == BATCH_ROWS or total + size > BATCH_BYTES):
            yield at, to
            at, total = to, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def _put(held: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """``held`` with ``new`` after its first ``used`` rows, in twice the room where it must grow."""
    need = used + len(new)
    if need > len(held):
        held = np.concatenate([held[:used], np.empty((need, *held.shape[1:]), held.dtype)])
    held[used:need] = new
    return held


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process."""
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str, *, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", with_ends: bool = False) -> DataFrame:
    """For every row ``row`` (its ``id_cols``), n_a, n_b, n_groups, ``groups`` (A's ids, a bar and B's ids, groups parted by semicolons), distinct ``pairs`` of linked ids (A's shifted by
    32 bits, and B's) with ``times``, the row's ``block``, and, where asked for, ``ends``, the groups' ends in bytes of the text with a space before it.

    Texts that are null or empty, or that the tokenizers do not give back byte by byte, have no tokens: zeros, an empty text and empty lists. Every text is read whole; repeated rows give
    equal results. The paths must be readable on every executor, as installed files are. ``id_cols`` may have any names.
    """
    kept = docs.select(F.struct(*id_cols).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = f"row {kept.schema['row'].dataType.simpleString()}, n_a long, n_b long, groups string, n_groups long, pairs array<bigint>, times array<bigint>, ends array<bigint>, block long"
    names = [part.split()[0] for part in ("row", "n_a", "n_b", "groups", "n_groups", "pairs", "times", "ends", "block")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, task, read = aligner(path_a, path_b), TaskContext.get(), 0
        first = (task.partitionId() if task else 0) << 32
        for batch in batches:
            for at, to in _parts(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
                part = batch.slice(at, to - at)
                texts = part.column(1).to_pylist()
                n_a, n_b, groups, n_groups, *lists = zip(*use.documents(texts, with_ends), strict=True)
                blocks = (np.cumsum([read, *(len(t or "") for t in texts)])[:-1] // BLOCK_BYTES) + first
                read += sum(len(t or "") for t in texts)
                arrays = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)], dtype=np.int32), np.concatenate(x).astype(np.int64)) for x in lists]
                numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b)]
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers, pa.array(groups, pa.string()), pa.array(n_groups, pa.int64()), *arrays, pa.array(blocks, pa.int64())], names=names)

    return kept.mapInArrow(run, schema)


def link_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs of each block, and, over the whole corpus, how often each pair is linked (``n``) and whether no other pair of its B id is linked more often (``best``).

    Counts are summed in each task, then by block, then by pair; the pairs of a B id, of which the best is taken, are as many as A has ids.
    """
    pair = F.explode(F.arrays_zip("pairs", "times")).alias("x")
    blocks = table(aligned.select("block", pair).groupBy("block", F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("k")))
    counts = blocks.groupBy("pair").agg(F.sum("k").alias("n"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)))
    return blocks, counts.withColumn("best", F.col("n") == F.max("n").over(of_b))


def scored(aligned: DataFrame) -> DataFrame:
    """Rows of ``align`` with the digest of their groups and, from the corpus-wide counts of their links, n_best and count_sum: row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Every block of documents meets the counts of just its own pairs, so that nothing is broadcast and a frequent pair is one row for each block.
    """
    sha = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    kept = table(aligned.withColumn("groups_sha256", sha).drop("groups", "ends"))
    blocks, counts = link_counts(kept)
    known = blocks.join(counts, "pair").select("block", "pair", "n", "best")
    schema = f"row {kept.schema['row'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def look_up(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        keys, n, best = (pairs[c].to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(keys)
        keys, n, best = keys[order], n[order], best[order].astype(bool)
        lists = [docs[c].combine_chunks() for c in ("pairs", "times")]
        flat, times = (x.flatten().to_numpy() for x in lists)
        at = np.searchsorted(keys, flat)
        edges = np.cumsum([0, *pc.list_value_length(lists[0]).to_pylist()])

        def summed(values: np.ndarray) -> pa.Array:
            run = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
            return pa.array(run[edges[1:]] - run[edges[:-1]], pa.int64())

        sums = [summed(times), summed(np.where(best[at], times, 0)), summed(times * n[at])]
        names = ["row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        return pa.Table.from_arrays([*(docs[c] for c in names[:4]), *sums, docs["groups_sha256"]], names=names)

    return kept.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(look_up, schema)


def digest(rows: DataFrame) -> DataFrame:
    """The scored rows with the row's own columns."""
    return rows.select("row.*", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
