"""Licence notices and identifier tags in texts, and what licence expressions ask for.

One automaton finds all phrases and tags in a text's words in one pass. Behind a tag stands an expression of identifiers with and, or and with; a shunting-yard parser turns its longest valid
beginning into postfix order, which is then evaluated.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The phrases that every scan reports, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "dedicated to the public domain": "public-domain",
}
TAG = "spdx license identifier"
#: How much a kind of evidence says.
WEIGHTS = {"tag": 0.95, "base": 0.7, "notice": 0.6}
#: Identifiers by family, with what they ask for: 0 nothing but credit, 1 sharing of changed files, 2 sharing of the whole work, 3 that over networks too or no free use.
FAMILIES = {"mit": 0, "apache": 0, "bsd": 0, "0bsd": 0, "isc": 0, "zlib": 0, "unlicense": 0, "cc0": 0, "cc-by": 0, "bsl": 0, "python": 0, "artistic": 1, "mpl": 1, "epl": 1, "lgpl": 1, "cc-by-sa": 2, "gpl": 2, "agpl": 3, "cc-by-nc": 3, "cc-by-nd": 3, "licenseref": 3}
_FAMILY = sorted(FAMILIES, key=len, reverse=True)
_NAME = re.compile("(?:" + "|".join(map(re.escape, _FAMILY)) + r")(?:-[0-9a-z.-]*[0-9a-z])?\+?")
_EXCEPTION = re.compile(r"[0-9a-z][0-9a-z.-]*exception[0-9a-z.-]*")
_PIECE = re.compile(r"[\x20\t]*(\(|\)|[0-9A-Za-z][0-9A-Za-z.+-]*)")
#: How tightly operators bind.
BINDS = {"or": 1, "and": 2, "with": 3}
#: Letters as they are, capitals lowered, bytes of other characters as they are, all else a space: words are what is left between spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Expression(NamedTuple):
    """A licence expression: as it stands, in postfix order, the identifiers in it, and what it asks for (see FAMILIES)."""

    text: str
    postfix: list[str]
    names: list[str]
    asks: int


def parse(text: str) -> Expression | None:
    """The longest beginning of ``text`` that is an expression, or None.

    Operators wait on a stack until one that binds no tighter follows; ``with`` takes an exception on its right, which counts as part of the identifier on its left.
    """
    out: list[str] = []
    stack: list[str] = []
    best: tuple[int, list[str]] | None = None
    at, before = 0, "("
    while found := _PIECE.match(text, at):
        piece = found[1].lower()
        wanted = before in BINDS or before == "("
        if wanted and before != "with" and piece == "(":
            stack.append(piece)
        elif wanted and (_EXCEPTION if before == "with" else _NAME).fullmatch(piece):
            out.append(piece)
        elif not wanted and piece in BINDS and (piece != "with" or _NAME.fullmatch(before)):
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[piece]:
                out.append(stack.pop())
            stack.append(piece)
        elif not wanted and piece == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
        at, before = found.end(), piece
        if piece not in BINDS and "(" not in stack:
            best = at, out + stack[::-1]
    if best is None:
        return None
    end, postfix = best
    return Expression(text[:end].strip(), postfix, sorted({p for p in postfix if p not in BINDS and not _EXCEPTION.fullmatch(p)}), evaluate(postfix))


def evaluate(postfix: list[str]) -> int:
    """What an expression asks for: the least of what ``or`` offers, the most of what ``and`` joins; an exception takes one off what shares the whole work."""
    values: list[int] = []
    for piece in postfix:
        if piece in BINDS:
            right, left = values.pop(), values.pop()
            values.append({"or": min(left, right), "and": max(left, right), "with": left - 1 if left >= 2 else left}[piece])
        else:
            values.append(next((FAMILIES[f] for f in _FAMILY if piece.startswith(f)), 0))
    return values[0]


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All phrases between spaces; each gives its kind, label and length."""
    out = ahocorasick.Automaton()
    for kind, phrases in (("tag", {TAG: ""}), ("notice", NOTICES), ("base", BASE)):
        for phrase, label in phrases.items():
            out.add_word(f" {phrase} ", (kind, label, len(phrase) + 2, phrase.count(" ") + 1))
    out.make_automaton()
    return out


def scan(raw: bytes) -> tuple[int, list[tuple[str, str, int, int]], list[Expression]]:
    """The number of words, the findings (kind, label, first word and the one behind the last) and the expressions of one text."""
    spaced = raw.translate(_WORDS)
    words = spaced.split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found, tags, seen, at = [], [], 0, 0
    for last, (kind, label, length, size) in automaton().iter(line):
        begin = last + 1 - length
        at += line.count(" ", seen, begin) if begin >= seen else -line.count(" ", begin, seen)
        seen = begin
        (tags if kind == "tag" else found).append((kind, label, at, at + size))
    expressions = []
    if tags:
        closing = {tag[3] - 1: tag for tag in tags}
        for nth, word in enumerate(re.finditer(rb"[^ ]+", spaced)):
            if nth in closing:
                rest = raw[word.end() :].split(b"\n", 1)[0].decode("utf-8", "replace")
                if expression := parse(rest.lstrip(":\"'\t ")):
                    expressions.append(expression)
                    found += [("tag", name, *closing[nth][2:]) for name in expression.names]
    return len(words), found, expressions


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
_EXPRESSIONS = pa.list_(pa.struct([("text", pa.string()), ("postfix", pa.list_(pa.string())), ("names", pa.list_(pa.string())), ("asks", pa.int32())]))


def scan_licenses(docs: DataFrame, *, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """For every row ``row`` (its ``id_cols``), n_words, ``spans`` (kind, label, first word and the one behind the last, from 0) and ``expressions`` (text, postfix, names, asks).

    Words are runs of letters, digits and characters beyond ASCII, capitals A to Z lowered. A null text counts as empty: no word, no span. Phrases may overlap, and each place counts.
    Every text is read whole, once, on its own row; a long one costs its length, a repeated row gives equal results, and an empty table an empty one. ``id_cols`` may have any names.
    """
    kept = docs.select(F.struct(*id_cols).alias("row"), F.col(text_col).cast("string").cast("binary").alias("text"))
    span, expression = "struct<kind:string,label:string,first:bigint,end:bigint>", "struct<text:string,postfix:array<string>,names:array<string>,asks:int>"
    schema = f"row {kept.schema['row'].dataType.simpleString()}, n_words long, spans array<{span}>, expressions array<{expression}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, expressions = [], [], []
            for text in batch.column(1):
                words, found, parsed = scan(text.as_py() or b"")
                n.append(words)
                spans.append([dict(zip(("kind", "label", "first", "end"), f, strict=True)) for f in found])
                expressions.append([e._asdict() for e in parsed])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(expressions, _EXPRESSIONS)], names=["row", "n_words", "spans", "expressions"])

    return kept.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts, places and labels of scanned rows, and a score: how sure it is that the text states a licence, by its distinct pieces of evidence taken as independent."""
    base = F.filter("spans", lambda s: s["kind"] == "base")
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    weight = F.create_map(*[F.lit(v) for item in WEIGHTS.items() for v in item])
    evidence = F.array_sort(F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["label"].alias("label")))))
    doubt = F.aggregate(evidence, F.lit(1.0), lambda left, e: left * (1 - F.element_at(weight, e["kind"])))
    return found.select(
        "row.*",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.round(1 - doubt, 6).alias("score"),
        F.coalesce(F.array_min(F.transform("expressions", lambda e: e["asks"])), F.lit(-1)).alias("asks"),
    )
