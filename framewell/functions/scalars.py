"""Scalar functions over columns. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def slug(episode: Column) -> Column:
    """SEL1: a file-safe name of a key."""
    return F.replace(episode, F.lit("/"), F.lit("__"))


def numeric_stem(stem: Column) -> Column:
    """SRT2: a file's stem as the number that it is, by which files are ordered; NULL if it is none."""
    return stem.try_cast("bigint")


def description(which: Column, first: Column, second: Column, fallback: Column) -> Column:
    """SEL2: the second text if ``which`` is '2' and it is usable, else the first, else the fallback; the text None counts as missing. NULL if nothing is left."""
    usable = lambda c: F.when(c != "None", c)
    return F.coalesce(F.when(which.cast("string") == "2", usable(second)), usable(first), usable(fallback))


def prompt_hint(hints: Column, by: Column, flat: Column) -> Column:
    """SEL3: the hint for an attribute's value, else the flat one."""
    return F.coalesce(F.try_element_at(hints, by), flat)


def strip_articles(text: Column) -> Column:
    """INT1: lower-cased and trimmed, then a leading 'the ', 'a ' and 'an ' go, each once and in this order."""
    return reduce(lambda c, article: F.regexp_replace(c, f"^{article} ", ""), ("the", "a", "an"), F.lower(F.trim(text)))


def strip_article(text: Column) -> Column:
    """INT2: lower-cased and trimmed, with one leading article less."""
    return F.regexp_replace(F.lower(F.trim(text)), "^(?:the |a |an )", "")


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """INT8: overlap by the length of the common span; 0 where that is empty."""
    span = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(span > 0, F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0)) / span).otherwise(F.lit(0.0))


def midpoint(a: Column, b: Column) -> Column:
    """FN15: floor of the mean of two whole numbers."""
    return F.floor((a + b) / 2).cast("long")


def seconds(frame: Column, fps: float = V.FPS) -> Column:
    """FN14: frame time, to four places, half to even."""
    return F.bround(frame / F.lit(fps), 4)


def rank_of(confidence: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, V.CONFIDENCES)), confidence) - 1


def style(episode: Column, place: Column) -> Column:
    """FN2: the sentence style of a segment."""
    return ((F.crc32(episode.cast("binary")) + place) % V.STYLES).cast("int")


def embodiment(episode: Column) -> Column:
    """FN3: 40 per cent of keys are arms, the others hands."""
    draw = F.crc32(F.concat(episode, F.lit("|embodiment")).cast("binary")) % 10000
    return F.when(draw / 10000 < 0.40, "arm").otherwise("hand")


def idle_sentence(episode: Column, place: Column) -> Column:
    """INT7: one of the idle sentences, by key and output place."""
    pick = (F.crc32(episode.cast("binary")) + place) % len(V.IDLE_SENTENCES)
    return F.element_at(F.array(*map(F.lit, V.IDLE_SENTENCES)), (pick + 1).cast("int"))


def embedded_json(text: Column, schema: str) -> Column:
    """FN1: the JSON object between the first and the last brace; NULL where there is none or it is broken."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def first_two_words(text: Column) -> Column:
    """AGG4: the first two words, lower-cased, white space between them."""
    return F.array_join(F.slice(F.split(F.trim(F.lower(text), F.lit(" \t\r\n")), r"\s+"), 1, 2), " ")


def flags(named: Sequence[tuple[str, Column]]) -> Column:
    """An array of the names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in named]))


def keyframes_between(start: Column, end: Column, count: Column) -> Column:
    """SEL18: both ends and evenly spaced frames between them, half to even."""
    at = lambda i: F.rint(start + (end - start) * i / (count - 1)).cast("long")
    inner = F.when(count > 2, F.transform(F.sequence(F.lit(1), count - 2), at)).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_distinct(F.concat(F.array(start.cast("long"), end.cast("long")), inner)))


def window_grid(start: Column, end: Column, stride: Column, frames: Column, count: Column) -> Column:
    """SEL19: every stride-th frame of a window, at most ``frames`` of them, thinned to ``count`` evenly spaced ones; first and last stay."""
    grid = F.slice(F.sequence(start, end, stride), F.lit(1), frames)
    step = (F.size(grid) - 1) / (count - 1)
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.rint(i * step).cast("int")))
    return F.when(F.size(grid) <= count, grid).otherwise(F.transform(picks, lambda i: F.get(grid, i)))
