"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import matches, spans_text

#: Kinds in the order that breaks ties of the start. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
# Possessive quantifiers and the looks behind change no match: nothing that they give up could match. They keep the work in proportion to the text.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap test that holds wherever the pattern can match.
_GUARDS = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.instr(t, "+") > 0,
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "ssn": lambda t: t.rlike(r"-[0-9]{2}-"),
}
#: What a span of a kind scores by itself, and with a passed checksum where the kind has one.
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
#: Words that raise the score when they stand in the WINDOW code points before the span, and by how much.
CONTEXT = {
    "email": "mail|email|e-mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|teléfono|téléphone",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
WINDOW, CONTEXT_GAIN = 40, 0.3
#: Spans of the kinds beyond the base ones need this score; base ones always stay.
THRESHOLD = 0.5


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    last = F.length(digits)
    place = F.sequence(F.lit(1), last)

    def term(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((last - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(place, term), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + (c - 55)) % 97).otherwise((a * 10 + (c - 48)) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        packed = F.replace(value, F.lit(" "), F.lit(""))
        return F.when(F.length(packed).between(15, 34), mod97(packed)).otherwise(False)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-|-0000$")
    return F.lit(True)


def find_pii(docs: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD, into: str = "pii") -> DataFrame:
    """Adds ``into``: an array of (start, rank, end, kind, score) for every row, by start and then kind; code points, end exclusive.

    The base kinds are leftmost non-overlapping matches that pass their checks (parts of an ip at most 255, Luhn, digit counts); they stay whatever they score.
    iban spans pass mod 97; ssn spans need a word of CONTEXT before them, through the threshold. A null or empty text has no spans.
    Texts are taken whole, each row by itself; equal rows get equal spans. A column named as ``into`` is replaced; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def spans(rank: int, kind: str) -> Column:
        words = rf"(?i)(?<!\p{{L}})(?:{CONTEXT[kind]})(?!\p{{L}})"

        def made(m: Column) -> Column:
            start = F.greatest(m["start"] - WINDOW, F.lit(0))
            before = F.substr(text, (start + 1).cast("int"), (m["start"] - start).cast("int"))
            score = F.round(F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + F.when(before.rlike(words), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))), 3)
            return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

        found = F.filter(matches(text, PATTERNS[kind], _GUARDS[kind](text)), lambda m: _valid(kind, m["value"]))
        kept = F.transform(found, made)
        return kept if rank < 4 else F.filter(kept, lambda s: s["score"] >= threshold)

    every = F.concat(*[spans(rank, kind) for rank, kind in enumerate(KINDS)])
    return docs.withColumn(into, F.array_sort(every))


def digest(found: DataFrame, *, spans_col: str = "pii") -> DataFrame:
    """Counts and digests of what find_pii found."""
    spans = F.col(spans_col)
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["rank"] < 4)
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
