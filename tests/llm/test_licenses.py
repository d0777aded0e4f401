"""Licence scans against plain restatements: phrases by lists of words, expressions by a recursive parser."""

import random
import re

from framewell.llm import licenses as L
from framewell.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def places(text, phrases):
    words = WORD.findall(lowered(text))
    out = []
    for phrase, label in phrases.items():
        p = phrase.split()
        out += [(label, i) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return words, out


def brute(doc_id, text):
    words, base = places(text, L.BASE)
    at = sorted(i for _, i in base)
    return doc_id, len(words), len(base), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for x, _ in base}))


ODD = [
    None,
    "",
    "  ",
    "GNU General Public-License",
    "cc by cc BY cc by mit license MIT  License.",
    "the MIT Licensee and amit license",
    "Ünder the MIT\nLicense x",
    "gnu\x00general\x1fpublic license",
    "CC BY—SA cc by sa 4.0",
    "mit license " * 5000,
    "x" * 200_000 + " apache license",
    "mit mit license license apache",
]


def test_phrases(spark):
    """Null, empty and long texts, overlaps, every separator, repeated rows, and an id whose name is one of the output's."""
    rows = [*enumerate(ODD), *enumerate(ODD)]
    docs = spark.createDataFrame(rows, "spans long, text string")
    got = L.digest(L.scan_licenses(docs, id_cols=("spans",))).select("spans", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute(*r)) for r in rows)
    assert L.digest(L.scan_licenses(docs.limit(0), id_cols=("spans",))).count() == 0


def test_the_small_table(spark, tiny):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = queries.op12_licenses(spark, tiny).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(brute(*r) for r in docs.items())
    for r in got:
        _, extra = places(docs[r["doc_id"]], L.NOTICES)
        _, base = places(docs[r["doc_id"]], L.BASE)
        assert r["labels"] == ",".join(sorted({x for x, _ in base} | {x for x, _ in extra}))
        left = 1.0
        for weight, found in ((0.7, base), (0.6, extra)):
            left *= (1 - weight) ** len({x for x, _ in found})
        assert abs(r["score"] - (1 - left)) < 1e-6
    assert sum(r["n_base"] > 0 for r in got) > 0 and all(r["score"] == 0 for r in got if not r["labels"])


class Descent:
    """The grammar by recursive descent: or of ands of terms; a term is a name, one with an exception, or a bracketed expression."""

    def __init__(self, words):
        self.words, self.at = words, 0

    def peek(self):
        return self.words[self.at] if self.at < len(self.words) else None

    def expression(self):
        value = self.conjunction()
        while self.peek() == "or":
            self.at += 1
            value = min(value, self.conjunction())
        return value

    def conjunction(self):
        value = self.term()
        while self.peek() == "and":
            self.at += 1
            value = max(value, self.term())
        return value

    def term(self):
        if self.peek() == "(":
            self.at += 1
            value = self.expression()
            if self.peek() != ")":
                raise ValueError
            self.at += 1
            return value
        name = self.peek()
        if name is None or not L._NAME.fullmatch(name):
            raise ValueError
        self.at += 1
        value = next(L.FAMILIES[f] for f in L._FAMILY if name.startswith(f))
        if self.peek() == "with":
            self.at += 1
            if not self.peek() or not L._EXCEPTION.fullmatch(self.peek()):
                raise ValueError
            self.at += 1
            value -= value >= 2
        return value


def longest(words):
    for n in range(len(words), 0, -1):
        d = Descent(words[:n])
        try:
            value = d.expression()
        except ValueError:
            continue
        if d.at == n:
            return n, value
    return None


def test_expressions():
    draw = random.Random(5)
    pool = ["mit", "gpl-2.0-only", "agpl-3.0", "apache-2.0", "mpl-2.0", "licenseref-x", "classpath-exception-2.0", "and", "or", "with", "(", ")", "text"]
    hits = 0
    for _ in range(20_000):
        words = draw.choices(pool, weights=[3, 3, 1, 2, 1, 1, 2, 3, 3, 2, 2, 2, 0.3], k=draw.randint(1, 9))
        got, want = L.parse(" ".join(words).upper()), longest(words)
        assert (got is None) == (want is None)
        if got:
            hits += 1
            assert got.text.lower().split() == words[: want[0]] and got.asks == want[1]
    assert hits > 3000
    assert L.parse("MIT OR GPL-2.0-only AND Apache-2.0").postfix == ["mit", "gpl-2.0-only", "apache-2.0", "and", "or"]
    assert L.parse("(GPL-2.0-only WITH Classpath-exception-2.0) */").postfix == ["gpl-2.0-only", "classpath-exception-2.0", "with"]
    assert L.parse("mitochondria") is None and L.parse("") is None


def test_tags(spark):
    rows = [
        (1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\ncode MIT License"),
        (2, "# spdx license identifier: Apache-2.0 AND\nMIT"),
        (3, "SPDX-License-Identifier: unknown thing"),
        (4, "SPDX-License-Identifier: GPL-2.0-or-later WITH GCC-exception-3.1 and then text\nSPDX-License-Identifier: MIT"),
    ]
    out = {r["doc_id"]: r for r in L.digest(L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert out[1]["labels"] == "gpl-2.0-only,mit" and out[1]["base_labels"] == "mit" and out[1]["asks"] == 0
    assert out[2]["labels"] == "apache-2.0" and out[2]["n_base"] == 0
    assert out[3]["labels"] == "" and out[3]["score"] == 0 and out[3]["asks"] == -1
    assert out[4]["labels"] == "gpl-2.0-or-later,mit"
    found = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).filter("row.doc_id = 4").first()
    assert [(s["label"], s["first"], s["end"]) for s in found["spans"]] == [("gpl-2.0-or-later", 0, 3), ("mit", 16, 19)]
    assert [e["asks"] for e in found["expressions"]] == [1, 0]
