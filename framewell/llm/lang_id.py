"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained with follow-the-regularised-leader.

Document frequencies cover all training rows; the classifier is fitted on a bounded, balanced sample of them, and its scores are calibrated by a temperature.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of hashed n-grams, and the lengths of n-grams.
FEATURES, LENGTHS = 1 << 16, (1, 2, 3)
#: The classifier is fitted on about this many training rows of each language, and on SAMPLE_ROWS of all languages at most, chosen by a hash of the row; whole texts are used.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 1500, 100_000
#: Odd multipliers that spread n-grams over the buckets.
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's character n-grams, sorted, and how often each occurs. Case is folded; runs of anything but letters become one space."""
    line = f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "
    points = np.frombuffer(line.encode("utf-32-le", "replace"), dtype=np.uint32)
    ids = []
    for n in LENGTHS:
        h = np.full(max(len(points) - n + 1, 0), n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint32(_MIX[k])
            h ^= h >> np.uint32(15)
        ids.append(h & np.uint32(FEATURES - 1))
    counts = np.bincount(np.concatenate(ids), minlength=FEATURES)
    hit = np.flatnonzero(counts)
    return hit, counts[hit]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Ftrl:
    """Follow-the-regularised-leader with elastic-net penalties, one set of weights for each class; the last feature is a constant."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.01
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z = np.zeros((FEATURES + 1, self.classes))
        self.n = np.zeros((FEATURES + 1, self.classes))

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = softmax(values @ w)
        p[label] -= 1.0
        g = values[:, None] * p[None, :]
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """What a prediction needs: languages, inverse document frequencies, weights and a temperature. Its size is FEATURES times the languages."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return weigh(*features(text), self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        rows, values = self.vector(text)
        p = softmax(values @ self.weights[rows] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(max(p[best], 0.0), 1.0))


def weigh(rows: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF values of unit length, with a constant feature at the end."""
    values = (1.0 + np.log(counts)) * idf[rows]
    return np.append(rows, FEATURES), np.append(values / np.sqrt(values @ values), 1.0)


def fit(labels: list[str], texts: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, *, epochs: int = 3, seed: int = 7) -> Model:
    """Trains on four of five rows and chooses the temperature on the fifth ones."""
    languages = sorted(set(labels))
    model, ftrl = Model(languages, idf, np.zeros((FEATURES + 1, len(languages)))), Ftrl(len(languages))
    rows = [(weigh(*t, idf), languages.index(y)) for t, y in zip(texts, labels, strict=True)]
    order = np.random.default_rng(seed).permutation(len(rows))
    fresh = order[: len(rows) // 5]
    for _ in range(epochs):
        for i in order[len(fresh) :]:
            (at, values), y = rows[i]
            ftrl.learn(at, values, y)
    model.weights = ftrl.weights(slice(None))
    if len(fresh):
        logits = np.array([rows[i][0][1] @ model.weights[rows[i][0][0]] for i in fresh])
        y = np.array([rows[i][1] for i in fresh])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row belongs to the fold that training never sees; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def corpus_counts(rows: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """Of rows (lang, text), in one pass: in how many texts each bucket occurs, with the number of texts at the end, and how many texts each language has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, langs = np.zeros(FEATURES, dtype=np.int64), Counter()
        for batch in batches:
            langs.update(batch.column(0).to_pylist())
            for text in batch.column(1):
                seen[features(text.as_py() or "")[0]] += 1
        at = np.flatnonzero(seen)
        columns = [pa.array([*at.tolist(), *[None] * len(langs)], pa.int32()), pa.array([*[None] * len(at), *langs], pa.string()), pa.array([*seen[at].tolist(), *langs.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "lang", "n"])

    sums = rows.select("lang", "text").mapInArrow(count, "feature int, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n"))
    out, sizes = np.zeros(FEATURES + 1, dtype=np.int64), {}
    for r in sums.collect():  # one row for each bucket and language, whatever the corpus
        if r["feature"] is None:
            sizes[r["lang"]] = r["n"]
        else:
            out[r["feature"]] = r["n"]
    out[-1] = sum(sizes.values())
    return out, sizes


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learns from texts and non-null languages of rows outside the held-out fold.

    Every language is learned; counts cover all rows, and the fit a sample of at most ``sample`` rows a language and SAMPLE_ROWS in all. The model takes half a megabyte a language.
    Without such rows the model knows no language and predicts ``und``. With one language it always predicts that. Repeated rows count as often as they come.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1 << 30)).alias("draw"))
    df, found = corpus_counts(rows)
    idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0
    spark = docs.sparkSession
    most = min(sample, SAMPLE_ROWS // max(len(found), 1))
    sizes = spark.createDataFrame([(lang, min(1.0, most / n)) for lang, n in found.items()], "lang string, share double")
    # A row joins the sample if its hash falls below its language's share. Copies of a text are drawn by themselves, so that many of them don't fill the sample.
    chosen = rows.join(F.broadcast(sizes), "lang").filter(F.col("draw") < F.col("share") * (1 << 30))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([list(m[k]) for m in made], pa.list_(pa.int32())) for k in (0, 1))], names=["lang", "at", "n"])

    idf_shared = spark.sparkContext.broadcast(idf)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(k=[f"{y} {len(a)} {sum(n)} {a[:8]}" for y, a, n in zip(pdf["lang"], pdf["at"], pdf["n"], strict=True)]).sort_values("k", kind="stable")
        m = fit(list(pdf["lang"]), [(np.asarray(a, dtype=np.int64), np.asarray(n, dtype=np.float64)) for a, n in zip(pdf["at"], pdf["n"], strict=True)], idf_shared.value)
        return pd.DataFrame({"languages": [m.languages], "weights": [m.weights.astype(np.float32).tobytes()], "temperature": [m.temperature]})

    sampled = chosen.select("lang", "text").mapInArrow(vectors, "lang string, at array<int>, n array<int>")
    got = sampled.groupBy().applyInPandas(fitted, "languages array<string>, weights binary, temperature double").collect()
    if not got:
        return Model([], idf, np.zeros((FEATURES + 1, 0)))
    languages = list(got[0]["languages"])
    return Model(languages, idf, np.frombuffer(got[0]["weights"], dtype=np.float32).reshape(FEATURES + 1, len(languages)), got[0]["temperature"])


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds ``pred_col`` and ``score_col`` (0 to 1) to every row; only the text is an input.

    A text that is null or has no letter gets ``und`` and 0. Texts are taken whole, however long; equal texts get equal results. Of languages that score alike the first in
    order of names is taken. Columns named as the new ones are replaced; an empty table gives an empty one.
    """
    docs = docs.drop(pred_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{pred_col}` string, `{score_col}` double"
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.predict(t.as_py()) for t in batch.column(at)]
            columns = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, pred_col, score_col])

    return docs.mapInArrow(run, schema)
