"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, secret redaction and tokenizing.

Each stage takes all rows that the one before kept. All but the last return the columns of documents; the last returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from framewell.llm import decontaminate, lang_id, ngram_join, secret_scan, sentencepiece_codec
from framewell.llm._spark import discard, spare, stored
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents whose language is predicted with less than this are rejected, as are those without letters.
LEAST_SCORE = 0.5
PIECE_MODEL = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language is uncertain; the classifier learns from the labelled rows of ``docs``.

    Null and empty texts have no letter. Repeated rows fare alike. Where no row is labelled nothing is learned, and whatever has a letter stays.
    """
    model = lang_id.train(docs)
    if not model.languages:
        return docs.filter(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    pred, score = spare(docs.columns, "lang_pred"), spare(docs.columns, "score")
    found = lang_id.identify(docs, model, pred_col=pred, score_col=score)
    return found.filter((F.col(pred) != lang_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shingles of five words tie together at a similarity of 0.8: that with the smallest id, once if it is repeated.

    Texts without words, null and empty ones among them, are no copies and stay.
    """
    return ngram_join.one_of_each_group(docs, words=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark. Null, empty and short texts hold none; repeated rows go or stay together."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks live-looking credentials in the texts, and keeps examples that many owners share; n_chars follows the new text, and is null for a null one. All rows stay."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the texts' ids, an end id last, and their number. A null text counts as an empty one, which is the end id alone; all rows stay."""
    encoded = sentencepiece_codec.encode(docs, public_tokenizers.path(PIECE_MODEL), id_cols=("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Language ID, the similarity join's components and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage keeps is stored, for the next one reads it more than once; of the stages before, nothing stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
