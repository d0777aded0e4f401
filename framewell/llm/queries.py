"""The numbered queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, chat, decontaminate, lang_id, licenses, merkle, ngram_join, pii, secret_scan, sentencepiece_codec, sharding, suffix_dedup


#: The tokenizers of the encoding and alignment queries.
PIECE_MODEL, BYTE_MODEL = "piece_bpe_32k.model", "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.interleave_shards(docs, 24, tie_cols=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), "start")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(sentencepiece_codec.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL)))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(_read(spark, sf_dir, "documents"), words=4, percent=85)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return ann.nearest(vectors, asked, k=20)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(_read(spark, sf_dir, "documents"), keep=("doc_id",)))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = lang_id.identify(docs.select("doc_id", lang_id.held_out().alias("held_out"), "text"), lang_id.train(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align.align(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_MODEL), public_tokenizers.path(PIECE_MODEL))
    return align.digest(align.scored(aligned))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(_read(spark, sf_dir, "documents")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = merkle.row_digest([F.col(c) for c in names])
    altered = merkle.row_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names])
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    proofs = merkle.manifest(docs, leaf, keep={"doc_id": F.col("doc_id"), "tampered": F.when(hit, altered)}).proofs()
    out = proofs.withColumn("folded_root", merkle.folded(F.coalesce("row.tampered", "leaf"), F.col("path")))
    return out.select("row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_sentencepiece, op4_chat, op5_pii, op6_ngram_join, op7_neighbours, op8_secrets, op9_language, op10_suffix_dedup, op11_alignment, op12_licenses, op13_merkle)}
