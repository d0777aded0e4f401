"""The pipeline's stages: what each drops and keeps, on planted rows and on the small tables."""

import corpus_pipeline
import public_tokenizers
import sentencepiece
from framewell.llm import lang_id, queries
from pyspark.sql import functions as F

from .test_decontaminate import brute as leaks
from .test_ngram_join import brute as groups


def staged(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out.append(docs)
    return out


def test_stages_on_the_small_table(spark, tiny, tmp_path):
    tables = staged(spark, tiny, tmp_path)
    rows = [t.collect() for t in tables]
    ids = [{r["doc_id"] for r in x} for x in rows]
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    assert ids[1] <= ids[0] and len(ids[1]) >= 0.98 * len(ids[0])
    pairs = groups([(r["doc_id"], r["text"]) for r in rows[1]], 5, 80)
    assert ids[2] == {d for d, _, c in pairs if c == d}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    assert ids[2] - ids[3] == {d for d, _ in leaks([(r["doc_id"], r["text"]) for r in rows[2]], bench)}
    assert ids[3] == ids[4] == ids[5]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECE_MODEL))
    texts = {r["doc_id"]: r["text"] for r in rows[4]}
    assert all(list(r["ids"]) == [*lib.encode(texts[r["doc_id"]]), 2] for r in rows[5])
    assert sorted(map(str, corpus_pipeline.run(spark, tiny).collect())) == sorted(map(str, rows[5]))


def test_languages_are_told_apart(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = queries.op9_language(spark, tiny).join(docs, "doc_id")
    fresh = got.filter("held_out")
    assert fresh.count() > 20 and fresh.filter("lang = lang_pred").count() >= 0.95 * fresh.count()
    assert got.filter("score < 0 OR score > 1").count() == 0
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.collect())


def test_language_of_odd_rows(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = lang_id.train(docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !? ", None), (None, "the and of the with", "x"), (5, "é", "x"), (5, "é", "x")], "doc_id long, text string, score string")
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in lang_id.identify(odd, model).collect()}
    assert got[(1, None)] == got[(2, "")] == got[(3, "123 !? ")] == ("und", 0.0)
    assert got[(None, "the and of the with")][0] == "en" and got[(5, "é")][0] in model.languages
    none = lang_id.train(docs.limit(0))
    assert none.predict("text") == ("und", 0.0)
    one = lang_id.train(docs.withColumn("lang", F.lit("xx")))
    assert one.predict("text") == ("xx", 1.0)


def test_odd_rows_pass_the_stages(spark, tiny):
    good = "the and of the with was that this is for in on thing other thought over"
    rows = [(1, good), (1, good), (None, good), (None, "is this the thing that was over there for you and me"), (2, good + " "), (3, "")]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, tiny)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, good), (None, rows[3][1]), (3, "")], key=str)
    assert corpus_pipeline.secrets(spark, docs, tiny).count() == len(rows)
    assert corpus_pipeline.benchmark_leaks(spark, docs, tiny).count() == len(rows)
    assert corpus_pipeline.tokens(spark, docs, tiny).count() == len(rows)


def test_language_stage_of_odd_rows(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", None, 0), (-3, "12 34", "en", "s", 5), (None, "the and of the with that was", None, None, 3)], docs.schema)
    more = docs.unionByName(extra).withColumns({"lang_pred": F.lit("mine"), "score": F.lit(7)})
    kept = corpus_pipeline.language(spark, more, tiny)
    assert kept.columns == more.columns and {(r["lang_pred"], r["score"]) for r in kept.select("lang_pred", "score").distinct().collect()} == {("mine", 7)}
    assert {r["doc_id"] for r in kept.filter("doc_id < 0 OR doc_id IS NULL").collect()} == {None}
    # Without labels nothing is learned, and documents with letters stay.
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, bare, tiny).count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()


def test_stages_on_an_empty_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tiny)
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_secrets_stage_against_brute_force(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    found = {(r["doc_id"], r["spans"]): r for r in queries.op8_secrets(spark, tiny).collect()}
    spans = {d: [tuple(map(int, x.split(":")[1:])) for x in s.split(",") if x] for d, s in found}
    live = {r["doc_id"]: (r["n_live"], r["n_example"]) for r in found.values()}
    out = {r["doc_id"]: r for r in corpus_pipeline.secrets(spark, docs, tiny).collect()}
    for r in docs.collect():
        text, got = r["text"], out[r["doc_id"]]
        if live[r["doc_id"]][0] == 0:
            assert got["text"] == text
        elif live[r["doc_id"]][1] == 0:
            at, parts = 0, []
            for a, b in sorted(spans[r["doc_id"]]):
                if a >= at:
                    parts += [text[at:a], "[SECRET]"]
                at = max(at, b)
            assert got["text"] == "".join(parts) + text[at:]
        assert got["n_chars"] == (None if text is None else len(got["text"]))
