"""The codec against the sentencepiece library, and spans against exact round trips."""

import random
import struct
import time

import public_tokenizers
import pytest
import sentencepiece
from framewell.llm import queries, sentencepiece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "▁", "a▁b ▁ c", "x▁", " ▁ ", "é😀\x00\t\n", "a" * 3000, "ab" * 100 + " " + "日本" * 60, "\u0001 ​", " lead", "trail ", "🇩🇪 ", "\n\n", "   ", "▁▁ a", "▁ ▁▁"]


@pytest.fixture(scope="module")
def both():
    return sentencepiece_codec.codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(spark, tiny):
    return ODD + [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]


def test_as_the_library(spark, tiny, both):
    own, lib = both
    for text in texts(spark, tiny):
        ids = own.encode(text)[0].tolist()
        assert ids == [*lib.encode(text), 2]
        assert own.decode(ids) == lib.decode(ids[:-1])


def test_spans_give_the_pieces(spark, tiny, both):
    own, _ = both
    for text in texts(spark, tiny):
        ids, begins = own.encode(text)
        raw = text.encode()
        assert begins[-1] == len(raw) and begins[0] == 0 and (begins[1:] >= begins[:-1]).all()
        if "▁" not in text:
            for i, piece in enumerate(ids[:-1].tolist()):
                piece = own.raw[piece]
                assert raw[begins[i] : begins[i + 1]] == (piece[1:] if i == 0 else piece)


def test_character_map():
    # A hand-made double array: "A" becomes "a", "AB" becomes "xy".
    units = [0] * 1024
    strings = b"a\0xy\0"

    def unit(label, offset, leaf=False):
        return label | (leaf << 8) | (offset << 10)

    units[0] = unit(0, 256)
    first = 256 ^ ord("A")
    units[first] = unit(ord("A"), first ^ 512, True)
    units[512] = 1 << 31
    second = 512 ^ ord("B")
    units[second] = unit(ord("B"), second ^ 768, True)
    units[768] = 1 << 31 | 2
    compiled = struct.pack(f"<I{len(units)}I", 4 * len(units), *units) + strings
    assert sentencepiece_codec.character_map(compiled) == {b"A": b"a", b"AB": b"xy"}


def test_alignment_through_a_character_map(both):
    own = sentencepiece_codec.Codec(open(PATH, "rb").read())
    own.model.charmap, own.longest = {b"A": b"a", b"AB": b"xy", "é".encode(): b"ee"}, 2
    normalised, origin = own.normalise("cABA é")
    assert normalised == "▁cxya▁ee"
    assert origin == [0, 0, 0, 0, 1, 1, 3, 4, 4, 4, 5, 5, 7]


def test_query(spark, tiny, both):
    _, lib = both
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = queries.op3_sentencepiece(spark, tiny).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = lib.encode(rows[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) + 1, sha(" ".join(map(str, [*ids, 2]))), sha(lib.decode(ids)))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (1, None, 5), (2, "", None)], "doc_id long, text string, ids int")
    got = sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in sentencepiece_codec.encode(docs, PATH).collect()), key=str)
    assert [g for g in got if g[0] is not None] == [(1, [2], ""), (1, [2], ""), (2, [2], "")]
    assert next(g for g in got if g[0] is None)[2] == "a b"
    assert sentencepiece_codec.encode(docs.limit(0), PATH).count() == 0


def test_texts_of_a_megabyte(both):
    own, lib = both
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdeé日", k=rng.randint(1, 9))) for _ in range(200_000))
    assert len(text.encode()) > 1 << 20
    ids = own.encode(text)[0].tolist()
    assert ids == [*lib.encode(text), 2] and own.decode(ids) == lib.decode(ids[:-1])


def test_trimmed_spaces():
    own = sentencepiece_codec.Codec(open(PATH, "rb").read())
    own.model.charmap, own.longest, own.model.trim_spaces = {b"A": b"a"}, 1, True
    assert own.normalise("  bA   c  ")[0] == "▁ba▁c" and own.normalise("   ")[0] == ""
    begin = time.monotonic()
    assert own.normalise("ab  " * 60_000)[0] == "▁ab" * 60_000
    # A copy of the rest at every space took many times as long.
    assert time.monotonic() - begin < 20


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, 2, "a b"), (3, 4, None)], "ids long, Begins long, text string")
    out = sentencepiece_codec.encode(docs, PATH, id_cols=("ids", "Begins"))
    assert out.columns == ["ids", "Begins", "_ids", "_begins", "decoded"]
    assert [(r["ids"], len(r["_ids"]), r["decoded"]) for r in out.orderBy("ids").collect()] == [(1, 3, "a b"), (3, 1, "")]
