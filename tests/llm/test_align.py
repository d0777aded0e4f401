"""Alignments and their corpus-wide counts against the tokenizers' own tokens of whole texts."""

import hashlib
import itertools
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from framewell.llm import align, queries
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a  b ", "\n\n x", " lead", "trail ", "<|endoftext|> </s> <unk>", "a▁b", "▁", "é😀\x00\t\n z", "日本 語 x", "don't  we'll 'tis", "a" * 3000 + " b", "x \n y", "١٢ ٣", "\x1cq \x85 r   s", "é ́ a", "tab\t tab", "1,000 (a) [b]: c!", "​ z ​"]


def tokens(lib_a, lib_b, text):
    """Ids and ends of both, or None."""
    if not text:
        return None
    raw = (" " + text).encode()
    a = lib_a.encode(" " + text, add_special_tokens=False).ids
    table = align.byte_table()
    parts_a = [bytes(table[c] for c in lib_a.id_to_token(i)) for i in a]
    b = lib_b.encode(text)
    parts_b = [bytes([int(lib_b.id_to_piece(i)[3:5], 16)]) if lib_b.is_byte(i) else lib_b.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
        return None
    return a, list(itertools.accumulate(map(len, parts_a))), b, list(itertools.accumulate(map(len, parts_b)))


def brute(rows):
    lib_a, lib_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib_a.encode_special_tokens = True
    made, counts = [], Counter()
    for doc_id, text in rows:
        got = tokens(lib_a, lib_b, text)
        links, groups = [], []
        if got:
            a, ends_a, b, ends_b = got
            of_b = defaultdict(list)
            for i, e in zip(b, ends_b, strict=True):
                of_b[e].append(i)
            links = [(i, j) for i, e in zip(a, ends_a, strict=True) for j in of_b[e]]
            before = 0
            for cut in sorted(set(ends_a) & set(ends_b)):
                groups.append(",".join(str(i) for i, e in zip(a, ends_a, strict=True) if before < e <= cut) + "|" + ",".join(str(i) for i, e in zip(b, ends_b, strict=True) if before < e <= cut))
                before = cut
        counts.update(links)
        made.append((doc_id, len(got[0]) if got else 0, len(got[2]) if got else 0, groups, links))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return sorted((d, a, b, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, k in made)


def test_odd_texts(spark):
    """Null, empty and long texts, odd spaces, special tokens as plain text, repeated rows, and ids whose name is one of the output's."""
    rows = [(i, t) for i, t in enumerate([*ODD, *ODD[9:], "a b c", "a b c"])] + [(3, "a b c")]
    docs = spark.createDataFrame(rows, "pairs long, text string").repartition(3)
    out = align.digest(align.scored(align.align(docs, A, B, id_cols=("pairs",))))
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_the_small_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    few = [(r["doc_id"], r["text"] if len(r["text"] or "") < 6000 else None) for r in docs][:80]
    out = align.digest(align.scored(align.align(spark.createDataFrame(few, "doc_id long, text string"), A, B)))
    assert sorted(map(tuple, out.collect())) == brute(few)
    got = queries.op11_alignment(spark, tiny)
    assert got.count() == len(docs) and got.filter("n_links <> n_groups OR n_best > n_links OR count_sum < n_links").count() == 0


def test_units_are_independent():
    """Every character beside a single space, against the whole text's tokens."""
    use = align.Aligner(A, B)
    lib_a, lib_b = use.a, use.b
    for c in [*map(chr, range(1, 0x250)), *map(chr, range(0x2000, 0x2070)), "　", "﻿", "日", "😀", "ก"]:
        for text in (f"a {c} b", f"a{c} {c}b", f"1 {c}", f"{c} 'x"):
            got, want = use.documents([text], True)[0], tokens(lib_a, lib_b, text)
            if want is None:
                assert got[:4] == (0, 0, "", 0)
            else:
                cuts = sorted(set(want[1]) & set(want[3]))
                assert (got[0], got[1], got[3], got[6].tolist()) == (len(want[0]), len(want[2]), len(cuts), cuts)
                assert [int(i) for i in got[2].replace(";", ",").replace("|", ",").split(",")] != [] and got[2].count(";") == len(cuts) - 1


def test_both_encoders_agree(monkeypatch):
    """Ranks give the same tokens as merges, on units of all letters that they are used for, and forgetting changes nothing."""
    import random

    use, draw = align.Aligner(A, B), random.Random(3)
    assert use.quick
    letters = [chr(c) for c in range(33, 0x250)]
    units = ["".join(draw.choices(letters if draw.random() < 0.5 else "abcdefghijklmnopqrstuvwxyz'.,A1", k=draw.randint(1, 14))) for _ in range(20_000)]
    for u in units:
        assert use.quick(" " + u) == use.a.encode(" " + u, add_special_tokens=False).ids
    texts = [" ".join(draw.choices(units[:500], k=30)) for _ in range(60)]
    whole = align.Aligner(A, B).documents(texts, True)
    monkeypatch.setattr(align, "CACHE_UNITS", 20)
    few = align.Aligner(A, B)
    for t, w in zip(texts, whole, strict=True):
        assert str(few.documents([t], True)[0]) == str(w)


def test_long_text_and_blocks(spark, monkeypatch):
    """Blocks of a few bytes give the same counts; a text of a megabyte is one row."""
    rows = [(i, f"the house of number {i % 7} and the tree") for i in range(60)] + [(99, "word and word " * 80_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, align.digest(align.scored(align.align(docs, A, B))).collect()))
    monkeypatch.setattr(align, "BLOCK_BYTES", 100)
    assert sorted(map(tuple, align.digest(align.scored(align.align(docs, A, B))).collect())) == whole and len(whole) == 61
    assert align.digest(align.scored(align.align(docs.limit(0), A, B))).count() == 0


def test_new_units_are_aligned_in_arrays():
    """Calls of functions for each new unit are few: tokens are no steps of Python."""
    import cProfile
    import pstats
    import random

    use, draw = align.Aligner(A, B), random.Random(5)
    texts = [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyzäé", k=draw.randint(4, 14))) for _ in range(100)) for _ in range(100)]
    profile = cProfile.Profile()
    made = profile.runcall(use.documents, texts, False)
    assert all(m[3] > 100 for m in made) and len(use.seen) > 9_000
    assert pstats.Stats(profile).total_calls < 12 * len(use.seen)


def test_texts_that_are_not_aligned_among_others(monkeypatch):
    """Units whose bytes differ leave those beside them as they are, in one batch and in batches of few units, with and without forgetting."""
    lib_a, lib_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib_a.encode_special_tokens = True
    texts = [*ODD, "fine words here", "one ▁ here", "here one", "x▁y here", "one here x▁y z", "words, here; (fine)", "日本 here 語", "̀a here é"] * 3
    made = align.Aligner(A, B).documents(texts, True)
    for t, got in zip(texts, made, strict=True):
        want = tokens(lib_a, lib_b, t)
        a, ends_a, b, ends_b = want or ([], [], [], [])
        cuts = sorted(set(ends_a) & set(ends_b))
        links = Counter(a[ends_a.index(c)] << align.SHIFT | b[ends_b.index(c)] for c in cuts)
        assert (got[0], got[1], got[3], got[6].tolist()) == (len(a), len(b), len(cuts), cuts)
        assert dict(zip(got[4].tolist(), got[5].tolist(), strict=True)) == links
        groups = [g.split("|") for g in got[2].split(";")] if cuts else []
        assert [int(i) for g in groups for i in g[0].split(",")] == a and [int(i) for g in groups for i in g[1].split(",")] == b
    for name, most in (("BATCH_UNITS", 3), ("CACHE_UNITS", 10), ("CACHE_BYTES", 30)):
        monkeypatch.setattr(align, name, most)
        few = align.Aligner(A, B)
        assert str([few.documents([t], True) for t in texts]) == str([[m] for m in made])
        few.forget()
        assert len(few.seen) == len(few.names) == len(few.rows) and len(few.seen) <= align.CACHE_UNITS // 2 and few.held <= align.CACHE_BYTES // 2 and few.groups == len(few.pairs) == len(few.ends) <= few.held


def test_batches_are_bounded_by_bytes(monkeypatch):
    """Parts cover all rows once, in order; one of several rows is within both limits."""
    monkeypatch.setattr(align, "BATCH_ROWS", 3)
    monkeypatch.setattr(align, "BATCH_BYTES", 10)
    assert list(align._parts([1, 1, 1, 1, 20, 4, 6, 1])) == [(0, 3), (3, 4), (4, 5), (5, 7), (7, 8)]
    assert list(align._parts([])) == []
