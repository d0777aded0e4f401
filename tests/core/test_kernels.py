"""Folds and kernels against hand-worked cases and plain restatements of their rules."""

import functools
import json
import operator
import random
import zlib

import numpy as np
import pytest
from framewell.functions import scalars as S
from framewell.functions import vocabulary as V
from framewell.operators import events as E
from framewell.operators import hands as H
from framewell.operators import intervals as I
from framewell.operators import joins as J
from framewell.operators import prominence
from framewell.operators import reports as R
from framewell.operators import signals as G
from framewell.operators import windows as W
from framewell.operators.folds import fold_keys
from framewell.plans import constraints as C
from framewell.plans import labeling as L
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

LABEL = "key string, start long, end long, action string, hand string, object string, confidence string, sentence string, start_source string, end_source string, n_frames long"


class Replay:
    """A Labeler that answers from stored responses."""

    def __init__(self, responses):
        self.responses = responses

    def __call__(self, prompt):
        return self.responses[prompt]


def labels(spark, rows, n, key="e", source="label"):
    return spark.createDataFrame([(key, a, b, act, hand, "cup", conf, f"{act} from {a}", source, f"to {b}", n) for a, b, act, hand, conf in rows], LABEL)


def spans(df, *cols):
    return [tuple(r[c] for c in cols) for r in sorted(df.collect(), key=lambda r: r["start"])]


def series(spark, values, **more):
    rows = [("e", i, None if v is None else float(v), v is not None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, frame long, x double, valid boolean")


def column(df, name):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r["frame"])]


def test_fill_gaps(spark):
    out = G.fill_gaps(series(spark, [0, None, None, 3, None, None, None, 7, None]), "x", "valid", max_gap=2)
    assert column(out, "filled")[:4] == [0, 1, 2, 3] and column(out, "masked") == [False] * 4 + [True] * 3 + [False, True]


def test_smooth(spark):
    cubic = [0.01 * i**3 - i**2 + 3 for i in range(25)]
    assert np.allclose(column(G.smooth(series(spark, cubic), "x"), "smooth"), cubic)
    impulse = column(G.smooth(series(spark, [float(i == 20) for i in range(41)]), "x"), "smooth")
    assert impulse[20] == pytest.approx(167 / 1105) and impulse[13] == pytest.approx(-78 / 1105) and impulse[12] == 0
    short = [1.0, 5.0, 2.0, 8.0, 3.0, 9.0]
    weights = np.array(G.smoothing_rows(5, 3))
    got = column(G.smooth(series(spark, short), "x"), "smooth")
    assert np.allclose(got, [*(weights[:3] @ short[:5]), *(weights[2:] @ short[1:])][:2] + list(weights[2:3] @ short[:5]) + list(weights[2:] @ short[1:]))
    assert column(G.smooth(series(spark, [4.0, 2.0, 9.0]), "x"), "smooth") == [4.0, 2.0, 9.0]


def test_gradient_and_runs(spark):
    assert column(G.gradient(series(spark, [0, 1, 4, 9]), "x", fps=1), "gradient") == [1, 2, 4, 5]
    runs = G.runs(series(spark, [1, None, None, 1, None]).withColumn("bad", ~F.col("valid")), "bad").collect()
    assert sorted((r["start"], r["stop"]) for r in runs) == [(1, 3), (4, 5)]


def test_angular_speed(spark):
    turn = lambda a: [float(v) for v in (np.cos(a), -np.sin(a), 0, np.sin(a), np.cos(a), 0, 0, 0, 1)]
    df = spark.createDataFrame([("e", i, turn(0.1 * i)) for i in range(4)], "key string, frame long, r array<double>")
    assert np.allclose(column(G.angular_speed(df, "r", fps=10), "angular_speed"), [1.0] * 4)


def test_joint_valid(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 0.6, [nan]), (1, 0.4, [1.0]), (2, nan, [1.0]), (3, None, [1.0]), (4, None, [1.0, nan])], "i int, c double, m array<double>")
    got = {r["i"]: r["v"] for r in df.select("i", G.joint_valid(F.col("c"), F.col("m")).alias("v")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: False}


def test_peaks(spark):
    assert sorted(r["frame"] for r in E.peaks(series(spark, [0, 2, 1, 3, 3, 1, 5]), "x").collect()) == [1, 3]


def prominences(x):
    """Places of peaks and their prominence, by the definition."""
    want = {}
    i = 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j] == x[i]:
            j += 1
        if x[i] > x[i - 1] and x[j] < x[i]:
            m = (i + j - 1) // 2
            left = next((k for k in range(m - 1, -1, -1) if x[k] > x[m]), -1)
            right = next((k for k in range(m + 1, len(x)) if x[k] > x[m]), len(x))
            want[m] = x[m] - max(min(x[left + 1 : m + 1]), min(x[m:right]))
        i = j
    return want


@pytest.mark.parametrize("block", [2, 3, 256])
def test_prominences_by_their_definition(spark, monkeypatch, block):
    """Many random series, with plateaus, slopes and one high end, through one to seven levels of blocks."""
    monkeypatch.setattr(prominence, "BLOCK", block)
    draw = np.random.default_rng(block)
    all_series = [draw.integers(0, 7, draw.integers(0, 60)).tolist() for _ in range(60)]
    all_series += [list(range(40)), list(range(40, 0, -1)), [i % 2 * i for i in range(90)], [i % 2 * (90 - i) for i in range(90)], [5] * 20, [9] + [i % 3 for i in range(70)] + [9], []]
    rows = [(k, f, -float(x)) for k, values in enumerate(all_series) for f, x in enumerate(values)]
    df = spark.createDataFrame(rows, "key long, frame long, x double")
    want = {(k, f, float(p)) for k, values in enumerate(all_series) for f, p in prominences(values).items()}
    for longest in (None, 89):
        got = E.prominent_minima(df, "x", prominence=0.0, longest=longest).collect()
        assert {(r["key"], r["frame"], r["prominence"]) for r in got} == want and len(got) == len(want)
        assert all(r["depth"] == -all_series[r["key"]][r["frame"]] for r in got)


def test_prominence_stays_in_the_jvm(spark):
    plan = E.prominent_minima(series(spark, [1.0, 0, 2]), "x", prominence=0.0)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def candidates(spark, rows):
    return spark.createDataFrame([("e", f, 0, V.PRIORITY[s], m) for f, s, m in rows], "key string, frame long, ord int, prio int, magnitude double")


def test_merge_moves_with_the_winner(spark):
    rows = [(10, "pause", -0.05), (20, "grasp", 0.2), (34, "pause", -0.02), (36, "gaze", 0.9), (60, "release", 0.3), (70, "grasp", 0.9)]
    assert sorted(r["frame"] for r in E.merge_candidates(candidates(spark, rows)).collect()) == [20, 36, 60]


def test_thinning_and_static_stretches():
    assert E.thin_boundaries([40, 60, 80], [(2, -0.05), (1, 0.5), (3, 0.2)], 30) == [0, 2]
    assert E.thin_boundaries([40, 60], [(2, -0.05), (2, -0.05)], 30) == [1]
    # Frames 100 to 149 of 200 move.
    assert E.drop_static([30, 60, 120], [0, 0, 20], (199, 50)) == [1, 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 3)), max_size=12, unique_by=lambda t: t[0]), st.integers(1, 30))
def test_thinning_restarts(rows, least):
    rows = sorted(rows)
    kept = list(range(len(rows)))
    while close := [j for j in range(len(kept) - 1) if rows[kept[j + 1]][0] - rows[kept[j]][0] < least]:
        j = close[0]
        del kept[j if rows[kept[j]][1] <= rows[kept[j + 1]][1] else j + 1]
    assert E.thin_boundaries([f for f, _ in rows], [(p,) for _, p in rows], least) == kept


def test_fuse(spark):
    f = series(spark, [float(30 <= i < 90) for i in range(120)]).withColumnRenamed("x", "speed")
    fused = E.fuse(candidates(spark, [(5, "release", 1.0), (40, "grasp", 0.5), (45, "pause", -0.1), (80, "release", 0.4), (118, "grasp", 1.0)]), f)
    assert sorted(r["frame"] for r in fused.collect()) == [0, 40, 80, 119]


def test_folds_see_whole_keys(spark):
    rows = [(k, i, "x") for k in range(40) for i in range(k * 30 % 101)]
    df = spark.createDataFrame(rows, "key long, i long, t string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = fold_keys(df, ["i", "t"], ["i"], lambda r: [(len(r), [x[0] for x in r] == list(range(len(r))))], "n long, ok boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["key"]: (r["n"], r["ok"]) for r in got} == {k: (k * 30 % 101, True) for k in range(40) if k * 30 % 101}


def test_segments_and_events(spark):
    bounds = spark.createDataFrame([("e", 0), ("e", 50), ("e", 99)], "key string, frame long")
    seg = E.segments_between(bounds)
    ev = spark.createDataFrame([("e", 50, "grasp", 1.0), ("e", 99, "grasp", 1.0), ("e", 0, "release", 1.0)], "key string, frame long, type string, magnitude double")
    got = spans(E.events_inside(seg, ev), "start", "end", "events_inside")
    assert [(a, b, [x["frame"] for x in e]) for a, b, e in got] == [(0, 50, [0]), (50, 99, [50])]


def test_names(spark):
    row = spark.range(1).select(S.strip_articles(F.lit(" The a cup ")).alias("a"), S.strip_article(F.lit("the a cup")).alias("b"), S.strip_articles(F.lit("a the cup")).alias("c")).first()
    assert tuple(row) == ("cup", "a cup", "the cup")


def test_styles_and_embodiments(spark):
    ids = [f"task/{i}" for i in range(50)]
    df = spark.createDataFrame([(x,) for x in ids], "k string").select("k", S.style(F.col("k"), F.lit(3)).alias("s"), S.embodiment(F.col("k")).alias("e"))
    for r in df.collect():
        assert r["s"] == (zlib.crc32(r["k"].encode()) + 3) % 6
        assert r["e"] == ("arm" if zlib.crc32((r["k"] + "|embodiment").encode()) % 10000 / 10000 < 0.4 else "hand")


def test_grids(spark):
    row = spark.range(1).select(S.keyframes_between(F.lit(0), F.lit(10), F.lit(5)).alias("a"), S.window_grid(F.lit(0), F.lit(47), F.lit(1), F.lit(48), F.lit(12)).alias("b")).first()
    assert row["a"] == [0, 2, 5, 8, 10] and row["b"] == [0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47]


def test_embedded_json(spark):
    texts = ['```json\n{"k": 1}\n```', 'Sure: {"k": 2} done', "none", '{"k": ', ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.embedded_json(F.col("t"), "k int")["k"].alias("k"))
    assert {r["i"]: r["k"] for r in df.collect()} == {0: 1, 1: 2, 2: None, 3: None, 4: None}


def test_golden_episodes(spark):
    first = [(0, 17, "idle", "both"), (17, 26, "grasp", "both"), (26, 74, "place", "both"), (78, 95, "retract", "both"), (96, 132, "place", "both"), (132, 140, "retract", "both")]
    second = [(0, 122, "grasp", "right"), (122, 161, "retract", "right"), (165, 274, "unfold", "both"), (274, 288, "reposition", "left"), (289, 293, "idle", "left")]
    from framewell.plans import assembly

    out = assembly.assemble(labels(spark, [(*r, "high") for r in first], 141))
    assert spans(out, "start", "end", "action") == [(0, 17, "idle"), (17, 78, "place"), (78, 96, "retract"), (96, 140, "place")]
    out = assembly.assemble(labels(spark, [(*r, "high") for r in second], 294))
    assert spans(out, "start", "end", "action") == [(0, 122, "grasp"), (122, 165, "retract"), (165, 274, "unfold"), (274, 293, "reposition")]
    assert [list(f) for _, f in spans(out, "start", "flags")] == [[], [], [], ["short_segment"]]
    nested = assembly.annotations(out).first()
    assert list(nested["review_queue"]) == [3] and len(nested["subtasks"]) == 4


def test_merging(spark):
    a = labels(spark, [(0, 30, "grasp", "left", "low"), (44, 60, "grasp", "left", "high"), (75, 90, "grasp", "left", "high")], 91)
    assert spans(I.merge_adjacent(a), "start", "end", "confidence") == [(0, 60, "high"), (75, 90, "high")]
    b = labels(spark, [(0, 30, "grasp", "left", "low"), (30, 60, "grasp", "left", "high")], 61, source="release")
    assert len(spans(I.merge_adjacent(b, keep_events_apart=True), "start")) == 2


def test_absorbing():
    rows = [{"start": a, "end": b, "confidence": c, "n": n} for a, b, c, n in ((0, 5, "high", "A"), (5, 30, "low", "B"), (30, 36, "medium", "C"), (36, 80, "medium", "D"))]
    assert [(r["start"], r["end"], r["n"]) for r in I.absorb(rows, 10)] == [(0, 36, "A"), (36, 80, "D")]


SPANS = st.lists(st.tuples(st.integers(1, 12), st.sampled_from(V.CONFIDENCES)), min_size=1, max_size=14)


@settings(max_examples=200, deadline=None)
@given(SPANS, st.integers(1, 15))
def test_absorbing_restarts(drawn, least):
    rows, at = [], 0
    for i, (size, confidence) in enumerate(drawn):
        rows.append({"start": at, "end": at + size, "confidence": confidence, "start_source": f"s{i}", "end_source": f"e{i}", "events": [i]})
        at += size
    want = [dict(r) for r in rows]
    weight = lambda r: (V.CONFIDENCES.index(r["confidence"]), r["end"] - r["start"])
    while len(want) > 1 and min(r["end"] - r["start"] for r in want) < least:
        i = min(range(len(want)), key=lambda k: want[k]["end"] - want[k]["start"])
        sides = [k for k in (i - 1, i + 1) if 0 <= k < len(want)]
        a, b = sorted((i, max(sides, key=lambda k: (weight(want[k]), -k))))
        x, y = want[a], want[b]
        says = x if weight(x) >= weight(y) else y
        want[a : b + 1] = [{"start": x["start"], "end": y["end"], "confidence": says["confidence"], "start_source": x["start_source"], "end_source": y["end_source"], "events": x["events"] + y["events"]}]
    assert I.absorb(rows, least) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=12), st.data())
def test_static_stretches_restart(gaps, data):
    frames = np.cumsum(gaps).tolist()
    last = (frames[-1] if frames else 0) + 3
    moving = data.draw(st.lists(st.booleans(), min_size=last, max_size=last))
    before = [sum(moving[:f]) for f in frames]
    kept = list(range(len(frames)))
    lively = lambda a, b: b - a < 2 or any(moving[a:b])
    while True:
        edges = [0, *(frames[k] for k in kept), last]
        bad = [j for j in range(len(kept)) if not lively(edges[j], edges[j + 1]) and not lively(edges[j + 1], edges[j + 2])]
        if not bad:
            break
        del kept[bad[0]]
    assert E.drop_static(frames, before, (last, sum(moving))) == kept


def test_joined_rows_keep_what_is_theirs(spark):
    df = labels(spark, [(0, 30, "grasp", "left", "low"), (30, 60, "grasp", "left", "high"), (60, 64, "place", "left", "low")], 100)
    df = df.withColumn("events", F.array(F.struct(F.col("start").alias("frame"), F.lit("grasp").alias("type"))))
    merged = I.merge_adjacent(df)
    got = spans(merged, "start", "sentence", "start_source", "end_source", "events")
    assert [(a, b, c, d, [x["frame"] for x in e]) for a, b, c, d, e in got] == [(0, "grasp from 30", "label", "to 60", [0, 30]), (60, "place from 60", "label", "to 64", [60])]
    short = spans(I.enforce_min_length(merged, least=10), "start", "end", "sentence", "start_source", "end_source", "events")
    assert [(*r[:5], [x["frame"] for x in r[5]]) for r in short] == [(0, 64, "grasp from 30", "label", "to 64", [0, 30, 60])]
    filled = spans(I.insert_idle(merged, idle_gap_s=0.5), "start", "action", "sentence", "start_source", "end_source")
    assert filled[:2] == [(0, "grasp", "grasp from 30", "label", "to 60"), (60, "place", "place from 60", "label", "to 64")]
    assert filled[2][1] == "idle" and filled[2][2] in V.IDLE_SENTENCES and filled[2][3:] == ("idle_gap", "idle_gap")


def test_idle(spark):
    rows = [(20, 60, "grasp", "left", "high"), (80, 120, "grasp", "left", "high"), (160, 200, "grasp", "left", "high")]
    assert spans(I.insert_idle(labels(spark, rows, 300)), "start", "end", "source") == [(0, 80, "label"), (80, 120, "label"), (120, 160, "idle_gap"), (160, 200, "label"), (200, 299, "idle_gap")]
    exact = labels(spark, [(0, 60, "grasp", "left", "high"), (90, 120, "grasp", "left", "high")], 121)
    assert spans(I.insert_idle(exact), "start", "end") == [(0, 90), (90, 120)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 50), st.sampled_from(["grasp", "place"]), st.sampled_from(["low", "high"])), min_size=1, max_size=6))
def test_assembled_rows_are_valid(spark, drawn):
    from framewell.plans import assembly

    rows, at = [], 0
    for gap, size, action, confidence in drawn:
        rows.append((at + gap, at + gap + size, action, "left", confidence))
        at += gap + size
    out = assembly.assemble(labels(spark, rows, at + 20), least=1)
    assert C.violations(out).count() == 0


def test_stitching():
    rows = [{"start": a, "end": b, "action": act, "hand": "both", "object": o, "confidence": c} for a, b, act, o, c in ((0, 50, "grasp", "cup", "medium"), (10, 60, "grasp", "the cup", "high"), (55, 90, "place", "cup", "high"), (60, 70, "lift", "cup", "low"))]
    got = [(r["start"], r["end"], r["action"], r["object"]) for r in I.resolved(I.clusters(sorted(rows, key=lambda r: (r["start"], r["end"])), 0.5))]
    assert got == [(0, 57, "grasp", "the cup"), (57, 90, "place", "cup")]


def test_stitching_looks_past_hands():
    rows = [{"start": a, "end": b, "action": "grasp", "hand": h, "object": o, "confidence": c, "sentence": s} for a, b, h, o, c, s in ((0, 50, "left", "cup", "low", "x"), (5, 55, "both", "The cup", "high", "y"))]
    assert list(I.resolved(I.clusters(rows, 0.5))) == [{"start": 0, "end": 55, "action": "grasp", "hand": "both", "object": "The cup", "confidence": "high", "sentence": "y"}]
    assert list(I.resolved(I.clusters(rows, 0.99))) == [{"start": 0, "end": 55, "action": "grasp", "hand": "both", "object": "The cup", "confidence": "high", "sentence": "y"}]


def step(a, b, action, ongoing=False):
    return {"start": a, "end": b, "action": action, "ongoing": ongoing}


def test_open_tail():
    tail = step(26, 47, "place", True)
    done, new = W.hand_over(tail, [step(26, 74, "place"), step(78, 95, "retract"), step(86, 95, "reach", True)], 48)
    assert [(r["start"], r["end"]) for r in done] == [(26, 74), (78, 95)] and new is None
    done, new = W.hand_over(tail, [step(48, 60, "reach")], 48)
    assert [(r["start"], r["end"]) for r in done] == [(26, 47), (48, 60)] and new is None
    assert W.hand_over(tail, [], 48) == ([], tail)


def test_windows(spark):
    one = lambda n: spark.createDataFrame([("e", n)], "key string, n_frames long")
    got = [(r["w_start"], r["w_end"]) for r in W.sliding(one(449)).orderBy("w").collect()]
    assert got == [(0, 95), (64, 159), (128, 223), (192, 287), (256, 351), (320, 415), (384, 448)]
    assert [(r["w_start"], r["w_end"]) for r in W.tumbling(one(141)).orderBy("w").collect()] == [(0, 47), (48, 95), (96, 140)]
    assert [(r["w_start"], r["w_end"]) for r in W.tumbling(one(1)).collect()] == [(0, 0)]


def test_boundary_f1(spark):
    rows = [("a", "e", f) for f in (10, 50, 100)] + [("b", "e", f) for f in (20, 120)] + [("c", "z", 5)]
    keys = spark.createDataFrame([("e",), ("z",), ("none",)], "key string")
    got = {(r["config"], r["other"]): r["f1"] for r in R.boundary_f1(spark.createDataFrame(rows, "config string, key string, frame long"), keys, 15).collect()}
    assert got[("a", "b")] == got[("b", "a")] == pytest.approx((0.4 + 1 + 1) / 3, abs=1e-6)
    assert got[("a", "c")] == pytest.approx(1 / 3, abs=1e-6)


def test_reports(spark):
    df = spark.createDataFrame([("k", True), ("k", False), ("k", None), ("k", True)], "k string, ok boolean")
    assert tuple(R.judged(df, ["k"], "ok").first()) == ("k", 0.666667, 3)
    verbs = spark.createDataFrame([("k", v) for v in "abcc"], "k string, v string")
    assert R.entropy(verbs, ["k"], "v").first()["bits"] == 1.5
    lengths = spark.createDataFrame([("k", v) for v in (9, 17, 36, 48)], "key string, v int")
    assert I.upper_median(lengths, F.col("v")).first()["upper_median"] == 36
    both = spark.createDataFrame([("ep1", "a"), ("ep1", "b"), ("ep2", "a")], "ep string, config string")
    assert [r["ep"] for r in J.in_all(both, "ep", "config").collect()] == ["ep1"]


def test_hand_decision(spark):
    rows = [(1.0, 9.0, True, False, False, False, "left"), (1.0, 2.0, False, False, False, False, "right"), (2.0, 2.0, False, False, False, False, "left"), (7.0, 2.0, True, True, True, False, "left"), (2.0, 2.0, True, True, True, False, "both_coordinating"), (2.0, 2.0, True, True, False, True, "both_coordinating"), (2.0, 2.0, True, True, False, False, "both")]
    df = spark.createDataFrame(rows, "a double, b double, c boolean, d boolean, e boolean, f boolean, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", H.decide(*[F.col(c) for c in "abcdef"]).alias("got")).collect())


def test_violations(spark):
    rows = [("ok", 0, 0, 10, "grasp", "left", 21), ("ok", 1, 10, 20, "place", "both", 21), ("bad", 0, 2, 10, "dance", "left", 21), ("bad", 2, 12, 19, "place", "foot", 21)]
    df = spark.createDataFrame(rows, "key string, id long, start long, end long, action string, hand string, n_frames long")
    got = {(r["id"], r["rule"]) for r in C.violations(df).collect()}
    assert got == {(0, "action"), (0, "start"), (2, "ids"), (2, "contiguous"), (2, "end"), (2, "hand")}
    good, bad = C.split_valid(df)
    assert {r["key"] for r in good.collect()} == {"ok"} and {r["key"] for r in bad.collect()} == {"bad"}


def test_labeling(spark):
    answer = json.dumps({"action": "grasp", "hand": "left", "object": "cup", "sentence": "takes it", "confidence": "high"})
    segments = spark.createDataFrame([("e", 0, "one"), ("e", 1, "two"), ("g", 0, "three")], "key string, id long, prompt string")

    def make():
        return Replay({"one": f"```json\n{answer}\n```", "Before: takes it\ntwo": "no json", "three": answer})

    got = {(r["key"], r["id"]): (r["action"], r["attempts"], r["fell_back"]) for r in L.label_segments(segments, make, wait_s=0).collect()}
    assert got == {("e", 0): ("grasp", 1, False), ("e", 1): ("other", 3, True), ("g", 0): ("grasp", 1, False)}
    with pytest.raises(ValueError):
        L.ask(lambda p: "no json", "x", strict=True)


def test_cross_flags(spark):
    rows = [(1, 0, 100, "pick", "high", False), (1, 100, 200, "place", "low", True), (1, 200, 300, "drop", "high", None), (1, 300, 400, "pick", "high", False), (2, 0, 50, "lift", "high", False), (2, 50, 90, "stack", "high", True)]
    segments = spark.createDataFrame(rows, "key long, start long, end long, action string, confidence string, hand_disagreement boolean")
    # Inside and far from both ends, at the tolerance, one frame beyond it, and of the other type or key.
    events = spark.createDataFrame([(1, 50, "grasp"), (1, 185, "release"), (1, 416, "grasp"), (1, 350, "release"), (3, 20, "grasp")], "key long, frame long, type string")
    got = {(r["key"], r["start"]): r["flags"] for r in I.cross_flagged(segments, events).collect()}
    assert got == {(1, 0): [], (1, 100): ["low_confidence", "hand_disagreement"], (1, 200): [], (1, 300): ["kinematic_mismatch"], (2, 0): ["kinematic_mismatch"], (2, 50): ["hand_disagreement"]}
    later = {r["start"]: r["flags"] for r in I.cross_flagged(segments.filter("key = 1 AND start = 300"), events, tolerance=16).collect()}
    assert later == {300: []}


def test_sentences_and_times_are_checked(spark):
    rows = [(1, 0, 0, 30, "Picks it.", 0.0, 1.0, 1.0), (1, 1, 30, 60, " \t", 1.0 + 5e-7, 2.0, 1.0), (1, 2, 60, 90, None, 2.0, 3.1, None)]
    df = spark.createDataFrame([(*r, "pick", "left", 91) for r in rows], "key long, id int, start long, end long, sentence string, start_time double, end_time double, duration double, action string, hand string, n_frames long")
    got = sorted((r["id"], r["rule"]) for r in C.violations(df, fps=30.0).collect())
    assert got == [(1, "sentence"), (2, "duration"), (2, "end_time"), (2, "sentence")]


def test_sums_inside_are_of_the_segments_own_frames(spark):
    """Large values before a segment take nothing from its sum, and segments that overlap or hold no frame have theirs."""
    draw = random.Random(11)
    value = {(k, f): 1e17 if f == 3 else draw.randrange(1, 900) / 100 for k in range(3) for f in range(2600) if f % 7 != 5}
    spans = [(0, 3), (3, 9), (9, 9), (9, 20), (15, 2200), (16, 17), (16, 17), (20, 40), (40, 2590), (2000, 2010), (2606, 2607)]
    segments = spark.createDataFrame([(k, i, a, b) for k in range(3) for i, (a, b) in enumerate(spans)], "key long, id long, start long, end long")
    frames = spark.createDataFrame([(k, f, v) for (k, f), v in value.items()], "key long, frame long, v double")
    got = {(r["key"], r["id"]): (r["frames"], r["a"], r["b"]) for r in H.inside_sums(segments, frames, {"a": F.col("v")}, {"b": F.col("v") * 2}).collect()}
    assert len(got) == 3 * len(spans)
    for (key, i), (n, a, b) in got.items():
        start, end = spans[i]
        own = [v for (k, f), v in value.items() if k == key and start <= f <= end]
        steps = [2 * v for (k, f), v in value.items() if k == key and start < f <= end]
        assert n == len(own) and a == pytest.approx(sum(own), rel=1e-12) and b == pytest.approx(sum(steps), rel=1e-12)


def test_activity_at_its_limit_is_what_the_plain_mean_gives(spark):
    """Means that are 0.04 but for rounding, on either side of it; doubles are added one by one, as ``sum`` does not."""
    draw, cases = random.Random(12), {True: [], False: []}
    while min(map(len, cases.values())) < 3:
        cents = [draw.randrange(9) for _ in range(6)]
        cents.append(28 - sum(cents))
        if cents[-1] >= 0:
            cases[functools.reduce(operator.add, (c / 100 for c in cents)) / 7 > 0.04].append(cents)
    told = [(active, cents) for active in cases for cents in cases[active][:3]]
    rows = [(key, f, c / 100, 0.0, 0.0, 0.0) for key, (_, cents) in enumerate(told) for f, c in enumerate(cents)]
    frames = spark.createDataFrame(rows, "key long, frame long, speed_left double, speed_right double, aperture_left double, aperture_right double")
    segments = spark.createDataFrame([(k, 0, 0, 6) for k in range(len(told))], "key long, id long, start long, end long")
    assert {r["key"]: r["active_left"] for r in H.activity(segments, frames).collect()} == {k: active for k, (active, _) in enumerate(told)}
