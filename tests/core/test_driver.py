"""The level driver: resumption, isolation of keys that fail, and files that earlier runs have left."""

import json
from pathlib import Path

import pytest
from framewell import queries as core
from framewell.operators.folds import fold_keys
from framewell.plans import driver, labeling
from framewell.sources import tables
from framewell.sources.commits import Store
from pyspark.sql import functions as F

SMALL = "key < 14"


@pytest.fixture(scope="module")
def given(spark, tiny):
    series, events = core._series(spark, tiny)
    return series.filter(SMALL).cache(), events.filter(SMALL).cache()


def levels(spark, folder, make=None, **more):
    propose = {"least": 5, "window": 4, "pause_speed": 20.0, "prominence": 10.0, "gaze_floor": 20.0, "move": 60.0}
    return driver.Levels(spark, str(folder), make or (lambda: core._answers), least=8, idle_gap_s=0.1, propose=propose, label={"wait_s": 0.0, "attempts": 2}, **more)


def rows(levels):
    return sorted(map(str, levels.stores["annotations"].read().collect()))


def test_halves_equal_a_whole_and_a_rerun_changes_nothing(spark, given, tmp_path):
    whole = levels(spark, tmp_path / "whole")
    whole.run(*given)
    halves = levels(spark, tmp_path / "halves", mirror=str(tmp_path / "mirror"))
    halves.run(*given, keys=given[0].filter("key % 2 = 0"))
    before = {p: p.read_bytes() for p in (tmp_path / "mirror").rglob("part-*.json")}
    status = {r["level"]: r for r in halves.run(*given).collect()}
    assert rows(halves) == rows(whole) != []
    assert status["boundaries"]["skipped"] > 0 and all(p.read_bytes() == b for p, b in before.items())
    again = {r["level"]: tuple(r)[1:] for r in halves.run(*given).collect()}
    assert again["boundaries"] == (0, given[0].select("key").distinct().count(), 0) and again["annotations"][0] == 0
    assert rows(halves) == rows(whole)
    records = [json.loads(line) for p in sorted((tmp_path / "mirror").rglob("part-*.json")) for line in p.read_text().splitlines()]
    assert sorted({r["key"] for r in records}) == sorted(r["key"] for r in records) and all(r["subtasks"] for r in records)
    assert sorted((tmp_path / "halves/annotations/records").rglob("part-*.json"))


def test_one_bad_key_fails_alone(spark, given, tmp_path):
    keys = sorted(r["key"] for r in given[0].select("key").distinct().collect())
    bad = keys[1]

    def make():
        def answer(prompt):
            return json.dumps({"action": "reach", "hand": "left", "object": "cup", "sentence": "s", "confidence": "high"})

        return answer

    good = levels(spark, tmp_path / "good", make)
    good.run(*given)
    ids = {r["key"] for r in good.stores["annotations"].read().select("key").distinct().collect()}
    assert bad in ids
    # One key's boundaries are broken, so that its absorption raises: a label without a known confidence.
    poisoned = levels(spark, tmp_path / "poisoned", make)
    poisoned.run(*given, levels=(1, 2))
    store = poisoned.stores["labels"]
    broken = store.read().withColumn("confidence", F.when(F.col("key") != bad, F.col("confidence"))).withColumn("error", F.lit(None).cast("string"))
    broken.write.parquet(f"{tmp_path}/broken")
    store.commit(spark.read.parquet(f"{tmp_path}/broken"), broken.select("key"))
    status = {r["level"]: r for r in poisoned.run(*given, levels=(3,)).collect()}["annotations"]
    assert (status["done"], status["failed"]) == (len(ids) - 1, len(keys) - len(ids) + 1)
    assert {r["key"] for r in poisoned.stores["annotations"].read().select("key").distinct().collect()} == ids - {bad}
    held = poisoned.stores["annotations"].quarantine()
    assert {r["key"] for r in held.collect()} == set(keys) - (ids - {bad}) and held.filter(F.col("key") == bad).first()["reason"]
    n = held.count()
    poisoned.run(*given, levels=(3,))
    assert poisoned.stores["annotations"].quarantine().count() == n
    # The key is mended and done in the next run; nothing else is done again.
    mended = good.stores["labels"].read().filter(F.col("key") == bad).withColumn("error", F.lit(None).cast("string"))
    store.commit(mended, mended.select("key"))
    status = {r["level"]: r for r in poisoned.run(*given, levels=(3,)).collect()}["annotations"]
    assert status["done"] == 1 and rows(poisoned) == rows(good)


def test_a_run_that_dies_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path), "long", "v string")
    df = lambda *r: spark.createDataFrame([(*x, None) for x in r], "key long, v string, error string")
    store.commit(df((1, "a"), (2, "b")), df((1, ""), (2, "")))
    store._put("rows", df((3, "half"), (1, "new")), 2)
    assert sorted((r["key"], r["v"]) for r in store.read().collect()) == [(1, "a"), (2, "b")]
    assert [r["key"] for r in store.todo(df((1, ""), (3, ""))).collect()] == [3]
    assert store.commit(df((3, "whole")), df((3, ""), (4, ""))) == 2
    assert sorted((r["key"], r["v"]) for r in store.read().collect()) == [(1, "a"), (2, "b"), (3, "whole")]
    assert [(r["key"], r["error"]) for r in store.runs().filter("status = 'failed'").collect()] == [(4, "no result")]
    # Forced again: a failure keeps what was done before, a success takes its place.
    bad = spark.createDataFrame([(1, None, "broken"), (2, "c", None)], "key long, v string, error string")
    store.commit(bad, bad)
    assert sorted((r["key"], r["v"]) for r in store.read().collect()) == [(1, "a"), (2, "c"), (3, "whole")]
    assert [r["key"] for r in store.todo(bad, force=True).orderBy("key").collect()] == [1, 2] and store.todo(bad).count() == 0


def test_folds_that_raise(spark):
    df = spark.createDataFrame([(k, i) for k in range(40) for i in range(5)], "key long, i long")

    def fold(rows):
        if rows[0][0] == 0 and len(rows) == 5 and fold_key_is_bad(rows):
            raise ValueError("bad")
        return rows

    def fold_key_is_bad(rows):
        return rows[-1][1] % 7 == 3

    typed = df.withColumn("k", F.col("key"))
    out = fold_keys(typed, ["i", "k"], ["i"], fold, "i long, k long", errors=True)
    bad = sorted(r["key"] for r in out.filter("error IS NOT NULL").collect())
    assert bad == [k for k in range(40) if k % 7 == 3]
    assert out.filter("error IS NULL").count() == 5 * (40 - len(bad)) and out.filter("error IS NOT NULL AND i IS NOT NULL").count() == 0


def test_strict_labels(spark):
    rows = spark.createDataFrame([(k, i, f"{k} {i}") for k in range(4) for i in range(3)], "key long, id long, prompt string")

    def make():
        def answer(prompt):
            if prompt.endswith("2 1"):
                raise RuntimeError("gone")
            return json.dumps({"action": "reach", "hand": "left", "object": "cup", "sentence": f"did {prompt[-3:]}", "confidence": "high"})

        return answer

    out = labeling.label_segments(rows, make, wait_s=0.0, attempts=2, strict=True).collect()
    assert [(r["key"], r["id"]) for r in out if r["error"]] == [(2, 1)] and len(out) == 11
    assert {r["key"] for r in out if not r["error"] and r["id"] == 2} == {0, 1, 3}


def test_records(spark, given, tmp_path):
    run = levels(spark, tmp_path)
    run.run(*given, levels=(1, 2))
    found = spark.read.json(f"{tmp_path}/boundaries/records").collect()
    sizes = {r["key"]: r["n"] for r in tables.frames(spark, "/root/testdata/sf0.001").groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in found:
        frames = [b["frame"] for b in r["boundaries"]]
        assert frames[0] == 0 and frames[-1] == r["n_frames"] - 1 == sizes[r["key"]] - 1 and frames == sorted(frames)
        assert r["boundaries"][0]["source"] == "episode_start" and r["boundaries"][-1]["source"] == "episode_end" and len(r["segments"]) == len(frames) - 1
    labels = spark.read.json(f"{tmp_path}/labels/records").collect()
    assert labels and all(s["label"]["action"] in ("reach", "grasp", "place") and s["attempts"] == 1 for r in labels for s in r["segments"])


def test_rounds_label_as_key_by_key(spark, tmp_path):
    """The same labels, each failing call tried again alone, and a stopped job goes on with the round after its last."""
    from pathlib import Path

    rows = spark.createDataFrame([(k, i, f"segment {k} {i}") for k in range(6) for i in range(k + 1)], "key long, id long, prompt string")
    log = tmp_path / "calls"
    log.mkdir()

    def make():
        def answer(prompt):
            with open(f"{log}/{abs(hash(prompt))}", "a") as file:
                file.write("x")
            if prompt.endswith("3 1") and Path(f"{log}/{abs(hash(prompt))}").stat().st_size == 1:
                raise RuntimeError("once")
            return json.dumps({"action": "reach", "hand": "left", "object": "cup", "sentence": f"did {prompt[-3:]} after {prompt.count('Before')}", "confidence": "high"})

        return answer

    def plain():
        return lambda prompt: json.dumps({"action": "reach", "hand": "left", "object": "cup", "sentence": f"did {prompt[-3:]} after {prompt.count('Before')}", "confidence": "high"})

    columns = ["key", "id", "action", "hand", "object", "sentence", "confidence", "fell_back"]
    want = sorted(map(tuple, labeling.label_segments(rows, plain, wait_s=0.0).select(*columns).collect()))
    got = labeling.label_in_rounds(rows, make, str(tmp_path / "rounds"), wait_s=0.0)
    assert sorted(map(tuple, got.select(*columns).collect())) == want and len(want) == 21
    assert [r["id"] for r in got.filter("attempts > 1").collect()] == [1]
    calls = sum(p.stat().st_size for p in log.iterdir())
    assert calls == 22
    import shutil

    shutil.rmtree(tmp_path / "rounds/labels/turn=6")
    again = labeling.label_in_rounds(rows, make, str(tmp_path / "rounds"), wait_s=0.0)
    assert sorted(map(tuple, again.select(*columns).collect())) == want
    assert sum(p.stat().st_size for p in log.iterdir()) == calls + 1


def test_backends():
    labeling.BACKENDS["echo"] = lambda word="a": lambda prompt: word + prompt
    try:
        assert labeling.backend({"backend": "echo", "word": "b"})()("c") == "bc"
    finally:
        del labeling.BACKENDS["echo"]
    with pytest.raises(ValueError, match="backend must be one of"):
        labeling.backend({"backend": "none"})
