"""Labelling of segments by a pluggable model, with retries and fallbacks. No model is part of this package: a Labeler is any callable from a prompt to a text."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators.folds import fold_keys

Labeler = Callable[[str], str]
FALLBACK = {"action": "other", "hand": "both", "object": "none", "sentence": "unlabelled", "confidence": "low"}


def parse(text: str) -> dict | None:
    """FN1, SEL15: the object between the outer braces if its words are known and its texts are not empty, else None."""
    try:
        got = json.loads(text[text.index("{") : text.rindex("}") + 1])
    except ValueError:
        return None
    ok = isinstance(got, dict) and got.get("action") in V.ACTIONS and got.get("confidence") in V.CONFIDENCES and got.get("object") and got.get("sentence")
    return {k: str(got.get(k, FALLBACK[k])) for k in FALLBACK} if ok else None


def ask(labeler: Labeler, prompt: str, *, attempts: int = 3, wait_s: float = 2.0, strict: bool = False) -> tuple[dict, int, bool]:
    """UDF4, UDF5: the label, how many attempts it took, and whether it is the fallback. Broken answers are asked for again at once, other errors after a growing wait."""
    for attempt in range(1, attempts + 1):
        try:
            if (label := parse(labeler(prompt))) is not None:
                return label, attempt, False
        except Exception:
            if attempt == attempts and strict:
                raise
            time.sleep(wait_s * 2 ** (attempt - 1) if attempt < attempts else 0)
    if strict:
        raise ValueError("no usable answer")
    return dict(FALLBACK), attempts, True


def label_segments(segments: DataFrame, make: Callable[[], Labeler], *, story: int = V.STORY, attempts: int = 3, wait_s: float = 2.0, strict: bool = False) -> DataFrame:
    """UDF3 to UDF6: labels the segments (key, id, prompt) of each key in order, each prompt with the last few sentences before it.

    ``make`` gives a worker its Labeler. A key's segments depend on each other, keys do not. Adds action, hand, object, sentence, confidence, attempts and fell_back.
    DRV2: with ``strict`` there is no fallback: a segment without a usable answer gives a row with ``error`` and no label, and ends its own key's labelling only.
    """
    labelers: list[Labeler] = []

    def told_in_order(rows: list[tuple]) -> list[tuple]:
        if not labelers:
            labelers.append(make())
        told, out = [], []
        for nth, text in rows:
            prompt = "\n".join([*(f"Before: {t}" for t in told[-story:]), text])
            try:
                label, tries, fell = ask(labelers[0], prompt, attempts=attempts, wait_s=wait_s, strict=strict)
            except Exception as e:
                out.append((nth, *(None for _ in FALLBACK), attempts, False, repr(e)))
                break
            told.append(label["sentence"])
            out.append((nth, *(label[c] for c in FALLBACK), tries, fell, None))
        return out if strict else [r[:-1] for r in out]

    schema = "id long, action string, hand string, object string, sentence string, confidence string, attempts int, fell_back boolean" + ", error string" * strict
    # Dealt by number: how long answers take doesn't show in the prompts' bytes, by which few and large partitions would be made.
    dealt = segments.select("key", F.col("id").cast("long").alias("id"), "prompt").repartition(tasks_of(segments), "key")
    return fold_keys(dealt, ["id", "prompt"], ["id"], told_in_order, schema)


def tasks_of(df: DataFrame) -> int:
    """How many tasks a shuffle has in this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def label_in_rounds(segments: DataFrame, make: Callable[[], Labeler], folder: str, *, story: int = V.STORY, attempts: int = 3, wait_s: float = 2.0, strict: bool = False, calls: int = 8, rows: int = 256) -> DataFrame:
    """UDF6: as ``label_segments``, the i-th segments of all keys in one round, so that a long key holds up no task and waits overlap.

    A round's prompts are dealt to tasks of about ``rows`` segments, which keep ``calls`` calls in flight; a call that fails is tried again alone. The story is what the last rounds have
    written for the key. Rounds are folders in ``folder``, shared by driver and executors: one that is there already is not done again, so that a stopped job goes on where it was.
    With ``strict``, a key whose segment got no usable answer has a row with ``error`` and takes part in no later round.
    """
    spark, kind = segments.sparkSession, segments.schema["key"].dataType.simpleString()
    schema = f"key {kind}, id long, action string, hand string, object string, sentence string, confidence string, attempts int, fell_back boolean, error string, turn int"
    nth = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    dealt, spans = f"{folder}/segments", segments.select("key", F.col("id").cast("long").alias("id"), "prompt").withColumn("turn", nth)
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("turn").parquet(f"{folder}/labels")
    spans.write.mode("overwrite").partitionBy("turn").parquet(dealt)
    todo = spark.read.schema(spans.schema).parquet(dealt)
    sizes = {r["turn"]: r["count"] for r in todo.groupBy("turn").count().collect()}
    done = lambda: spark.read.schema(schema).parquet(f"{folder}/labels")
    there = {r["turn"] for r in done().select("turn").distinct().collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeler = make()

        def one(r: dict) -> dict:
            told = [t for t in (r["told"] if r["told"] is not None else [])]
            prompt = "\n".join([*(f"Before: {t}" for t in told), r["prompt"]])
            try:
                label, tries, fell = ask(labeler, prompt, attempts=attempts, wait_s=wait_s, strict=strict)
            except Exception as e:
                return {"key": r["key"], "id": r["id"], **dict.fromkeys(FALLBACK), "attempts": attempts, "fell_back": False, "error": repr(e)}
            return {"key": r["key"], "id": r["id"], **label, "attempts": tries, "fell_back": fell, "error": None}

        with ThreadPoolExecutor(calls) as pool:
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame(list(pool.map(one, pdf.to_dict("records"))))

    for turn in range(1, max(sizes, default=0) + 1):
        if turn in there:
            continue
        told = done().filter(F.col("turn").between(max(1, turn - story), turn - 1))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "sentence"))), lambda x: x["sentence"])
        own = todo.filter(F.col("turn") == turn).join(told.groupBy("key").agg(lines.alias("told"), F.max("error").alias("_error"), F.max("turn").alias("_last")), "key", "left")
        if turn > 1:
            own = own.filter((F.col("_last") == turn - 1) & F.col("_error").isNull())
        asked = own.select("key", "id", "prompt", "told").repartition(max(1, -(-sizes[turn] // rows)), "key", "id")
        made = asked.mapInPandas(run, schema.rsplit(", ", 1)[0]).withColumn("turn", F.lit(turn))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("turn").parquet(f"{folder}/labels")
    return done().drop("turn", *([] if strict else ["error"]))


def category_block(name: Column, hint: Column, verbs: Column) -> Column:
    """FN5: what a prompt says of the task's category: its name, its hint and the verbs that are common in it, as a prior; an empty text without a category."""
    text = F.concat(F.lit("Task family "), name, F.lit(": "), F.trim(hint), F.lit(" Verbs often seen in it: "), F.array_join(verbs, ", "), F.lit(" (a prior, no rule).\n"))
    return F.when(name.isNotNull(), F.coalesce(text, F.concat(F.lit("Task family "), name, F.lit(".\n")))).otherwise("")


def prompts(segments: DataFrame, *, hint: str | None = None, category: Column | None = None) -> DataFrame:
    """FN4 to FN6: a prompt for each segment (key, id, start, end): the category's block (see category_block), frames, allowed words and a hint."""
    words = "; ".join(f"{g}: {', '.join(a)}" for g, a in V.ACTION_GROUPS.items())
    note = F.coalesce(F.concat(F.lit(" Hint: "), F.col(hint)), F.lit("")) if hint else F.lit("")
    head = category if category is not None else F.lit("")
    text = F.concat(head, F.format_string("What happens from frame %d to %d? Answer as JSON with action, hand, object, sentence, confidence. ", "start", "end"), F.lit(f"Actions are {words}."), note)
    return segments.withColumn("prompt", text)


#: UDF3: the labelers that a configuration may name; programs add theirs.
BACKENDS: dict[str, Callable[..., Labeler]] = {}


def backend(config: dict) -> Callable[[], Labeler]:
    """UDF3: what makes a worker's Labeler, by the configuration's ``backend`` and with the rest of it as arguments."""
    rest = {k: v for k, v in config.items() if k != "backend"}
    try:
        made = BACKENDS[config["backend"]]
    except KeyError:
        raise ValueError(f"backend must be one of {sorted(BACKENDS)}") from None
    return lambda: made(**rest)


def batches(rows: Iterator[pd.DataFrame], make: Callable[[], Labeler]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: labels of independent prompts (prompt), without a story."""
    labeler = make()
    for pdf in rows:
        yield pd.DataFrame([ask(labeler, p)[0] for p in pdf["prompt"]], columns=list(FALLBACK))
