"""One query for each operator over the given tables, with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions import vocabulary as V
from .operators import events as E
from .operators import hands as H
from .operators import intervals as I
from .operators import joins as J
from .operators import reports as R
from .operators import restitch as RS
from .operators import selection as P
from .operators import signals as G
from .operators import windows as W
from .plans import assembly as A
from .plans import audit as U
from .plans import constraints as C
from .plans import driver as D
from .plans import labeling as L
from .sources import commits, files
from .sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

FRAMES = """f AS (
  SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS x, event_type AS kind, event_type <> 'error' AS valid FROM events
)"""
SEGMENTS = FRAMES + """, fr AS (
  SELECT *, sum(CASE WHEN kind = prev THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY frame) AS run
  FROM (SELECT *, lag(kind) OVER (PARTITION BY key ORDER BY frame) AS prev FROM f)
), rr AS (
  SELECT key, run, min(frame) AS start, max(frame) AS last, any_value(kind) AS kind, arg_max(x, frame) AS x FROM fr GROUP BY key, run
), s0 AS (
  SELECT key, start, coalesce(lead(start) OVER (PARTITION BY key ORDER BY run), last) AS "end",
         CASE WHEN kind IN ('view', 'click') THEN 'reach' WHEN kind = 'purchase' THEN 'grasp' ELSE 'place' END AS action,
         CASE WHEN x < 20 THEN 'left' ELSE 'right' END AS hand, CASE WHEN x < 60 THEN 'the cup' ELSE 'cup' END AS object,
         CASE WHEN x < 15 THEN 'low' WHEN x < 50 THEN 'medium' ELSE 'high' END AS confidence, kind || ' ' || start AS sentence, kind AS start_source,
         coalesce(lead(kind) OVER (PARTITION BY key ORDER BY run), 'episode_end') AS end_source, max(last) OVER (PARTITION BY key) + 1 AS n_frames
  FROM rr
), s AS (SELECT * FROM s0 WHERE "end" > start)"""
PEAKS = """, pk0 AS (
  SELECT *, sum(CASE WHEN x = p THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY frame) AS r
  FROM (SELECT *, lag(x) OVER (PARTITION BY key ORDER BY frame) AS p FROM f)
), pk1 AS (SELECT key, r, min(frame) AS a, max(frame) AS b, any_value(x) AS x FROM pk0 GROUP BY key, r
), pk2 AS (SELECT *, lag(x) OVER (PARTITION BY key ORDER BY r) AS p, lead(x) OVER (PARTITION BY key ORDER BY r) AS n FROM pk1
), pk AS (SELECT key, ((a + b) // 2)::BIGINT AS frame, x AS height FROM pk2 WHERE x > p AND x > n)"""


_CRC = [0] * 16
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text, four bits at a time."""
    digits = f"list_transform(range(0, 2 * length({text})), lambda i: ('0x' || substr(hex(encode({text})), (i // 2 * 2 + 2 - i % 2)::INT, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda a, x: xor(a >> 4, {_CRC}[xor(a & 15, x) + 1])), 4294967295::BIGINT)"


def peaks_sql(name: str, source: str) -> str:
    """CTEs up to ``name`` (key, frame, height): the peaks of ``source`` (key, frame, x)."""
    return f"""{name}_0 AS (SELECT *, sum(CASE WHEN x = p THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY frame) AS r FROM (SELECT key, frame, x, lag(x) OVER (PARTITION BY key ORDER BY frame) AS p FROM {source})),
{name}_1 AS (SELECT key, r, min(frame) AS a, max(frame) AS b, any_value(x) AS x FROM {name}_0 GROUP BY key, r),
{name}_2 AS (SELECT *, lag(x) OVER (PARTITION BY key ORDER BY r) AS p, lead(x) OVER (PARTITION BY key ORDER BY r) AS n FROM {name}_1),
{name} AS (SELECT key, ((a + b) // 2)::BIGINT AS frame, x AS height FROM {name}_2 WHERE x > p AND x > n)"""


def minima_sql(name: str, source: str, prominence: float) -> str:
    """CTEs up to ``name`` (key, frame, depth, prominence): the minima of ``source`` by the definition of prominence."""
    return f"""{name}_n AS (SELECT key, frame, -x AS x FROM {source}), {peaks_sql(f"{name}_p", f"{name}_n")},
{name}_e AS (SELECT *, coalesce((SELECT max(g.frame) FROM {name}_n g WHERE g.key = p.key AND g.frame < p.frame AND g.x > p.height), -1) AS l,
  coalesce((SELECT min(g.frame) FROM {name}_n g WHERE g.key = p.key AND g.frame > p.frame AND g.x > p.height), 1000000000) AS r FROM {name}_p p),
{name}_b AS (SELECT *, greatest((SELECT min(g.x) FROM {name}_n g WHERE g.key = e.key AND g.frame > l AND g.frame <= e.frame), (SELECT min(g.x) FROM {name}_n g WHERE g.key = e.key AND g.frame >= e.frame AND g.frame < r)) AS base FROM {name}_e e),
{name} AS (SELECT key, frame, -height AS depth, height - base AS prominence FROM {name}_b WHERE height - base >= {prominence})"""


def fuse_sql(window: int, least: int, move: float) -> str:
    """CTEs up to ``fused`` (key, frame, prio, magnitude, source) from ``cand`` (key, frame, ord, prio, magnitude, source) and ``f`` (x is the speed): merged, thinned, and lively."""
    return f"""cr AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY frame, ord, prio, magnitude) AS rn FROM cand),
mt AS (
  SELECT key, rn, frame AS kf, prio AS kp, magnitude AS km, source AS ks, NULL::BIGINT AS of, NULL::INT AS op, NULL::DOUBLE AS om, NULL::VARCHAR AS os FROM cr WHERE rn = 1
  UNION ALL
  SELECT key, rn, CASE WHEN far OR wins THEN frame ELSE kf END, CASE WHEN far OR wins THEN prio ELSE kp END, CASE WHEN far OR wins THEN magnitude ELSE km END, CASE WHEN far OR wins THEN source ELSE ks END,
         CASE WHEN far THEN kf END, CASE WHEN far THEN kp END, CASE WHEN far THEN km END, CASE WHEN far THEN ks END
  FROM (SELECT c.*, t.kf, t.kp, t.km, t.ks, c.frame - t.kf > {window} AS far, (c.prio, c.magnitude) > (t.kp, t.km) AS wins FROM mt t JOIN cr c ON c.key = t.key AND c.rn = t.rn + 1)
), ml AS (SELECT key, max(rn) AS rn FROM cr GROUP BY key),
mg AS (SELECT key, of AS frame, op AS prio, om AS magnitude, os AS source FROM mt WHERE of IS NOT NULL UNION ALL SELECT mt.key, kf, kp, km, ks FROM mt JOIN ml ON ml.key = mt.key AND ml.rn = mt.rn),
ft AS (SELECT key, max(frame) AS last FROM f GROUP BY key),
ti AS (SELECT key, list({{'f': frame, 'p': prio, 'm': magnitude, 's': source}} ORDER BY frame) AS l FROM mg JOIN ft USING (key) WHERE frame BETWEEN {least} AND last - {least} GROUP BY key),
th AS (
  SELECT key, l, coalesce(list_position(list_transform(range(1, len(l)), lambda i: l[i + 1].f - l[i].f < {least}), TRUE), 0) AS j FROM ti
  UNION ALL
  SELECT key, l, coalesce(list_position(list_transform(range(1, len(l)), lambda i: l[i + 1].f - l[i].f < {least}), TRUE), 0)
  FROM (SELECT key, list_filter(l, lambda x, i: i <> CASE WHEN (l[j].p, l[j].m) <= (l[j + 1].p, l[j + 1].m) THEN j ELSE j + 1 END) AS l FROM th WHERE j > 0)
), tb AS (SELECT key, unnest(l, recursive := true) FROM th WHERE j = 0),
ts AS (SELECT *, coalesce(lag(f) OVER w, 0) AS b, coalesce(lead(f) OVER w, last) AS e FROM tb JOIN ft USING (key) WINDOW w AS (PARTITION BY key ORDER BY f)),
fused AS (
  SELECT key, f AS frame, p AS prio, m AS magnitude, s AS source FROM ts
  WHERE f - b < 2 OR e - f < 2 OR EXISTS (SELECT 1 FROM f g WHERE g.key = ts.key AND g.frame >= b AND g.frame < e AND g.x >= {move})
  UNION ALL SELECT key, 0, 0, 0.0, 'episode_start' FROM ft UNION ALL SELECT key, last, 0, 0.0, 'episode_end' FROM ft
)"""


def absorb_sql(source: str, least: int) -> str:
    """CTEs up to ``ab`` (key, start, end, and labels): the rows of ``source`` after INT5."""
    span, rank = "x.\"end\" - x.start", "CASE x.confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
    weights = f"list_transform(l, lambda x: ({rank}) * 1000000 + {span})"
    shortest = f"list_position(list_transform(l, lambda x: {span}), list_min(list_transform(l, lambda x: {span})))"
    go = f"len(l) > 1 AND list_min(list_transform(l, lambda x: {span})) < {least}"
    fields = ("action", "hand", "object", "confidence", "sentence")
    says = ", ".join(f"'{c}': CASE WHEN w[a] >= w[a + 1] THEN l[a].{c} ELSE l[a + 1].{c} END" for c in fields)
    row = "{'start': l[a].start, 'end': l[a + 1].\"end\", " + says + ", 'start_source': l[a].start_source, 'end_source': l[a + 1].end_source, 'n_frames': l[a].n_frames}"
    first = "{'start': start, 'end': \"end\", " + ", ".join(f"'{c}': {c}" for c in fields) + ", 'start_source': start_source, 'end_source': end_source, 'n_frames': n_frames}"
    return f"""ar AS (
  SELECT key, list({first} ORDER BY start, "end") AS l FROM {source} GROUP BY key
  UNION ALL
  SELECT key, list_concat(l[1:a - 1], [{row}], l[a + 2:]) FROM (
    SELECT key, l, w, CASE WHEN i = len(l) OR (i > 1 AND w[greatest(i - 1, 1)] >= w[least(i + 1, len(l))]) THEN i - 1 ELSE i END AS a FROM (SELECT key, l, {weights} AS w, {shortest} AS i FROM ar WHERE {go})
  )
), ab AS (SELECT key, unnest(l, recursive := true) FROM ar WHERE NOT ({go}))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Signals.


@query("sig3_fill_gaps", f"""WITH {FRAMES}, g AS (
  SELECT *, last_value(CASE WHEN valid THEN frame END IGNORE NULLS) OVER b AS pf, last_value(CASE WHEN valid THEN x END IGNORE NULLS) OVER b AS pv,
         first_value(CASE WHEN valid THEN frame END IGNORE NULLS) OVER a AS nf, first_value(CASE WHEN valid THEN x END IGNORE NULLS) OVER a AS nv
  FROM f WINDOW b AS (PARTITION BY key ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY key ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), h AS (SELECT *, coalesce(NOT valid AND nf - pf - 1 <= 2, FALSE) AS fits FROM g)
SELECT key, frame, round(CASE WHEN fits THEN pv + (nv - pv) * (frame - pf) / (nf - pf) ELSE x END, 6) AS filled, NOT valid AND NOT fits AS masked FROM h""")
def sig3_fill_gaps(spark, sf):
    return G.fill_gaps(T.frames(spark, sf), "x", "valid", max_gap=2).select("key", "frame", F.round("filled", 6).alias("filled"), "masked")


@query("sig4_smooth", f"""WITH {FRAMES}, l AS (SELECT key, list(x ORDER BY frame) AS v, count(*) AS n FROM f GROUP BY key),
g AS (SELECT f.key, frame, v, greatest(0, least(frame - 7, n - 15)) AS s FROM f JOIN l USING (key))
SELECT key, frame, round(list_dot_product(v[s + 1:s + 15], ({G.smoothing_rows(15, 3)}::DOUBLE[][])[frame - s + 1]), 6) AS smooth FROM g""")
def sig4_smooth(spark, sf):
    return G.smooth(T.frames(spark, sf), "x").select("key", "frame", F.round("smooth", 6).alias("smooth"))


@query("sig5_speed", f"""WITH {FRAMES}, g AS (SELECT *, abs(x - lag(x) OVER w) * 30 AS d, row_number() OVER w AS i FROM f WINDOW w AS (PARTITION BY key ORDER BY frame))
SELECT key, frame, round(CASE WHEN i = 1 THEN lead(d) OVER (PARTITION BY key ORDER BY frame) ELSE d END, 6) AS speed FROM g""")
def sig5_speed(spark, sf):
    return G.speed(T.frames(spark, sf), ["x"]).select("key", "frame", F.round("speed", 6).alias("speed"))


def _poses(spark, sf):
    line = Window.partitionBy("label").orderBy("vec_id")
    v = T.read(spark, sf, "embeddings")
    return v.select(F.col("label").alias("key"), (F.row_number().over(line) - 1).cast("long").alias("frame"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"p{i}") for i in range(6)], F.transform(F.slice("embedding", 1, 9), lambda x: x * 3).alias("rotation"))


POSES = """p AS (SELECT label AS key, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding::DOUBLE[] AS e, list_transform(embedding[1:9], lambda x: x * 3::FLOAT)::DOUBLE[] AS r FROM embeddings)"""


@query("sig6_angular_speed", f"""WITH {POSES}, g AS (SELECT *, lag(r) OVER (PARTITION BY key ORDER BY frame) AS q FROM p),
h AS (SELECT key, frame, CASE WHEN q IS NOT NULL THEN acos(greatest(-1.0, least(1.0, (list_dot_product(r, q) - 1) / 2))) * 30 END AS a FROM g)
SELECT key, frame, round(CASE WHEN frame = 0 THEN lead(a) OVER (PARTITION BY key ORDER BY frame) ELSE a END, 3) AS angular_speed FROM h""")
def sig6_angular_speed(spark, sf):
    return G.angular_speed(_poses(spark, sf), "rotation").select("key", "frame", F.round("angular_speed", 3).alias("angular_speed"))


@query("sig7_aperture", f"""WITH {POSES} SELECT key, frame, round(sqrt((e[1] - e[4]) ** 2 + (e[2] - e[5]) ** 2 + (e[3] - e[6]) ** 2), 6) AS aperture FROM p""")
def sig7_aperture(spark, sf):
    return _poses(spark, sf).select("key", "frame", F.round(G.distance(["p0", "p1", "p2"], ["p3", "p4", "p5"]), 6).alias("aperture"))


@query("sig8_gradient", f"""WITH {FRAMES}, g AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM f WINDOW w AS (PARTITION BY key ORDER BY frame))
SELECT key, frame, round(CASE WHEN b IS NULL THEN a - x WHEN a IS NULL THEN x - b ELSE (a - b) / 2 END * 30, 6) AS gradient FROM g""")
def sig8_gradient(spark, sf):
    return G.gradient(T.frames(spark, sf), "x").select("key", "frame", F.round("gradient", 6).alias("gradient"))


@query("sig11_masked_runs", f"""WITH {FRAMES}, g AS (SELECT *, frame - row_number() OVER (PARTITION BY key ORDER BY frame) AS i FROM f WHERE NOT valid)
SELECT key, min(frame) AS start, max(frame) + 1 AS stop FROM g GROUP BY key, i""")
def sig11_masked_runs(spark, sf):
    return G.runs(T.frames(spark, sf).withColumn("bad", ~F.col("valid")), "bad")


@query("sig14_sanity", f"""WITH {FRAMES}, g AS (SELECT *, abs(x - lag(x) OVER w) AS d, row_number() OVER w AS i FROM f WINDOW w AS (PARTITION BY key ORDER BY frame)),
h AS (SELECT *, CASE WHEN i = 1 THEN lead(d) OVER (PARTITION BY key ORDER BY frame) ELSE d END AS step FROM g),
r AS (SELECT key, max(n) AS longest FROM (SELECT key, count(*) AS n FROM (SELECT *, frame - row_number() OVER (PARTITION BY key ORDER BY frame) AS k FROM f WHERE NOT valid) GROUP BY key, k) GROUP BY key)
SELECT key, count(*) AS frames, min(x) AS low, max(x) AS high, round(quantile_cont(step, 0.5), 6) AS median_step, round(quantile_cont(step, 0.95), 6) AS p95_step,
       round(avg(CASE WHEN valid THEN 0.0 ELSE 1.0 END), 6) AS invalid_share, coalesce(any_value(longest), 0) AS longest_invalid FROM h LEFT JOIN r USING (key) GROUP BY key""")
def sig14_sanity(spark, sf):
    out = G.sanity(T.frames(spark, sf), ["x"], "valid")
    return out.withColumns({c: F.round(c, 6) for c in ("median_step", "p95_step", "invalid_share")})


@query("sig9_combined_speed", f"WITH {FRAMES} SELECT key, frame, greatest(x / 100, CASE WHEN valid THEN x / 50 ELSE 0 END) AS speed FROM f")
def sig9_combined_speed(spark, sf):
    f = T.frames(spark, sf)
    return f.select("key", "frame", G.combined_speed(F.col("x") / 100, F.when(F.col("valid"), F.col("x") / 50).otherwise(0.0)).alias("speed"))


@query("sig10_masks", f"WITH {FRAMES} SELECT key, frame, NOT valid AS mask_wrist, x > 60 OR x < 5 AS mask_pinch, NOT valid OR x > 60 OR x < 5 AS mask_any FROM f")
def sig10_masks(spark, sf):
    f = T.frames(spark, sf)
    return f.withColumns(G.hand_masks(~F.col("valid"), F.col("x") > 60, F.col("x") < 5)).select("key", "frame", "mask_wrist", "mask_pinch", "mask_any")


@query("sig14_camera", f"""WITH {POSES}, g AS (SELECT key, frame, e, lag(e) OVER (PARTITION BY key ORDER BY frame) AS q FROM p)
SELECT key, round(min(e[6]), 6) AS confidence_min, round(median(e[6]), 6) AS confidence_median, round(max(e[6]), 6) AS confidence_max, round(sum(sqrt((e[1] - q[1]) ** 2 + (e[2] - q[2]) ** 2)), 4) AS camera_travel, median(e[2] - e[5]) > 0 AS camera_above FROM g GROUP BY key""")
def sig14_camera(spark, sf):
    poses = _poses(spark, sf).withColumns({"valid": F.lit(True), "up": F.col("p1") - F.col("p4")})
    out = G.sanity(poses, ["p3"], "valid", confidence="p5", camera=["p0", "p1"], height="up")
    return out.select("key", *[F.round(f"confidence_{c}", 6).alias(f"confidence_{c}") for c in ("min", "median", "max")], F.round("camera_travel", 4).alias("camera_travel"), "camera_above")


# Events and boundaries.


@query("evt1_peaks", f"WITH {FRAMES}{PEAKS} SELECT * FROM pk WHERE height >= 50")
def evt1_peaks(spark, sf):
    return E.peaks(T.frames(spark, sf), "x", 50)


@query("evt2_prominent_minima", f"WITH {FRAMES}, {minima_sql('mn', 'f', 20.0)} SELECT key, frame, depth, prominence FROM mn")
def evt2_prominent_minima(spark, sf):
    return E.prominent_minima(T.frames(spark, sf), "x", prominence=20.0)


def _apertures(spark, sf):
    f = G.gradient(T.frames(spark, sf), "x", fps=1.0, into="opening")
    return f.withColumn("masked", ~F.col("valid"))


@query("evt3_grasp_release", f"""WITH {FRAMES.replace('f AS', 'f0 AS')}, f1 AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM f0 WINDOW w AS (PARTITION BY key ORDER BY frame)),
o AS (SELECT key, frame, valid, x AS wrist, CASE WHEN b IS NULL THEN a - x WHEN a IS NULL THEN x - b ELSE (a - b) / 2 END AS v FROM f1),
both_ AS (SELECT key, frame, v AS x, 'release' AS type FROM o UNION ALL SELECT key, frame, -v, 'grasp' FROM o),
r0 AS (SELECT *, sum(CASE WHEN x = p THEN 0 ELSE 1 END) OVER (PARTITION BY key, type ORDER BY frame) AS r FROM (SELECT *, lag(x) OVER (PARTITION BY key, type ORDER BY frame) AS p FROM both_)),
r1 AS (SELECT key, type, r, min(frame) AS a, max(frame) AS b, any_value(x) AS x FROM r0 GROUP BY key, type, r),
r2 AS (SELECT *, lag(x) OVER (PARTITION BY key, type ORDER BY r) AS p, lead(x) OVER (PARTITION BY key, type ORDER BY r) AS n FROM r1)
SELECT r2.key, o.frame, 'left' AS hand, type, r2.x AS magnitude FROM r2 JOIN o ON o.key = r2.key AND o.frame = (a + b) // 2
WHERE r2.x > p AND r2.x > n AND r2.x >= 10 AND valid AND (type = 'grasp' OR wrist <= 60)""")
def evt3_grasp_release(spark, sf):
    return E.grasp_release(_apertures(spark, sf), aperture_speed="opening", wrist_speed="x", masked="masked", hand="left", threshold=10, release_speed_max=60)


@query("evt5_gaze_shifts", f"""WITH {FRAMES}{PEAKS}, lim AS (SELECT key, greatest(quantile_cont(x, 0.9), 20.0) AS lim FROM f GROUP BY key)
SELECT key, frame, height AS magnitude FROM pk JOIN lim USING (key) WHERE height >= lim""")
def evt5_gaze_shifts(spark, sf):
    return E.gaze_shifts(T.frames(spark, sf), "x", floor=20.0)


def _candidates(spark, sf):
    f = T.frames(spark, sf).filter("valid")
    prio = F.when(F.col("kind") == "purchase", 4).when(F.col("kind") == "click", 3).when(F.col("kind") == "view", 2).otherwise(1)
    return f.select("key", "frame", F.lit(0).alias("ord"), prio.alias("prio"), F.col("x").alias("magnitude"), F.col("kind").alias("source"))


@query("evt8_merge_candidates", f"""WITH RECURSIVE {FRAMES}, c AS (
  SELECT key, frame, CASE kind WHEN 'purchase' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 1 END AS prio, x AS magnitude, row_number() OVER (PARTITION BY key ORDER BY frame) AS rn FROM f WHERE valid
), t AS (
  SELECT key, rn, frame AS kf, prio AS kp, magnitude AS km, NULL::BIGINT AS of, NULL::INT AS op, NULL::DOUBLE AS om FROM c WHERE rn = 1
  UNION ALL
  SELECT c.key, c.rn, CASE WHEN far OR wins THEN c.frame ELSE kf END, CASE WHEN far OR wins THEN c.prio ELSE kp END, CASE WHEN far OR wins THEN c.magnitude ELSE km END,
         CASE WHEN far THEN kf END, CASE WHEN far THEN kp END, CASE WHEN far THEN km END
  FROM (SELECT c.*, t.kf, t.kp, t.km, c.frame - t.kf > 4 AS far, (c.prio, c.magnitude) > (t.kp, t.km) AS wins FROM t JOIN c ON c.key = t.key AND c.rn = t.rn + 1) c
), l AS (SELECT key, max(rn) AS rn FROM c GROUP BY key)
SELECT key, of AS frame, 0 AS ord, op AS prio, om AS magnitude FROM t WHERE of IS NOT NULL
UNION ALL SELECT t.key, kf, 0, kp, km FROM t JOIN l ON l.key = t.key AND l.rn = t.rn""")
def evt8_merge_candidates(spark, sf):
    return E.merge_candidates(_candidates(spark, sf), window=4)


@query("evt13_fuse", f"""WITH RECURSIVE {FRAMES}, cand AS (SELECT key, frame, 0 AS ord, CASE kind WHEN 'purchase' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 1 END AS prio, x AS magnitude, kind AS source FROM f WHERE valid),
{fuse_sql(4, 5, 60.0)} SELECT key, frame, prio, magnitude, source FROM fused""")
def evt13_fuse(spark, sf):
    return E.fuse(_candidates(spark, sf), T.frames(spark, sf), window=4, least=5, move=60.0, speed="x")


@query("evt14_segments", f"""WITH {FRAMES}{PEAKS}, b AS (SELECT key, frame FROM pk WHERE height >= 50 UNION SELECT key, 0 FROM f UNION SELECT key, max(frame) FROM f GROUP BY key),
g AS (SELECT key, frame AS start, lead(frame) OVER (PARTITION BY key ORDER BY frame) AS "end" FROM b), sg AS (SELECT * FROM g WHERE "end" > start),
e AS (SELECT key, frame FROM f WHERE kind = 'purchase')
SELECT sg.key, row_number() OVER (PARTITION BY sg.key ORDER BY start) - 1 AS id, start, "end", round_even(start / 30.0::DOUBLE, 4) AS start_time, round_even("end" / 30.0::DOUBLE, 4) AS end_time,
       round_even(("end" - start) / 30.0::DOUBLE, 4) AS duration, (SELECT count(*) FROM e WHERE e.key = sg.key AND e.frame >= start AND e.frame < "end") AS inside FROM sg""")
def evt14_segments(spark, sf):
    f = T.frames(spark, sf)
    ends = f.groupBy("key").agg(F.array(F.lit(0).cast("long"), F.max("frame")).alias("a")).select("key", F.explode("a").alias("frame"))
    segments = E.segments_between(E.peaks(f, "x", 50).select("key", "frame").union(ends).distinct())
    events = f.filter("kind = 'purchase'").select("key", "frame", F.col("kind").alias("type"), F.col("x").alias("magnitude"))
    return E.events_inside(segments, events).select("key", "id", "start", "end", "start_time", "end_time", "duration", F.size("events_inside").cast("long").alias("inside"))


EVENTS = """o_ AS (SELECT key, frame, x, valid, CASE WHEN b IS NULL THEN a - x WHEN a IS NULL THEN x - b ELSE (a - b) / 2 END AS v FROM (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM f WINDOW w AS (PARTITION BY key ORDER BY frame))),
oc AS (SELECT key, frame, -v AS x FROM o_), oo AS (SELECT key, frame, v AS x FROM o_), """ + peaks_sql("gc", "oc") + ", " + peaks_sql("go", "oo") + """,
ev AS (SELECT p.key, p.frame, type, height AS magnitude FROM (SELECT *, 'grasp' AS type FROM gc UNION ALL SELECT *, 'release' FROM go) p JOIN o_ ON o_.key = p.key AND o_.frame = p.frame WHERE height >= 10 AND valid AND (type = 'grasp' OR x <= 60))"""
CANDIDATES = f"""{minima_sql("mn", "f", 10.0)}, {EVENTS}, hr AS (SELECT key, frame, x / 2 AS x FROM f), {peaks_sql("hp", "hr")}, hl AS (SELECT key, greatest(quantile_cont(x, 0.9), 20.0) AS lim FROM hr GROUP BY key),
cand AS (
  SELECT mn.key, mn.frame, 0 AS ord, 2 AS prio, -depth AS magnitude, 'pause' AS source FROM mn JOIN f ON f.key = mn.key AND f.frame = mn.frame WHERE depth < 20 AND (valid OR x < 10)
  UNION ALL SELECT key, frame, 1, CASE type WHEN 'release' THEN 4 ELSE 3 END, magnitude, type FROM ev
  UNION ALL SELECT key, frame, 2, 1, height, 'gaze' FROM hp JOIN hl USING (key) WHERE height >= lim
)"""


def _series(spark, sf):
    f = T.frames(spark, sf)
    series = f.select("key", "frame", F.col("x").alias("speed"), (F.col("x") / 2).alias("turn"), (~F.col("valid")).alias("masked_left"), (F.col("x") >= 10).alias("masked_right"))
    return series, E.grasp_release(_apertures(spark, sf), aperture_speed="opening", wrist_speed="x", masked="masked", hand="left", threshold=10, release_speed_max=60)


def _proposed(spark, sf):
    series, events = _series(spark, sf)
    return A.propose_segments(series, events, least=5, window=4, pause_speed=20.0, prominence=10.0, gaze_floor=20.0, move=60.0)


@query("evt15_propose_segments", f"""WITH RECURSIVE {FRAMES}, {CANDIDATES}, {fuse_sql(4, 5, 60.0)},
sg AS (SELECT * FROM (SELECT key, frame AS start, lead(frame) OVER w AS "end", source AS start_source, lead(source) OVER w AS end_source FROM fused WINDOW w AS (PARTITION BY key ORDER BY frame)) WHERE "end" > start)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY start) - 1 AS id, start, "end", start_source, end_source, round_even(("end" - start) / 30.0::DOUBLE, 4) AS duration,
       coalesce((SELECT string_agg(type || ' ' || frame, ',' ORDER BY frame, type) FROM ev WHERE ev.key = sg.key AND frame >= start AND frame < "end"), '') AS events FROM sg""")
def evt15_propose_segments(spark, sf):
    inside = F.array_join(F.transform("events_inside", lambda e: F.concat_ws(" ", e["type"], e["frame"].cast("string"))), ",")
    return _proposed(spark, sf).select("key", "id", "start", "end", "start_source", "end_source", "duration", inside.alias("events"))


@query("evt6_candidates", f"WITH {FRAMES}, {CANDIDATES} SELECT key, frame, ord, prio, magnitude, source FROM cand")
def evt6_candidates(spark, sf):
    f = T.frames(spark, sf)
    pauses = E.prominent_minima(f, "x", prominence=10.0).filter("depth < 20").join(f.filter("valid OR x < 10").select("key", "frame"), ["key", "frame"])
    events = E.grasp_release(_apertures(spark, sf), aperture_speed="opening", wrist_speed="x", masked="masked", hand="left", threshold=10, release_speed_max=60)
    gaze = E.gaze_shifts(f.withColumn("turn", F.col("x") / 2), "turn", floor=20.0)
    parts = [pauses.select("key", "frame", (-F.col("depth")).alias("magnitude"), F.lit("pause").alias("source")), events.select("key", "frame", "magnitude", F.col("type").alias("source")), gaze.withColumn("source", F.lit("gaze"))]
    return E.union_candidates(*parts).select("key", "frame", "ord", E.priority(F.col("source")).alias("prio"), "magnitude", "source")


# Joins.


@query("jn1_unpaired", """WITH b AS (SELECT DISTINCT o_custkey + 40 AS custkey FROM orders), a AS (SELECT c_custkey AS custkey FROM customer)
SELECT custkey, 'a' AS side FROM a WHERE custkey NOT IN (SELECT custkey FROM b) UNION ALL SELECT custkey, 'b' FROM b WHERE custkey NOT IN (SELECT custkey FROM a)""")
def jn1_unpaired(spark, sf):
    """Orders' customers are moved on, so that both sides have keys of their own."""
    return J.unpaired(T.read(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")), T.read(spark, sf, "orders").select((F.col("o_custkey") + 40).alias("custkey")), ["custkey"])


@query("jn2_dimension", "SELECT s_suppkey, s_nationkey, n_name, n_regionkey FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 7) n ON s_nationkey = n_nationkey")
def jn2_dimension(spark, sf):
    nation = T.read(spark, sf, "nation").filter("n_nationkey <> 7").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    return J.with_dimension(T.read(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), nation, "s_nationkey")


@query("jn3_overrides", """SELECT c_custkey, c_nationkey, coalesce(v, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS v FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) o ON s_nationkey = c_nationkey""")
def jn3_overrides(spark, sf):
    overrides = T.read(spark, sf, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("c_acctbal"))
    return J.with_overrides(T.read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), overrides, "c_nationkey", ["c_acctbal"])


@query("src11_duplicate_tasks", "SELECT p_name, count(*) AS rows, min(p_brand) AS first_category FROM part GROUP BY 1 HAVING count(*) > 1")
def src11_duplicate_tasks(spark, sf):
    return J.load_categories(T.read(spark, sf, "part"), "p_name", "p_brand")


@query("jn5_event_near", f"""WITH {SEGMENTS} SELECT key, start, "end", action FROM s WHERE EXISTS (SELECT 1 FROM f WHERE f.key = s.key AND f.kind = 'purchase' AND abs(f.frame - s."end") <= 3)""")
def jn5_event_near(spark, sf):
    events = T.frames(spark, sf).filter("kind = 'purchase'").select("key", "frame")
    return J.segments_with_event_near(T.segments(spark, sf), events, "end", 3).select("key", "start", "end", "action")


@query("jn6_handovers", f"""WITH {FRAMES}, e AS (SELECT key, frame, CASE WHEN x < 30 THEN 'left' ELSE 'right' END AS hand, CASE WHEN kind = 'purchase' THEN 'grasp' ELSE 'release' END AS type FROM f WHERE kind IN ('purchase', 'click'))
SELECT g.key, g.frame AS grasp, r.frame AS release FROM e g JOIN e r ON g.key = r.key AND g.type = 'grasp' AND r.type = 'release' AND g.hand <> r.hand AND abs(g.frame - r.frame) <= 6
JOIN f ON f.key = g.key AND f.frame = (g.frame + r.frame) // 2 AND f.x <= 40""")
def jn6_handovers(spark, sf):
    f = T.frames(spark, sf)
    events = f.filter("kind IN ('purchase', 'click')").select("key", "frame", F.when(F.col("x") < 30, "left").otherwise("right").alias("hand"), F.when(F.col("kind") == "purchase", "grasp").otherwise("release").alias("type"))
    return J.handovers(events, f.select("key", "frame", F.col("x").alias("apart")), frames=6, distance=40)


@query("jn7_as_of", f"""WITH {FRAMES}, c AS (SELECT key, frame AS start, kind FROM f WHERE kind = 'signup')
SELECT f.key, f.frame, c.kind || ' ' || c.start AS caption FROM f ASOF LEFT JOIN c ON f.key = c.key AND f.frame >= c.start""")
def jn7_as_of(spark, sf):
    f = T.frames(spark, sf)
    captions = f.filter("kind = 'signup'").select("key", F.col("frame").alias("start"), F.concat_ws(" ", "kind", F.col("frame").cast("string")).alias("caption"))
    return J.as_of(f, captions)


@query("jn11_in_all", "SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def jn11_in_all(spark, sf):
    rows = T.read(spark, sf, "customer").join(T.read(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return J.in_all(rows, "c_nationkey", "o_orderpriority")


@query("jn12_verdicts", f"""WITH {SEGMENTS}, q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start, "end") - 1 AS id FROM s), v AS (SELECT key + 40 AS key, frame AS id, x > 30 AS ok FROM f WHERE frame < 9)
SELECT v.key, v.id, ok, action, 'judged' AS status FROM v JOIN q ON q.key = v.key AND q.id = v.id UNION ALL SELECT DISTINCT key, NULL, NULL::BOOLEAN, NULL, 'missing' FROM v WHERE key NOT IN (SELECT key FROM q)""")
def jn12_verdicts(spark, sf):
    subtasks = T.segments(spark, sf).withColumn("id", (F.row_number().over(I.order()) - 1).cast("long"))
    verdicts = T.frames(spark, sf).filter("frame < 9").select((F.col("key") + 40).alias("key"), F.col("frame").alias("id"), (F.col("x") > 30).alias("ok"))
    judged, absent = J.verdicts_of_subtasks(verdicts, subtasks)
    return judged.select("key", "id", "ok", "action", F.lit("judged").alias("status")).unionByName(absent.withColumn("status", F.lit("missing")), allowMissingColumns=True)


@query("jn13_unblind", """WITH v AS (SELECT p_partkey AS key, chr(65 + (p_size % 4)::INT) AS best, chr(65 + (p_size % 3)::INT) AS worst FROM part), l AS (SELECT p_partkey AS key, chr(65 + i::INT) AS letter, 'config ' || (i + p_partkey) % 3 AS config FROM part, range(3) r(i))
SELECT v.key, v.best, v.worst, a.config AS best_config, b.config AS worst_config FROM v LEFT JOIN l a ON a.key = v.key AND a.letter = best LEFT JOIN l b ON b.key = v.key AND b.letter = worst""")
def jn13_unblind(spark, sf):
    part = T.read(spark, sf, "part")
    letter = lambda n: F.char((F.lit(65) + n).cast("long"))
    votes = part.select(F.col("p_partkey").alias("key"), letter(F.col("p_size") % 4).alias("best"), letter(F.col("p_size") % 3).alias("worst"))
    letters = part.select(F.col("p_partkey").alias("key"), F.explode(F.array(*map(F.lit, range(3)))).alias("i"))
    letters = letters.select("key", letter(F.col("i")).alias("letter"), F.concat(F.lit("config "), ((F.col("i") + F.col("key")) % 3).cast("string")).alias("config"))
    return J.unblind(votes, letters)


@query("jn14_missing", "SELECT DISTINCT p_partkey AS partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def jn14_missing(spark, sf):
    return J.missing(T.read(spark, sf, "part").select(F.col("p_partkey").alias("partkey")), T.read(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("partkey")), "partkey")


@query("jn15_unknown_verbs", f"""WITH {SEGMENTS} SELECT key, string_agg(DISTINCT action, ' ' ORDER BY action) AS verbs, 'place' AS unknown FROM s GROUP BY key HAVING bool_or(action = 'place')""")
def jn15_unknown_verbs(spark, sf):
    verbs = T.segments(spark, sf).groupBy("key").agg(F.sort_array(F.collect_set("action")).alias("v"))
    found = J.unknown_verbs(verbs, "v", [*V.GRASP_START_VERBS, "reach"])
    return found.select("key", F.array_join("v", " ").alias("verbs"), F.array_join("unknown", " ").alias("unknown"))


# Selection.


@query("sel2_descriptions", "SELECT page_id, CASE WHEN page_id % 3 = 2 AND page_id % 5 > 0 THEN 'b' || page_id WHEN page_id % 4 > 0 THEN 'a' || page_id ELSE 'c' END AS description, replace('p/' || page_id, '/', '__') AS slug FROM pages")
def sel2_descriptions(spark, sf):
    p = T.read(spark, sf, "pages").select("page_id")
    text = lambda head, keep: F.when(keep, F.concat(F.lit(head), F.col("page_id"))).otherwise("None")
    which = F.when(F.col("page_id") % 3 == 2, 2).otherwise(1)
    return p.select("page_id", S.description(which, text("a", F.col("page_id") % 4 > 0), text("b", F.col("page_id") % 5 > 0), F.lit("c")).alias("description"), S.slug(F.concat(F.lit("p/"), F.col("page_id"))).alias("slug"))


@query("sel3_hints", "SELECT doc_id, CASE lang WHEN 'en' THEN 'hint en' WHEN 'de' THEN 'hint de' ELSE 'flat' END AS hint FROM documents")
def sel3_hints(spark, sf):
    hints = F.create_map(*[F.lit(x) for lang in ("en", "de") for x in (lang, f"hint {lang}")])
    return T.read(spark, sf, "documents").select("doc_id", S.prompt_hint(hints, F.col("lang"), F.lit("flat")).alias("hint"))


@query("sel7_sample", """WITH d AS (SELECT c_nationkey, c_custkey, md5('42:' || c_custkey) AS h, c_acctbal >= 5000 AS ok, c_acctbal FROM customer),
o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY ok DESC, CASE WHEN NOT ok THEN -c_acctbal END NULLS FIRST, h, c_custkey) AS i FROM d)
SELECT c_nationkey, c_custkey FROM o WHERE i = 1 ORDER BY md5('42:' || c_nationkey), c_nationkey LIMIT 10""")
def sel7_sample(spark, sf):
    rows = T.read(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return P.sample_groups(rows, "c_nationkey", "c_custkey", 10, size="c_acctbal", least=5000).select("c_nationkey", "c_custkey")


_TODO = """WITH d AS (SELECT c_nationkey, c_custkey, md5('7:' || c_custkey) AS h FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')),
o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY h, c_custkey) AS i FROM d) """


@query("sel8_pick_random", _TODO + "SELECT c_nationkey, c_custkey FROM o ORDER BY i > 1, h, c_custkey LIMIT 40")
def sel8_pick_random(spark, sf):
    done = T.read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return P.pick_spread(T.read(spark, sf, "customer").select("c_nationkey", "c_custkey"), done, "c_nationkey", "c_custkey", 40, seed=7)


@query("sel9_pick_round_robin", _TODO + "SELECT c_nationkey, c_custkey FROM o ORDER BY i, c_nationkey LIMIT 40")
def sel9_pick_round_robin(spark, sf):
    done = T.read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return P.pick_spread(T.read(spark, sf, "customer").select("c_nationkey", "c_custkey"), done, "c_nationkey", "c_custkey", 40, seed=7, round_robin=True)


@query("sel10_review_order", """WITH RECURSIVE d AS (SELECT s_nationkey AS g, s_suppkey AS k, s_acctbal < 3000 AS flagged, md5('42:' || s_suppkey) AS h FROM supplier),
r AS (
  SELECT 0::BIGINT AS step, []::STRUCT(g BIGINT, k BIGINT, step BIGINT)[] AS picks
  UNION ALL
  SELECT step + 1, CASE WHEN count(k) = 0 THEN picks ELSE list_append(picks, {'g': arg_min(g, place)::BIGINT, 'k': arg_min(k, place)::BIGINT, 'step': step}) END
  FROM (
    SELECT step, picks, g, k, CASE WHEN met IS NULL THEN '0' ELSE '1' || printf('%06d', 900000 - (met + 1 + CASE WHEN (met + 1) % 2 <> step % 2 THEN 1 ELSE 0 END)) END || h || printf('%012d', k) AS place
    FROM (SELECT r.step, r.picks, d.g, d.k, d.h, list_min(list_transform(list_filter(r.picks, lambda p: p.g = d.g), lambda p: p.step)) AS met
          FROM r LEFT JOIN d ON d.flagged = (r.step % 2 = 0) AND NOT list_contains(list_transform(r.picks, lambda p: p.k), d.k::BIGINT) WHERE len(r.picks) < 20 AND r.step < 80)
  ) GROUP BY step, picks
), z AS (SELECT picks FROM r ORDER BY step DESC LIMIT 1), t AS (SELECT unnest(picks) AS p, generate_subscripts(picks, 1) AS turn FROM z)
SELECT d.g AS s_nationkey, d.k AS s_suppkey, d.flagged, turn::INT AS turn FROM t JOIN d ON d.k = p.k""")
def sel10_review_order(spark, sf):
    rows = T.read(spark, sf, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_acctbal") < 3000).alias("flagged"))
    return P.review_order(rows, "s_nationkey", "s_suppkey", "flagged", 20)


@query("sel11_folder", "SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'category ' || user_id % 3 WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE 'mixed_tasks' END AS folder FROM events WHERE value > 60 GROUP BY 1")
def sel11_folder(spark, sf):
    counts = T.read(spark, sf, "events").filter("value > 60").groupBy("user_id").agg(F.count_distinct("event_type").alias("n"), F.min("event_type").alias("one"))
    category = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("category "), (F.col("user_id") % 3).cast("string")))
    return counts.select("user_id", P.folder_name(category, F.col("n"), F.col("one")).alias("folder"))


@query("sel13_valid_candidates", f"""WITH {FRAMES}, c AS (SELECT key, frame AS start, least(frame + 1 + floor(x / 50), 16 * (frame // 16) + 15)::BIGINT AS "end" FROM f WHERE kind IN ('view', 'click'))
SELECT key, start, "end" FROM c WHERE "end" > start""")
def sel13_valid_candidates(spark, sf):
    c = T.intervals(spark, sf).withColumns({"action": F.when(F.col("action").isin("view", "click"), "reach").otherwise("dance"), "sentence": F.lit(" a step "), "w_start": F.floor(F.col("start") / 16) * 16, "ongoing": F.lit(None).cast("boolean")})
    c = c.withColumns({"w_end": F.col("w_start") + 15, "start": F.col("start").cast("string"), "end": F.col("end").cast("string")})
    return W.valid_candidates(c).select("key", "start", "end")


@query("sel16_in_window", f"""WITH {FRAMES}, n AS (SELECT key, max(frame) AS last FROM f GROUP BY key) SELECT f.key, frame // 20 AS w, CASE WHEN x > 70 THEN frame + 15 WHEN x < 5 THEN frame - 12 ELSE frame END AS frame, kind FROM f JOIN n USING (key)
WHERE kind = 'click' AND CASE WHEN x > 70 THEN frame + 15 WHEN x < 5 THEN frame - 12 ELSE frame END BETWEEN frame // 20 * 20 AND least(frame // 20 * 20 + 23, last)""")
def sel16_in_window(spark, sf):
    """Reported frames, some of which lie outside of the window that reports them."""
    f = T.frames(spark, sf)
    told = F.when(F.col("x") > 70, F.col("frame") + 15).when(F.col("x") < 5, F.col("frame") - 12).otherwise(F.col("frame"))
    events = f.filter("kind = 'click'").select("key", F.floor(F.col("frame") / 20).alias("w"), told.alias("frame"), "kind")
    last = f.groupBy("key").agg(F.max("frame").alias("last"))
    windows = last.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 20))).alias("w"), "last").withColumn("w_start", F.col("w") * 20)
    return P.in_windows(events, windows.withColumn("w_end", F.least(F.col("w_start") + 23, F.col("last")))).select("key", "w", "frame", "kind")


@query("sel17_keyframes", f"""WITH {SEGMENTS}, q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start) - 1 AS id FROM s),
c AS (SELECT key, id, start AS frame, 'start' AS tag, 0 AS p, 0.0 AS m FROM q UNION ALL SELECT key, id, "end", 'end', 1, 0.0 FROM q
  UNION ALL SELECT q.key, id, f.frame, 'event', 2, -f.x FROM q JOIN f ON f.key = q.key AND f.frame >= start AND f.frame < "end" UNION ALL SELECT key, id, (start + "end") // 2, 'middle', 3, 0.0 FROM q),
d AS (SELECT *, row_number() OVER (PARTITION BY key, id, frame ORDER BY p, m, frame) AS i FROM c), e AS (SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY p, m, frame) AS r FROM d WHERE i = 1)
SELECT key, id::INT AS id, frame, tag FROM e WHERE r <= 4""")
def sel17_keyframes(spark, sf):
    segments = T.segments(spark, sf).withColumn("id", F.row_number().over(Window.partitionBy("key").orderBy("start")) - 1)
    events = T.frames(spark, sf).select("key", "frame", F.col("kind").alias("type"), F.col("x").alias("magnitude"))
    inside = E.events_inside(segments, events).select("key", "id", F.explode("events_inside").alias("e")).select("key", "id", "e.frame", "e.magnitude")
    return P.keyframes(segments, inside, 4)


@query("sel18_even_frames", f"""WITH {SEGMENTS} SELECT key, start, array_to_string(list_sort(list_distinct(list_concat([start, "end"], list_transform(range(1, 4), lambda i: round_even(start + ("end" - start) * i / 4, 0)::BIGINT)))), ' ') AS frames FROM s""")
def sel18_even_frames(spark, sf):
    picked = S.keyframes_between(F.col("start"), F.col("end"), F.lit(5))
    return T.segments(spark, sf).select("key", "start", F.array_join(picked.cast("array<string>"), " ").alias("frames"))


@query("sel19_window_grid", f"""WITH {FRAMES}, n AS (SELECT key, count(*) AS n FROM f GROUP BY key), g AS (SELECT key, range(0, n, 2)[1:24] AS l FROM n)
SELECT key, array_to_string(CASE WHEN len(l) <= 7 THEN l ELSE list_transform(range(0, 7), lambda i: l[round_even(i * (len(l) - 1) / 6, 0)::INT + 1]) END, ' ') AS frames FROM g""")
def sel19_window_grid(spark, sf):
    n = T.frames(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    grid = S.window_grid(F.lit(0).cast("long"), F.col("n") - 1, F.lit(2).cast("long"), F.lit(24), F.lit(7))
    return n.select("key", F.array_join(grid.cast("array<string>"), " ").alias("frames"))


@query("sel20_budget", "SELECT p_partkey, least(4 + coalesce(CASE WHEN p_size > 10 THEN p_size // 10 END, 0), 6)::INT AS budget FROM part")
def sel20_budget(spark, sf):
    bonus = F.when(F.col("p_size") > 10, F.floor(F.col("p_size") / 10).cast("int"))
    return T.read(spark, sf, "part").select("p_partkey", P.budget(bonus).alias("budget"))


# Interval transforms.


@query("int1_normal_names", """SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), '^the ', ''), '^a ', ''), '^an ', '') AS three, regexp_replace(lower(trim(t)), '^(the |a |an )', '') AS one
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'The a ' WHEN 1 THEN ' an ' WHEN 2 THEN 'A the ' ELSE '' END || p_name || ' ' AS t FROM part)""")
def int1_normal_names(spark, sf):
    head = F.element_at(F.array(F.lit("The a "), F.lit(" an "), F.lit("A the "), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(head, "p_name", F.lit(" "))
    return T.read(spark, sf, "part").select("p_partkey", S.strip_articles(text).alias("three"), S.strip_article(text).alias("one"))


MERGED = SEGMENTS + """, mi AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start, "end") AS nth, CASE WHEN start - lag("end") OVER w < 15 AND action = lag(action) OVER w AND hand = lag(hand) OVER w THEN 0 ELSE 1 END AS cut
  FROM s WINDOW w AS (PARTITION BY key ORDER BY start, "end")
), mj AS (SELECT *, sum(cut) OVER (PARTITION BY key ORDER BY nth) AS island, CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END * 1000000 - nth AS best FROM mi
), m AS (SELECT key, min(start) AS start, arg_max("end", nth) AS "end", any_value(action) AS action, any_value(hand) AS hand, arg_max(object, best) AS object, arg_max(confidence, best) AS confidence, arg_max(sentence, best) AS sentence,
  arg_min(start_source, nth) AS start_source, arg_max(end_source, nth) AS end_source, any_value(n_frames) AS n_frames, count(*) AS members FROM mj GROUP BY key, island)"""


@query("int4_merge_adjacent", f"WITH {MERGED} SELECT * FROM m")
def int4_merge_adjacent(spark, sf):
    return I.merge_adjacent(T.segments(spark, sf))


@query("int5_min_length", f"WITH RECURSIVE {MERGED}, {absorb_sql('m', 3)} SELECT * FROM ab")
def int5_min_length(spark, sf):
    return I.enforce_min_length(I.merge_adjacent(T.segments(spark, sf)).drop("members"), least=3)


def _gappy(spark, sf):
    return T.segments(spark, sf).filter("start_source <> 'signup' AND start_source <> 'view'")


def idle_sql(source: str, gap: int) -> str:
    """CTEs up to ``idled``: the rows of ``source`` after INT6 and INT7, with ids."""
    said = f"['{V.IDLE_SENTENCES[0]}', '{V.IDLE_SENTENCES[1]}', '{V.IDLE_SENTENCES[2]}']"
    idle = "'idle', 'both', 'none', 'high', NULL, 'idle_gap', 'idle_gap', n_frames, 'idle_gap'"
    return f"""ik AS (SELECT *, lag("end") OVER w AS pe, lead(start) OVER w AS ns FROM {source} WINDOW w AS (PARTITION BY key ORDER BY start, "end")),
io AS (
  SELECT key, CASE WHEN pe IS NULL AND start BETWEEN 1 AND {gap} THEN 0 ELSE start END AS start, CASE WHEN coalesce(ns, n_frames - 1) - "end" BETWEEN 1 AND {gap} THEN coalesce(ns, n_frames - 1) ELSE "end" END AS "end",
         action, hand, object, confidence, sentence, start_source, end_source, n_frames, 'label' AS source FROM ik
  UNION ALL SELECT key, coalesce(pe, 0), start, {idle} FROM ik WHERE start - coalesce(pe, 0) > {gap}
  UNION ALL SELECT key, "end", n_frames - 1, {idle} FROM ik WHERE ns IS NULL AND n_frames - 1 - "end" > {gap}),
ii AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start, "end") - 1 AS id FROM io),
ic AS (SELECT key, {crc32_sql("k")} AS crc FROM (SELECT DISTINCT key, key::VARCHAR AS k FROM {source})),
idled AS (SELECT ii.* EXCLUDE (sentence), CASE WHEN source = 'label' THEN sentence ELSE {said}[(crc + id) % 3 + 1] END AS sentence FROM ii JOIN ic USING (key))"""


GAPPY = """gp AS (SELECT * FROM s WHERE start_source NOT IN ('signup', 'view'))"""


@query("int6_insert_idle", f"""WITH {SEGMENTS}, {GAPPY}, {idle_sql("gp", 3)} SELECT key, id, start, "end", action, source, start_source, end_source, sentence FROM idled""")
def int6_insert_idle(spark, sf):
    return I.insert_idle(_gappy(spark, sf), idle_gap_s=0.1).select("key", "id", "start", "end", "action", "source", "start_source", "end_source", "sentence")


@query("int7_idle_sentences", f"""WITH {SEGMENTS}, {GAPPY}, {idle_sql("gp", 3)} SELECT key, id, sentence FROM idled WHERE source = 'idle_gap'""")
def int7_idle_sentences(spark, sf):
    return I.insert_idle(_gappy(spark, sf), idle_gap_s=0.1).filter("source = 'idle_gap'").select("key", "id", "sentence")


INTERVALS = FRAMES + """, iv AS (SELECT key, frame AS start, (frame + 1 + floor(x / 50))::BIGINT AS "end", kind AS action FROM f)"""


@query("int8_iou", f"""WITH {INTERVALS}, g AS (SELECT *, lag(start) OVER w AS ps, lag("end") OVER w AS pe FROM iv WINDOW w AS (PARTITION BY key, action ORDER BY start))
SELECT key, action, start, round(greatest(least("end", pe) - greatest(start, ps), 0) / (greatest("end", pe) - least(start, ps))::DOUBLE, 6) AS iou FROM g WHERE ps IS NOT NULL""")
def int8_iou(spark, sf):
    line = Window.partitionBy("key", "action").orderBy("start")
    iv = T.intervals(spark, sf).withColumns({"ps": F.lag("start").over(line), "pe": F.lag("end").over(line)}).filter("ps IS NOT NULL")
    return iv.select("key", "action", "start", F.round(S.iou(F.col("start"), F.col("end"), F.col("ps"), F.col("pe")), 6).alias("iou"))


def stitch_sql(share: float) -> str:
    """CTEs up to ``st``: the candidates of ``iv`` (key, start, end, action, hand, obj, object, sentence, confidence) after INT9 and INT10."""
    rank = lambda c: f"CASE {c} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
    said = ("action", "hand", "object", "sentence", "confidence")
    grown = "{'start': least(k.start, c.start), 'end': greatest(k.\"end\", c.\"end\"), 'nth': k.nth, " + ", ".join(f"'{x}': CASE WHEN {rank('c.confidence')} > {rank('k.confidence')} THEN c.{x} ELSE k.{x} END" for x in said) + "}"
    fits = f"(greatest(least(k.\"end\", c.\"end\") - greatest(k.start, c.start), 0) / (greatest(k.\"end\", c.\"end\") - least(k.start, c.start))::DOUBLE >= {share})"
    row = "{'start': start, 'end': \"end\", 'nth': nth, " + ", ".join(f"'{x}': {x}" for x in said) + "}"
    keep = lambda c: ", ".join(f"CASE WHEN {c} THEN {x} ELSE p_{x} END" for x in said)
    return f"""sn AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start, "end", action, object, hand, confidence, sentence) AS nth FROM iv WHERE "end" > start),
sr AS (SELECT key, action AS act, obj, nth, {row} AS c, row_number() OVER (PARTITION BY key, action, obj ORDER BY nth) AS rn FROM sn),
sc AS (
  SELECT key, act, obj, rn, [c] AS l FROM sr WHERE rn = 1
  UNION ALL
  SELECT key, act, obj, rn, CASE WHEN j = 0 THEN list_append(l, c) ELSE list_transform(l, lambda k, i: CASE WHEN i = j THEN {grown} ELSE k END) END
  FROM (SELECT sr.*, l, coalesce(list_position(list_transform(l, lambda k: {fits}), TRUE), 0) AS j FROM sc JOIN sr ON sr.key = sc.key AND sr.act = sc.act AND sr.obj = sc.obj AND sr.rn = sc.rn + 1)
), sl AS (SELECT key, act, obj, max(rn) AS rn FROM sr GROUP BY ALL),
so AS (SELECT key, obj, unnest(l, max_depth := 2) FROM sc JOIN sl USING (key, act, obj, rn)),
sq AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start, "end", nth) AS rn FROM so),
sp AS (
  SELECT key, rn, start AS p_start, "end" AS p_end, obj AS p_obj, {", ".join(f"{x} AS p_{x}" for x in said)}, NULL::BIGINT AS o_start, NULL::BIGINT AS o_end, {", ".join(f"NULL::VARCHAR AS o_{x}" for x in said)} FROM sq WHERE rn = 1
  UNION ALL
  SELECT key, rn, CASE WHEN free THEN start WHEN same OR inside THEN p_start ELSE cut END, CASE WHEN free THEN "end" WHEN same THEN greatest(p_end, "end") WHEN inside THEN p_end ELSE "end" END, CASE WHEN free OR NOT (same OR inside) THEN obj ELSE p_obj END,
         {keep(f"free OR (same AND {rank('confidence')} > {rank('p_confidence')}) OR NOT (same OR inside)")},
         CASE WHEN free OR NOT (same OR inside) THEN p_start END, CASE WHEN free THEN p_end WHEN NOT (same OR inside) THEN cut END, {", ".join(f"CASE WHEN free OR NOT (same OR inside) THEN p_{x} END" for x in said)}
  FROM (SELECT q.*, p.* EXCLUDE (key, rn), q.start >= p_end AS free, q.action = p_action AND q.obj = p_obj AS same, q."end" <= p_end AS inside, least(greatest((q.start + p_end) // 2, p_start + 1), q."end" - 1) AS cut
        FROM sp p JOIN sq q ON q.key = p.key AND q.rn = p.rn + 1)
), sz AS (SELECT key, max(rn) AS rn FROM sq GROUP BY key),
st AS (SELECT key, o_start AS start, o_end AS "end", {", ".join(f"o_{x} AS {x}" for x in said)} FROM sp WHERE o_start IS NOT NULL
  UNION ALL SELECT sp.key, p_start, p_end, {", ".join(f"p_{x}" for x in said)} FROM sp JOIN sz ON sz.key = sp.key AND sz.rn = sp.rn)"""


CLUSTERED = FRAMES + """, iv AS (SELECT key, frame AS start, (frame + 1 + floor(x / 50))::BIGINT AS "end", kind AS action, CASE WHEN frame % 2 = 0 THEN 'left' ELSE 'both' END AS hand, CASE WHEN frame % 3 = 0 THEN 'The cup' ELSE 'cup' END AS object, 'cup' AS obj,
  kind || ' ' || frame AS sentence, CASE WHEN x < 15 THEN 'low' WHEN x < 50 THEN 'medium' ELSE 'high' END AS confidence FROM f)"""


@query("int9_stitch", f"WITH RECURSIVE {CLUSTERED}, {stitch_sql(0.3)} SELECT * FROM st")
def int9_stitch(spark, sf):
    return I.stitch(T.intervals(spark, sf), share=0.3)


@query("jn8_same_label_overlaps", f"""WITH {CLUSTERED} SELECT a.key, a.start AS id, b.start AS other, round(greatest(least(a."end", b."end") - greatest(a.start, b.start), 0) / (greatest(a."end", b."end") - least(a.start, b.start))::DOUBLE, 6) AS iou
FROM iv a JOIN iv b ON a.key = b.key AND a.action = b.action AND a.start < b.start WHERE greatest(least(a."end", b."end") - greatest(a.start, b.start), 0) / (greatest(a."end", b."end") - least(a.start, b.start))::DOUBLE >= 0.2""")
def jn8_same_label_overlaps(spark, sf):
    return I.same_label_overlaps(T.intervals(spark, sf).withColumn("id", F.col("start")), share=0.2).withColumn("iou", F.round("iou", 6))


@query("int12_clamp", f"""WITH {INTERVALS}, g AS (SELECT *, max("end") OVER (PARTITION BY key ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv)
SELECT key, greatest(start, coalesce(reach, start)) AS start, "end", action FROM g WHERE "end" > greatest(start, coalesce(reach, start))""")
def int12_clamp(spark, sf):
    return I.clamp_overlaps(T.intervals(spark, sf)).select("key", "start", "end", "action")


@query("int13_fallback", f"""WITH {SEGMENTS}, b AS (SELECT * FROM s WHERE "end" - start > 5), n AS (SELECT key, count(*) AS n_frames FROM f GROUP BY key)
SELECT key, start, "end", action, confidence FROM b UNION ALL SELECT key, 0, n_frames - 1, 'other', 'low' FROM n WHERE key NOT IN (SELECT key FROM b)""")
def int13_fallback(spark, sf):
    keys = T.frames(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n_frames"))
    return I.fallback(keys, T.segments(spark, sf).filter(F.col("end") - F.col("start") > 5)).select("key", "start", "end", "action", "confidence")


@query("int14_assemble", f"""WITH RECURSIVE {MERGED}, {absorb_sql('m', 3)}, {idle_sql('ab', 3)}, um AS (SELECT key, list_sort(list("end" - start))[count(*) // 2 + 1] AS med FROM idled GROUP BY key)
SELECT key, id, start, "end", action, hand, object, confidence, sentence, start_source, end_source, round(start / 30.0::DOUBLE, 6) AS start_time, round(("end" - start) / 30.0::DOUBLE, 6) AS duration,
       concat_ws(',', CASE WHEN med > 0 AND ("end" - start) < 0.34 * med THEN 'short_segment' END, CASE WHEN confidence = 'low' THEN 'low_confidence' END) AS flags FROM idled JOIN um USING (key)""")
def int14_assemble(spark, sf):
    out = A.assemble(T.segments(spark, sf), least=3, idle_gap_s=0.1)
    return out.select("key", "id", "start", "end", "action", "hand", "object", "confidence", "sentence", "start_source", "end_source", *[F.round(c, 6).alias(c) for c in ("start_time", "duration")], F.array_join("flags", ",").alias("flags"))


@query("fn11_cross_flags", f"""WITH {MERGED}, {idle_sql('m', 3)}, ev AS (SELECT key, frame, CASE WHEN kind = 'purchase' THEN 'grasp' ELSE 'release' END AS type FROM f WHERE kind = 'purchase' OR (kind = 'signup' AND x > 40))
SELECT key, id, concat_ws(',', CASE WHEN (action = 'grasp' AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.key = idled.key AND type = 'grasp' AND frame BETWEEN start - 2 AND "end" + 2)) OR (action = 'place' AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.key = idled.key AND type = 'release' AND frame BETWEEN start - 2 AND "end" + 2)) THEN 'kinematic_mismatch' END,
  CASE WHEN confidence = 'low' THEN 'low_confidence' END, CASE WHEN source = 'label' AND hand = 'left' AND start % 2 = 1 THEN 'hand_disagreement' END) AS flags FROM idled""")
def fn11_cross_flags(spark, sf):
    rows = I.insert_idle(I.merge_adjacent(T.segments(spark, sf)), idle_gap_s=0.1).withColumn("hand_disagreement", (F.col("source") == "label") & (F.col("hand") == "left") & (F.col("start") % 2 == 1))
    events = T.frames(spark, sf).filter("kind = 'purchase' OR (kind = 'signup' AND x > 40)").select("key", "frame", F.when(F.col("kind") == "purchase", "grasp").otherwise("release").alias("type"))
    return I.cross_flagged(rows, events, tolerance=2).select("key", "id", F.array_join("flags", ",").alias("flags"))


FLAGGED = MERGED + """, um AS (SELECT key, list_sort(list("end" - start))[count(*) // 2 + 1] AS med FROM m GROUP BY key),
fl AS (SELECT m.*, med > 0 AND ("end" - start) < 0.34 * med AS short, confidence = 'low' AS lowc FROM m JOIN um USING (key))"""


@query("fn12_flags", f"""WITH {FLAGGED} SELECT key, start, CASE WHEN short AND lowc THEN 'short_segment,low_confidence' WHEN short THEN 'short_segment' WHEN lowc THEN 'low_confidence' ELSE '' END AS flags FROM fl""")
def fn12_flags(spark, sf):
    return I.flagged(I.merge_adjacent(T.segments(spark, sf))).select("key", "start", F.array_join("flags", ",").alias("flags"))


@query("fn13_review_queue", f"""WITH {FLAGGED}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start, "end") - 1 AS id FROM fl),
t AS (SELECT *, concat_ws('|', id, action, hand, object, sentence, start, "end", printf('%.4f', start / 30.0::DOUBLE), printf('%.4f', "end" / 30.0::DOUBLE), printf('%.4f', ("end" - start) / 30.0::DOUBLE), start_source, end_source, confidence, concat_ws('+', CASE WHEN short THEN 'short_segment' END, CASE WHEN lowc THEN 'low_confidence' END)) AS told FROM n)
SELECT key, any_value(n_frames) AS n_frames, string_agg(told, chr(10) ORDER BY id) AS subtasks, coalesce(string_agg(id::VARCHAR, ' ' ORDER BY id) FILTER (short OR lowc), '') AS review FROM t GROUP BY key""")
def fn13_review_queue(spark, sf):
    """INT11, FN13: the nested records, with all that their subtasks say."""
    rows = I.flagged(I.merge_adjacent(T.segments(spark, sf))).withColumn("id", F.row_number().over(I.order()) - 1)
    rows = rows.withColumns({"start_time": F.col("start") / V.FPS, "end_time": F.col("end") / V.FPS, "duration": (F.col("end") - F.col("start")) / V.FPS})
    time = lambda c: F.format_string("%.4f", c)
    told = lambda t: F.concat_ws("|", *[t[c].cast("string") for c in ("id", "action", "hand", "object", "sentence", "start", "end")], *[time(t[c]) for c in ("start_time", "end_time", "duration")], *[t[c] for c in ("start_source", "end_source", "confidence")], F.array_join(t["flags"], "+"))
    return A.annotations(rows).select("key", "n_frames", F.array_join(F.transform("subtasks", told), "\n").alias("subtasks"), F.array_join(F.col("review_queue").cast("array<string>"), " ").alias("review"))


@query("agg18_upper_median", f"""WITH {MERGED} SELECT key, list_sort(list("end" - start))[count(*) // 2 + 1] AS upper_median FROM m GROUP BY key""")
def agg18_upper_median(spark, sf):
    return I.upper_median(I.merge_adjacent(T.segments(spark, sf)), F.col("end") - F.col("start"))


# Windows.

N = FRAMES + ", n AS (SELECT key, count(*) AS n_frames FROM f GROUP BY key)"


@query("win1_sliding", f"""WITH {N}, w AS (SELECT key, n_frames, unnest(range(0, greatest(0, ceil((n_frames - 24) / 16))::BIGINT + 1)) AS w FROM n) SELECT key, w::INT AS w, w * 16 AS w_start, least(w * 16 + 23, n_frames - 1) AS w_end FROM w""")
def win1_sliding(spark, sf):
    n = T.frames(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n_frames"))
    return W.sliding(n, frames=12, skip=1, overlap=0.33).select("key", "w", F.col("w_start").cast("long").alias("w_start"), "w_end")


@query("win2_tumbling", f"""WITH {N}, w AS (SELECT key, n_frames, unnest(range(0, ceil(n_frames / 16)::BIGINT)) AS w FROM n) SELECT key, w::INT AS w, w * 16 AS w_start, least(w * 16 + 15, n_frames - 1) AS w_end FROM w""")
def win2_tumbling(spark, sf):
    n = T.frames(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n_frames"))
    return W.tumbling(n, frames=16).select("key", "w", F.col("w_start").cast("long").alias("w_start"), "w_end")


@query("win4_story", f"""WITH {SEGMENTS} SELECT key, start, coalesce(string_agg(action, ' ') OVER (PARTITION BY key ORDER BY start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS story FROM s""")
def win4_story(spark, sf):
    return W.story(T.segments(spark, sf), "action").select("key", "start", "story")


def chunked(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of chunks of 16 frames; those that reach a chunk's end go on, and some chunks report the open one again."""
    iv = T.intervals(spark, sf).withColumn("chunk", F.floor(F.col("start") / 16))
    iv = iv.withColumns({"w_start": F.col("chunk") * 16, "end": F.least("end", F.col("chunk") * 16 + 15)}).filter("end > start AND (start % 16 < 4 OR start % 16 > 10)")
    return iv.select("key", "chunk", "w_start", F.when((F.col("start") % 16 == 0) & (F.col("key") % 2 == 0), F.col("start") - 2).otherwise(F.col("start")).alias("start"), "end", "action", (F.col("end") >= F.col("w_start") + 14).alias("ongoing"))


@query("win6_open_tail", f"""WITH {FRAMES}, iv AS (SELECT key, frame AS start, frame // 16 AS chunk, least(frame + 1 + floor(x / 50), frame // 16 * 16 + 15)::BIGINT AS "end", kind AS action FROM f),
c0 AS (SELECT key, chunk, chunk * 16 AS w_start, CASE WHEN start % 16 = 0 AND key % 2 = 0 THEN start - 2 ELSE start END AS start, "end", action, "end" >= chunk * 16 + 14 AS ongoing FROM iv WHERE "end" > start AND (start % 16 < 4 OR start % 16 > 10)),
c1 AS (SELECT *, row_number() OVER w AS nth, greatest(start, coalesce(max("end") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start)) AS clear, start < w_start AS early FROM c0 WINDOW w AS (PARTITION BY key, chunk ORDER BY start, "end")),
c2 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY chunk, nth) AS rn, ongoing AND coalesce(lead(chunk) OVER (PARTITION BY key ORDER BY chunk, nth) <> chunk, TRUE) AS tail FROM c1 WHERE "end" > clear),
c3 AS (SELECT *, sum(CASE WHEN nth = 1 AND early AND before THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY rn) AS island FROM (SELECT *, coalesce(lag(tail) OVER (PARTITION BY key ORDER BY rn), FALSE) AS before FROM c2))
SELECT key, arg_min(clear, rn) AS start, arg_max("end", rn) AS "end", arg_max(action, rn) AS action FROM c3 GROUP BY key, island""")
def win6_open_tail(spark, sf):
    return W.fold_chunks(chunked(spark, sf))


def windowed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Candidates of windows of 24 frames that advance by 16: late ones come again in the next window, some begin before their own; and all windows of each key."""
    iv = T.intervals(spark, sf)
    late = F.col("start") % 16 >= 10
    w = F.floor(F.col("start") / 16)
    iv = iv.withColumn("w", F.explode(F.when(late, F.array(w, w + 1)).otherwise(F.array(w)))).withColumn("w_start", F.col("w") * 16)
    start = F.when(F.col("start") % 16 == 0, F.greatest(F.lit(0), F.col("start") - 5)).otherwise(F.col("start"))
    cands = iv.withColumns({"end": F.col("end") + (F.col("w_start") > F.col("start")).cast("long"), "start": start}).filter("key % 9 <> 4 OR w <> 1")
    last = cands.groupBy("key").agg(F.max("w").alias("m"))
    windows = last.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("w")).withColumn("w_start", F.col("w") * 16)
    return cands.select("key", "w", "w_start", *RS.COLUMNS), windows


@query("win5_stories", f"""WITH RECURSIVE {FRAMES}, c0 AS (SELECT key, frame, unnest(CASE WHEN frame % 16 >= 10 THEN [frame // 16, frame // 16 + 1] ELSE [frame // 16] END) AS w, (frame + 1 + floor(x / 50))::BIGINT AS "end", kind AS action, CASE WHEN frame % 2 = 0 THEN 'left' ELSE 'both' END AS hand,
  CASE WHEN frame % 3 = 0 THEN 'The cup' ELSE 'cup' END AS object, kind || ' ' || frame AS sentence, CASE WHEN x < 15 THEN 'low' WHEN x < 50 THEN 'medium' ELSE 'high' END AS confidence FROM f),
c1 AS (SELECT key, w, CASE WHEN frame % 16 = 0 THEN greatest(0, frame - 5) ELSE frame END AS start, "end" + CASE WHEN w * 16 > frame THEN 1 ELSE 0 END AS "end", action, hand, object, 'cup' AS obj, sentence, confidence FROM c0 WHERE key % 9 <> 4 OR w <> 1),
ws AS (SELECT key, unnest(range(0, m + 1)) AS w FROM (SELECT key, max(w) AS m FROM c1 GROUP BY key)),
iv AS (SELECT ws.key * 100000 + ws.w AS key, c1.* EXCLUDE (key, w) FROM ws JOIN c1 ON c1.key = ws.key AND c1.w < ws.w), {stitch_sql(0.3)},
l AS (SELECT key, 'frames ' || start || '-' || "end" || ': ' || action || ', ' || sentence AS line, row_number() OVER (PARTITION BY key ORDER BY start) AS i, count(*) OVER (PARTITION BY key) AS n FROM st),
t AS (SELECT key, string_agg(line, chr(10) ORDER BY i) AS story FROM l WHERE i > n - 3 GROUP BY key)
SELECT ws.key, w, coalesce(story, '') AS story FROM ws LEFT JOIN t ON t.key = ws.key * 100000 + w""")
def win5_stories(spark, sf):
    return RS.restitched(*windowed(spark, sf), share=0.3)


@query("win8_continuation", f"""WITH {SEGMENTS} SELECT key, start, CASE WHEN hand = 'left' THEN 'A step began at frame ' || start || ' and was still going on: ' || action || '. If it goes on, report it again with that start.' END AS note FROM s""")
def win8_continuation(spark, sf):
    return T.segments(spark, sf).select("key", "start", W.continuation(F.when(F.col("hand") == "left", F.col("start")), F.col("action")).alias("note"))


# Reports.


@query("agg1_segment_stats", f"""WITH {SEGMENTS}, so AS (SELECT key, string_agg(start_source || ' ' || n, ',' ORDER BY start_source) AS sources FROM (SELECT key, start_source, count(*) AS n FROM s WHERE start > 0 GROUP BY 1, 2) GROUP BY key)
SELECT key, count(*) AS segments, round(count(*) / (max(n_frames) / 30.0::DOUBLE / 60), 6) AS per_minute, round(min("end" - start) / 30.0::DOUBLE, 6) AS shortest, round(median(("end" - start) / 30.0::DOUBLE), 6) AS median,
round(max("end" - start) / 30.0::DOUBLE, 6) AS longest, round(sum("end" - start) / (max(n_frames) - 1)::DOUBLE, 6) AS coverage, coalesce(any_value(sources), '') AS sources FROM s LEFT JOIN so USING (key) GROUP BY key""")
def agg1_segment_stats(spark, sf):
    out = R.segment_stats(T.segments(spark, sf), fps=V.FPS)
    return out.withColumn("sources", F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string"))), ","))


@query("agg2_histogram", f"WITH {SEGMENTS} SELECT action AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM s)::DOUBLE, 6) AS share FROM s GROUP BY action")
def agg2_histogram(spark, sf):
    return R.histogram(T.segments(spark, sf), "action")


@query("agg3_rates", f"WITH {SEGMENTS} SELECT hand, round(avg((confidence = 'low')::INT), 6) AS low_rate, round(avg((\"end\" - start > 1)::INT), 6) AS long_rate, count(*) AS n FROM s GROUP BY hand")
def agg3_rates(spark, sf):
    s = T.segments(spark, sf)
    return s.groupBy("hand").agg(F.round(R.rate(F.col("confidence") == "low"), 6).alias("low_rate"), F.round(R.rate(F.col("end") - F.col("start") > 1), 6).alias("long_rate"), F.count(F.lit(1)).alias("n"))


@query("agg4_top_opening", r"""WITH o AS (SELECT array_to_string(string_split_regex(trim(lower(text), E' \t\r\n'), '\s+')[1:2], ' ') AS opening, count(*) AS n FROM documents GROUP BY 1)
SELECT opening, n, round(n / (SELECT sum(n) FROM o)::DOUBLE, 6) AS share FROM o ORDER BY n DESC, opening LIMIT 1""")
def agg4_top_opening(spark, sf):
    return R.top_opening(T.read(spark, sf, "documents"), "text")


@query("agg5_naming", "SELECT p_brand AS key, count(DISTINCT regexp_replace(lower(trim(p_name)), '^the ', '')) AS names, count(*) AS rows FROM part GROUP BY 1 HAVING names > greatest(2, rows * 2 // 3)")
def agg5_naming(spark, sf):
    return R.naming_inconsistent(T.read(spark, sf, "part").withColumnRenamed("p_brand", "key"), "p_name")


_SOURCED = """so AS (SELECT * EXCLUDE (start_source, end_source), CASE start_source WHEN 'purchase' THEN 'grasp' ELSE start_source END AS start_source, CASE end_source WHEN 'signup' THEN 'release' ELSE end_source END AS end_source FROM s)"""


@query("agg6_verb_agreement", f"""WITH {SEGMENTS}, {_SOURCED} SELECT 'grasp_start' AS side, round(avg((action = 'grasp')::INT), 6) AS agreement, count(*) AS n FROM so WHERE start_source = 'grasp' HAVING count(*) > 0
UNION ALL SELECT 'release_end', round(avg((action = 'place')::INT), 6), count(*) FROM so WHERE end_source = 'release' HAVING count(*) > 0""")
def agg6_verb_agreement(spark, sf):
    named = lambda c, kind, name: F.when(F.col(c) == kind, name).otherwise(F.col(c))
    return R.verb_agreement(T.segments(spark, sf).withColumns({"start_source": named("start_source", "purchase", "grasp"), "end_source": named("end_source", "signup", "release")}))


@query("agg7_summary", f"""WITH {FLAGGED}, v AS (SELECT action, count(*) AS n FROM fl GROUP BY 1) SELECT count(*) AS subtasks, round(count(*) / count(DISTINCT key)::DOUBLE, 6) AS per_key, round(avg((short OR lowc)::INT), 6) AS flagged,
(SELECT string_agg(action || ' ' || n, ',' ORDER BY n DESC, action) FROM v) AS verbs FROM fl""")
def agg7_summary(spark, sf):
    return R.summary(I.flagged(I.merge_adjacent(T.segments(spark, sf))))


@query("agg16_throughput", """WITH r AS (SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'done' END AS status, event_id % 7 AS segments, value AS wall_s FROM events)
SELECT count_if(status = 'done')::BIGINT AS done, count_if(status = 'skipped')::BIGINT AS skipped, count_if(status = 'failed')::BIGINT AS failed, round(sum(segments) FILTER (status = 'done') / (sum(wall_s) FILTER (status = 'done') / 60), 6) AS segments_per_minute FROM r""")
def agg16_throughput(spark, sf):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("done")
    return R.throughput(T.read(spark, sf, "events").select(status.alias("status"), (F.col("event_id") % 7).alias("segments"), F.col("value").alias("wall_s")))


@query("snk3_boundary_mirror", f"""WITH {SEGMENTS}, q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start, "end") AS nth FROM s), b AS (SELECT key, start AS frame FROM q WHERE nth > 1 UNION ALL SELECT DISTINCT key, 0 FROM q UNION ALL SELECT key, max(n_frames) - 1 FROM q GROUP BY key)
SELECT key, frame, round_even(frame / 30.0::DOUBLE, 4) AS time FROM b""")
def snk3_boundary_mirror(spark, sf):
    return A.boundary_mirror(T.segments(spark, sf).withColumn("id", F.row_number().over(I.order()) - 1))


def _verdicts(spark, sf):
    """Documents with their judgement: quality where it was judged, toxic as a flag."""
    return T.read(spark, sf, "documents").select("doc_id", "lang", "source").join(T.read(spark, sf, "labels"), "doc_id", "left").withColumn("ok", F.col("quality") == 1)


_VERDICTS = "v AS (SELECT d.doc_id, lang, source, quality = 1 AS ok, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


@query("agg8_accuracy", f"WITH {_VERDICTS} SELECT source, round(avg(ok::INT), 6) AS accuracy, count(ok) AS judged FROM v GROUP BY source")
def agg8_accuracy(spark, sf):
    return R.judged(_verdicts(spark, sf), ["source"], "ok")


@query("agg9_by_verb", f"WITH {_VERDICTS} SELECT lang, round(avg(ok::INT), 6) AS accuracy, count(ok) AS judged FROM v GROUP BY lang HAVING count(ok) >= 3")
def agg9_by_verb(spark, sf):
    return R.judged(_verdicts(spark, sf), ["lang"], "ok").filter("judged >= 3")


@query("agg10_calibration", f"WITH {_VERDICTS} SELECT coalesce(toxic, 0) > 0 AS flagged, round(avg(ok::INT), 6) AS accuracy, count(ok) AS judged FROM v GROUP BY 1")
def agg10_calibration(spark, sf):
    return R.judged(_verdicts(spark, sf).withColumn("flagged", F.coalesce("toxic", F.lit(0)) > 0), ["flagged"], "ok")


@query("agg11_config_metrics", f"""WITH {SEGMENTS}, w AS (SELECT key % 5 AS config, key, count(DISTINCT frame // 16) AS windows, count(*) AS candidates, count(*) FILTER (valid) AS stitched, sum(x) AS wall_s FROM f GROUP BY 1, 2),
c AS (SELECT key % 5 AS config, key, "end" - start AS len, CASE WHEN action = 'place' THEN 'idle' ELSE action END AS action, confidence = 'low' AS low, hand = 'left' AS bad FROM s),
h AS (SELECT config, sum(n)::DOUBLE AS t, sum(n * log2(n)) AS z FROM (SELECT config, action, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
cw AS (SELECT config, sum(windows)::BIGINT AS windows, round(sum(wall_s) / sum(windows), 6) AS s_per_window, round(1 - sum(stitched) / sum(candidates)::DOUBLE, 6) AS merge_ratio FROM w GROUP BY 1),
cs AS (SELECT config, round(count(*) / count(DISTINCT key)::DOUBLE, 6) AS per_key, round(list_sort(list(len))[count(*) // 2 + 1] / 30.0::DOUBLE, 6) AS median_s, round(sum(CASE WHEN action = 'idle' THEN len ELSE 0 END) / sum(len)::DOUBLE, 6) AS idle_share,
  count(DISTINCT action) AS verbs, round(avg(low::INT), 6) AS low_confidence, round(avg(bad::INT), 6) AS flagged FROM c GROUP BY 1)
SELECT config, windows, s_per_window, merge_ratio, per_key, median_s, idle_share, verbs, round(log2(t) - z / t, 6) AS bits, low_confidence, flagged FROM cw JOIN cs USING (config) JOIN h USING (config)""")
def agg11_config_metrics(spark, sf):
    config = (F.col("key") % 5).alias("config")
    windows = T.frames(spark, sf).groupBy(config, "key").agg(F.count_distinct(F.floor(F.col("frame") / 16)).alias("windows"), F.count(F.lit(1)).alias("candidates"), F.count_if("valid").alias("stitched"), F.sum("x").alias("wall_s"))
    action = F.when(F.col("action") == "place", "idle").otherwise(F.col("action")).alias("action")
    flags = F.when(F.col("hand") == "left", F.array(F.lit("left"))).otherwise(F.array().cast("array<string>")).alias("flags")
    return R.config_metrics(windows, T.segments(spark, sf).select(config, "key", "start", "end", action, "confidence", flags))


@query("agg12_entropy", f"""WITH {SEGMENTS}, c AS (SELECT key % 5 AS config, action, count(*) AS n FROM s GROUP BY 1, 2), t AS (SELECT config, sum(n)::DOUBLE AS t, sum(n * log2(n)) AS w FROM c GROUP BY 1) SELECT config, round(log2(t) - w / t, 6) AS bits FROM t""")
def agg12_entropy(spark, sf):
    return R.entropy(T.segments(spark, sf).withColumn("config", F.col("key") % 5), ["config"], "action")


@query("agg13_boundary_f1", f"""WITH {SEGMENTS}, b AS (SELECT DISTINCT c.config, key, start // c.config * c.config + CASE WHEN hand = 'left' THEN c.config ELSE 0 END AS frame FROM s, (VALUES (1), (4), (9)) c(config) WHERE start > 0),
k AS (SELECT DISTINCT key FROM f), p AS (SELECT a.config, o.config AS other, k.key FROM (SELECT DISTINCT config FROM b) a, (SELECT DISTINCT config FROM b) o, k WHERE a.config <> o.config),
m AS (SELECT p.*, (SELECT count(*) FROM b WHERE b.config = p.config AND b.key = p.key) AS n, (SELECT count(*) FROM b WHERE b.config = p.config AND b.key = p.key AND EXISTS (SELECT 1 FROM b q WHERE q.config = p.other AND q.key = p.key AND abs(q.frame - b.frame) <= 1)) AS h FROM p),
j AS (SELECT x.config, x.other, x.n, x.h / nullif(x.n, 0)::DOUBLE AS pr, y.n AS m, y.h / nullif(y.n, 0)::DOUBLE AS re FROM m x JOIN m y ON x.config = y.other AND x.other = y.config AND x.key = y.key)
SELECT config, other, round(avg(CASE WHEN n = 0 AND m = 0 THEN 1.0 ELSE coalesce(2 * pr * re / nullif(pr + re, 0), 0) END), 6) AS f1 FROM j GROUP BY 1, 2""")
def agg13_boundary_f1(spark, sf):
    s = T.segments(spark, sf).filter("start > 0").withColumn("config", F.explode(F.array(F.lit(1), F.lit(4), F.lit(9))))
    frame = F.floor(F.col("start") / F.col("config")) * F.col("config") + F.when(F.col("hand") == "left", F.col("config")).otherwise(0)
    return R.boundary_f1(s.select("config", "key", frame.alias("frame")).distinct(), T.frames(spark, sf).select("key").distinct(), 1)


@query("agg14_top_values", """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS place FROM c) SELECT c_nationkey, c_mktsegment, n, place::INT AS place FROM o WHERE place <= 3""")
def agg14_top_values(spark, sf):
    return R.top_values(T.read(spark, sf, "customer"), "c_nationkey", "c_mktsegment", 3)


@query("agg15_tally", """WITH v AS (SELECT CASE WHEN p_size % 7 > 0 THEN p_brand END AS b, CASE WHEN p_size % 5 > 0 THEN p_type END AS w FROM part), u AS (SELECT b AS config, 1 AS best, 0 AS worst FROM v WHERE b IS NOT NULL AND w IS NOT NULL UNION ALL SELECT w, 0, 1 FROM v WHERE b IS NOT NULL AND w IS NOT NULL)
SELECT config, sum(best)::BIGINT AS best, sum(worst)::BIGINT AS worst, sum(best - worst)::BIGINT AS net FROM u GROUP BY 1""")
def agg15_tally(spark, sf):
    votes = T.read(spark, sf, "part").select(F.when(F.col("p_size") % 7 > 0, F.col("p_brand")).alias("b"), F.when(F.col("p_size") % 5 > 0, F.col("p_type")).alias("w"))
    return R.tally(votes, "b", "w")


# Scalar functions, hands and constraints.


@query("fn1_embedded_json", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (props->>'k')::INT END AS k FROM events""")
def fn1_embedded_json(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("no object")).otherwise(F.concat(F.lit("```json\nSure: "), F.col("props"), F.lit("\n```")))
    return T.read(spark, sf, "events").select("event_id", S.embedded_json(raw, "k int")["k"].alias("k"))


@query("fn2_styles", f"""WITH {SEGMENTS}, n AS (SELECT key, 'series/' || key AS name, 'series/' || key || '|embodiment' AS body FROM (SELECT DISTINCT key FROM s)), c AS (SELECT key, {crc32_sql("name")} AS a, {crc32_sql("body")} AS b FROM n)
SELECT key, (row_number() OVER (PARTITION BY key ORDER BY start, "end") - 1)::INT AS id, ((a + row_number() OVER (PARTITION BY key ORDER BY start, "end") - 1) % 6)::INT AS style_id, CASE WHEN b % 10000 / 10000 < 0.40 THEN 'arm' ELSE 'hand' END AS embodiment FROM s JOIN c USING (key)""")
def fn2_styles(spark, sf):
    name = F.concat(F.lit("series/"), F.col("key"))
    s = T.segments(spark, sf).withColumn("id", F.row_number().over(I.order()) - 1)
    return s.select("key", "id", S.style(name, F.col("id")).alias("style_id"), S.embodiment(name).alias("embodiment"))


def _two_hands(spark, sf):
    f = G.gradient(T.frames(spark, sf), "x", fps=1.0, into="g")
    return f.select("key", "frame", (F.col("x") / 100).alias("speed_left"), (F.col("g") / 100).alias("aperture_left"), F.when(F.col("valid"), F.col("x") / 200).otherwise(0.0).alias("speed_right"), (F.col("g") / 300).alias("aperture_right"))


HANDS = SEGMENTS + """, gg AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM f WINDOW w AS (PARTITION BY key ORDER BY frame)),
hh AS (SELECT key, frame, x / 100 AS sl, g / 100 AS al, CASE WHEN valid THEN x / 200 ELSE 0 END AS sr, g / 300 AS ar FROM (SELECT *, CASE WHEN b IS NULL THEN a - x WHEN a IS NULL THEN x - b ELSE (a - b) / 2 END AS g FROM gg)),
md AS (SELECT key, median(abs(sl)) AS sl, median(abs(al)) AS al, median(abs(sr)) AS sr, median(abs(ar)) AS ar FROM hh GROUP BY key),
me AS (SELECT s.key, start, avg(abs(sl)) AS sl, avg(abs(al)) AS al, avg(abs(sr)) AS sr, avg(abs(ar)) AS ar FROM s JOIN hh ON hh.key = s.key AND frame BETWEEN start AND "end" GROUP BY 1, 2),
ac AS (SELECT me.key, me.start AS id, me.sl / greatest(md.sl, 0.01) + me.al / greatest(md.al, 0.005) AS score_left, me.sr / greatest(md.sr, 0.01) + me.ar / greatest(md.ar, 0.005) AS score_right, me.sl > 0.04 OR me.al > 0.04 AS active_left, me.sr > 0.04 OR me.ar > 0.04 AS active_right FROM me JOIN md USING (key))"""


@query("fn8_hand_activity", f"WITH {HANDS} SELECT key, id, round(score_left, 5) AS score_left, round(score_right, 5) AS score_right, active_left, active_right FROM ac")
def fn8_hand_activity(spark, sf):
    out = H.activity(T.segments(spark, sf).withColumn("id", F.col("start")), _two_hands(spark, sf))
    # Ties go by the scaled double, as in SQL, not by the shortest decimal that stands for it.
    places = lambda c: (F.round(F.col(c) * 1e5) / 1e5).alias(c)
    return out.select("key", "id", places("score_left"), places("score_right"), "active_left", "active_right")


@query("fn9_joint_carry", f"""WITH {SEGMENTS}, a AS (SELECT s.key, start AS id, 100 + x AS apart FROM s JOIN f ON f.key = s.key AND frame BETWEEN start AND "end"), m AS (SELECT key, id, avg(apart) AS mean FROM a GROUP BY 1, 2)
SELECT key, id, avg((abs(apart - mean) < 0.15 * mean)::INT) > 0.70 AS joint_carry FROM a JOIN m USING (key, id) GROUP BY 1, 2""")
def fn9_joint_carry(spark, sf):
    f = T.frames(spark, sf).select("key", "frame", (F.col("x") + 100).alias("apart"))
    return H.carried_together(H.frames_inside(T.segments(spark, sf).withColumn("id", F.col("start")), f))


@query("fn10_hand_decision", f"""WITH {HANDS} SELECT key, id, CASE WHEN active_left AND NOT active_right THEN 'left' WHEN active_right AND NOT active_left THEN 'right' WHEN NOT active_left AND NOT active_right THEN CASE WHEN score_left >= score_right THEN 'left' ELSE 'right' END
WHEN score_left > 3 * score_right THEN 'left' WHEN score_right > 3 * score_left THEN 'right' WHEN id % 2 = 0 THEN 'both_coordinating' ELSE 'both' END AS hand FROM ac""")
def fn10_hand_decision(spark, sf):
    a = H.activity(T.segments(spark, sf).withColumn("id", F.col("start")), _two_hands(spark, sf))
    hand = H.decide(F.col("score_left"), F.col("score_right"), F.col("active_left"), F.col("active_right"), F.col("id") % 2 == 0, F.lit(False))
    return a.select("key", "id", hand.alias("hand"))


DECIDED = HANDS + """, dc AS (SELECT ac.*, CASE WHEN active_left AND NOT active_right THEN 'left' WHEN active_right AND NOT active_left THEN 'right' WHEN NOT active_left AND NOT active_right THEN CASE WHEN score_left >= score_right THEN 'left' ELSE 'right' END
WHEN score_left > 3 * score_right THEN 'left' WHEN score_right > 3 * score_left THEN 'right' WHEN id % 2 = 0 OR id % 5 = 0 THEN 'both_coordinating' ELSE 'both' END AS hand FROM ac)"""


@query("fn7_kinematic_summary", f"""WITH {DECIDED}, st AS (SELECT key, frame, abs(x - lag(x) OVER w) / 997.3::DOUBLE AS l, abs(x - lag(x) OVER w) / 3011.7::DOUBLE AS r FROM f WINDOW w AS (PARTITION BY key ORDER BY frame)),
pa AS (SELECT s.key, s.start AS id, coalesce(sum(l), 0) AS l, coalesce(sum(r), 0) AS r FROM s LEFT JOIN st ON st.key = s.key AND frame > start AND frame <= "end" GROUP BY 1, 2),
ev AS (SELECT key, frame, CASE WHEN kind = 'purchase' THEN 'grasp' ELSE 'release' END AS type, CASE WHEN x < 40 THEN 'left' ELSE 'right' END AS hand FROM f WHERE kind IN ('purchase', 'signup')),
ti AS (SELECT s.key, s.start AS id, ev.hand, string_agg(printf('%s event at %.1fs', type, frame / 30.0::DOUBLE), ', ' ORDER BY frame, type) AS told FROM s JOIN ev ON ev.key = s.key AND frame >= start AND frame < "end" GROUP BY 1, 2, 3),
sd AS (SELECT key, id, 'Left hand: ' || CASE WHEN l < 0.05 THEN 'mostly static' ELSE printf('moved %.2fm', l) END || coalesce(', ' || (SELECT told FROM ti WHERE ti.key = pa.key AND ti.id = pa.id AND hand = 'left'), '') || '.' AS lt,
  'Right hand: ' || CASE WHEN r < 0.05 THEN 'mostly static' ELSE printf('moved %.2fm', r) END || coalesce(', ' || (SELECT told FROM ti WHERE ti.key = pa.key AND ti.id = pa.id AND hand = 'right'), '') || '.' AS rt FROM pa)
SELECT key, id, 'Active hand (computed from motion): ' || hand || CASE WHEN hand <> 'both_coordinating' THEN '' WHEN id % 2 = 0 THEN ' (handover)' ELSE ' (joint_carry)' END || '. ' || lt || ' ' || rt AS summary FROM dc JOIN sd USING (key, id)""")
def fn7_kinematic_summary(spark, sf):
    f, segments = T.frames(spark, sf), T.segments(spark, sf).withColumn("id", F.col("start"))
    line = Window.partitionBy("key").orderBy("frame")
    step = f.select("key", "frame", F.abs(F.col("x") - F.lag("x").over(line)).alias("step"))
    paths = H.inside_sums(segments, step, {}, {"left": F.col("step") / 997.3, "right": F.col("step") / 3011.7})
    kind = F.when(F.col("kind") == "purchase", "grasp").otherwise("release")
    events = f.filter("kind IN ('purchase', 'signup')").select("key", "frame", kind.alias("type"), F.col("x").alias("magnitude"), F.when(F.col("x") < 40, "left").otherwise("right").alias("hand"))
    a = H.activity(segments, _two_hands(spark, sf))
    hand = H.decide(F.col("score_left"), F.col("score_right"), F.col("active_left"), F.col("active_right"), F.col("id") % 2 == 0, F.col("id") % 5 == 0)
    rows = E.events_inside(segments, events).join(a.select("key", "id", hand.alias("decided")), ["key", "id"]).join(paths, ["key", "id"])
    text = H.kinematic_summary(F.col("decided"), H.coordination(F.col("decided"), F.col("id") % 2 == 0), {"left": F.col("left"), "right": F.col("right")}, F.col("events_inside"))
    return rows.select("key", "id", text.alias("summary"))


_WORDS = "; ".join(f"{g}: {', '.join(a)}" for g, a in V.ACTION_GROUPS.items())


@query("fn6_prompts", f"""WITH {SEGMENTS} SELECT key, start, 'What happens from frame ' || start || ' to ' || "end" || '? Answer as JSON with action, hand, object, sentence, confidence. Actions are {_WORDS}.' || CASE WHEN hand = 'left' THEN ' Hint: ' || kind || ' with ' || object ELSE '' END AS prompt
FROM (SELECT *, start_source AS kind FROM s)""")
def fn6_prompts(spark, sf):
    hint = F.when(F.col("hand") == "left", F.concat_ws(" ", "start_source", F.lit("with"), "object"))
    return L.prompts(T.segments(spark, sf).withColumn("hint", hint), hint="hint").select("key", "start", "prompt")


@query("con2_violations", f"""WITH {SEGMENTS}, r AS (SELECT *, row_number() OVER w - 1 AS place, lag("end") OVER w AS before, lead(start) OVER w IS NULL AS last FROM s WHERE start_source <> 'view' WINDOW w AS (PARTITION BY key ORDER BY start)),
b AS (SELECT key, place, n_frames, last, before, confidence, CASE WHEN place % 7 <> 3 THEN action END AS action, CASE WHEN place % 5 <> 2 THEN hand END AS hand, start, CASE WHEN place % 11 <> 4 THEN "end" END AS "end", lag(CASE WHEN place % 11 <> 4 THEN "end" END) OVER (PARTITION BY key ORDER BY place) AS bf FROM r)
SELECT key, place::INT AS id, rule FROM (SELECT *, unnest(list_filter([CASE WHEN action IS NULL THEN 'action' END, CASE WHEN hand IS NULL THEN 'hand' END, CASE WHEN place = 0 AND start <> 0 THEN 'start' END, CASE WHEN place > 0 AND (bf IS NULL OR start <> bf) THEN 'contiguous' END, CASE WHEN last AND ("end" IS NULL OR "end" <> n_frames - 1) THEN 'end' END,
  CASE WHEN "end" IS NULL THEN 'empty' END, CASE WHEN ("end" IS NULL OR "end" - start < 2) AND n_frames - 1 >= 2 THEN 'length' END], lambda x: x IS NOT NULL)) AS rule FROM b) UNION ALL SELECT DISTINCT key, NULL, 'no_rows' FROM f WHERE key NOT IN (SELECT key FROM r)""")
def con2_violations(spark, sf):
    """Actions, hands and ends are null here and there, and keys without any row left are asked for."""
    rows = T.segments(spark, sf).filter("start_source <> 'view'").withColumn("id", F.row_number().over(Window.partitionBy("key").orderBy("start")) - 1)
    some = lambda c, every, place: F.when(F.col("id") % every != place, F.col(c))
    rows = rows.withColumns({"action": some("action", 7, 3), "hand": some("hand", 5, 2), "end": some("end", 11, 4)}).drop("sentence")
    return C.violations(rows, least=2, keys=T.frames(spark, sf).select("key"))


@query("snk4_quarantine", f"""WITH {SEGMENTS}, r AS (SELECT *, lag("end") OVER (PARTITION BY key ORDER BY start) AS before FROM s WHERE NOT (start_source = 'view' AND key % 3 = 0)), l AS (SELECT key, min(start) AS a, max("end") AS b, max(n_frames) AS n, count_if(start <> before) AS gaps FROM r GROUP BY key)
SELECT r.key, start, "end", a = 0 AND b = n - 1 AND gaps = 0 AS valid FROM r JOIN l USING (key)""")
def snk4_quarantine(spark, sf):
    rows = T.segments(spark, sf).filter("NOT (start_source = 'view' AND key % 3 = 0)").withColumn("id", F.row_number().over(Window.partitionBy("key").orderBy("start")) - 1)
    good, bad = C.split_valid(rows)
    return good.select("key", "start", "end", F.lit(True).alias("valid")).unionByName(bad.select("key", "start", "end", F.lit(False).alias("valid")))


@query("con3_category_audit", """WITH t AS (SELECT DISTINCT p_type AS task FROM part WHERE p_size < 45), c AS (SELECT p_type AS task, p_brand AS category, CASE WHEN p_size > 48 THEN 'dance' ELSE 'grasp' END AS verb FROM part WHERE p_size > 40)
SELECT 'unmapped' AS check, count(*) AS failing, count(*) = 0 AS passed FROM t WHERE task NOT IN (SELECT task FROM c) UNION ALL SELECT 'ghost', count(DISTINCT task), count(*) = 0 FROM c WHERE task NOT IN (SELECT task FROM t)
UNION ALL SELECT 'mapped_twice', count(*), count(*) = 0 FROM (SELECT task FROM c GROUP BY task HAVING count(*) > 1) UNION ALL SELECT 'unknown_verb', count(*), count(*) = 0 FROM c WHERE verb = 'dance'""")
def con3_category_audit(spark, sf):
    part = T.read(spark, sf, "part")
    verbs = F.array(F.when(F.col("p_size") > 48, "dance").otherwise("grasp"))
    categories = part.filter("p_size > 40").select(F.col("p_type").alias("task"), F.col("p_brand").alias("category"), verbs.alias("verbs"))
    return U.audit_categories(part.filter("p_size < 45").select(F.col("p_type").alias("task")), categories, V.ACTIONS)


@query("con4_series_audit", f"""WITH {FRAMES}, g AS (SELECT key, count(*) AS rows, count(DISTINCT frame) AS d, max(frame) AS last, count_if(x IS NULL) AS broken, avg((NOT valid)::INT) AS inv FROM f WHERE NOT (key = 3 AND frame = 5) GROUP BY key),
n AS (SELECT key, count(*) + CASE WHEN key % 50 = 0 THEN 2 ELSE 0 END AS n FROM f WHERE key <> 4 GROUP BY key), b AS (SELECT * FROM g FULL JOIN n USING (key)),
c AS (SELECT unnest([{{'check': 'paired', 'bad': rows IS NULL OR n IS NULL}}, {{'check': 'dense', 'bad': coalesce(d <> last + 1, TRUE)}}, {{'check': 'single', 'bad': coalesce(rows <> d, TRUE)}}, {{'check': 'length', 'bad': coalesce(abs(rows - n) > 1, TRUE)}},
{{'check': 'finite', 'bad': coalesce(broken > 0, TRUE)}}, {{'check': 'invalid_share', 'bad': coalesce(inv > 0.2, TRUE)}}, {{'check': 'long_enough', 'bad': coalesce(rows < 52, TRUE)}}]) AS r FROM b)
SELECT r.check AS check, count_if(r.bad)::BIGINT AS failing, count_if(r.bad) = 0 AS passed FROM c GROUP BY 1""")
def con4_series_audit(spark, sf):
    f = T.frames(spark, sf)
    n = F.count(F.lit(1)) + F.when(F.first("key") % 50 == 0, 2).otherwise(0)
    declared = f.filter("key <> 4").groupBy("key").agg(n.alias("n_frames"))
    return U.audit_series(f.filter("NOT (key = 3 AND frame = 5)"), declared, most_invalid=0.2, least_frames=52)


def _answers(prompt: str) -> str:
    """A labeler that answers by the first frame that the prompt names, and breaks down at some."""
    start = int(prompt.rsplit("from frame ", 1)[1].split(" ", 1)[0])
    if start % 41 == 37:
        raise RuntimeError("no model")
    action, hand = ("reach", "grasp", "place")[start % 3], "none" if start % 43 == 40 else ("left", "right")[start % 2]
    return json.dumps({"action": action, "hand": hand, "object": "the cup" if start % 4 else "cup", "sentence": f"step at {start}", "confidence": ("low", "medium", "high")[start % 3]})


def _levels(spark, sf):
    return D.Levels(spark, commits.shared_folder(spark), lambda: _answers, least=8, idle_gap_s=0.1, propose={"least": 5, "window": 4, "pause_speed": 20.0, "prominence": 10.0, "gaze_floor": 20.0, "move": 60.0}, label={"wait_s": 0.0, "attempts": 2})


LEVELS = f"""{CANDIDATES}, {fuse_sql(4, 5, 60.0)},
sg AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start) - 1 AS id FROM (SELECT key, frame AS start, lead(frame) OVER w AS "end", source AS start_source, lead(source) OVER w AS end_source FROM fused WINDOW w AS (PARTITION BY key ORDER BY frame)) WHERE "end" > start),
lost AS (SELECT DISTINCT key FROM sg WHERE start % 41 = 37), size AS (SELECT key, max(frame) + 1 AS n_frames FROM f GROUP BY key),
s AS (SELECT sg.*, n_frames, ['reach', 'grasp', 'place'][start % 3 + 1] AS action, CASE WHEN start % 43 = 40 THEN 'none' ELSE ['left', 'right'][start % 2 + 1] END AS hand, CASE WHEN start % 4 = 0 THEN 'cup' ELSE 'the cup' END AS object, 'step at ' || start AS sentence, ['low', 'medium', 'high'][start % 3 + 1] AS confidence
  FROM sg JOIN size USING (key) WHERE key NOT IN (SELECT key FROM lost)){MERGED[len(SEGMENTS):]}, {absorb_sql('m', 8)}, {idle_sql('ab', 3)}, um AS (SELECT key, list_sort(list("end" - start))[count(*) // 2 + 1] AS med FROM idled GROUP BY key),
wrong AS (SELECT DISTINCT key FROM idled WHERE hand NOT IN ('left', 'right', 'both', 'both_coordinating'))"""


@query("drv1_levels", f"""WITH RECURSIVE {FRAMES}, {LEVELS}
SELECT key, id, start, "end", action, hand, object, confidence, sentence, start_source, end_source, round(start / 30.0::DOUBLE, 6) AS start_time, concat_ws(',', CASE WHEN med > 0 AND ("end" - start) < 0.34 * med THEN 'short_segment' END, CASE WHEN confidence = 'low' THEN 'low_confidence' END) AS flags
FROM idled JOIN um USING (key) WHERE key NOT IN (SELECT key FROM wrong)""")
def drv1_levels(spark, sf):
    """Half of the keys in one run, all in the next, and a third one that has nothing to add."""
    levels, (series, events) = _levels(spark, sf), _series(spark, sf)
    levels.run(series, events, keys=series.filter("key % 2 = 0"))
    for _ in range(2):
        levels.run(series, events)
    out = levels.stores["annotations"].read()
    return out.select("key", "id", "start", "end", "action", "hand", "object", "confidence", "sentence", "start_source", "end_source", F.round("start_time", 6).alias("start_time"), F.array_join("flags", ",").alias("flags"))


@query("drv2_status", f"""WITH RECURSIVE {FRAMES}, {LEVELS}, k AS (SELECT key, key % 2 = 0 AS even, key IN (SELECT key FROM lost) AS l, key IN (SELECT key FROM lost) OR key IN (SELECT key FROM wrong) AS w FROM size)
SELECT 1 AS run, 'boundaries' AS level, count_if(even)::BIGINT AS done, 0::BIGINT AS skipped, 0::BIGINT AS failed FROM k UNION ALL SELECT 1, 'labels', count_if(even AND NOT l), 0, count_if(even AND l) FROM k UNION ALL SELECT 1, 'annotations', count_if(even AND NOT w), 0, count_if(even AND w) FROM k
UNION ALL SELECT 2, 'boundaries', count_if(NOT even), count_if(even), 0 FROM k UNION ALL SELECT 2, 'labels', count_if(NOT even AND NOT l), count_if(even AND NOT l), count_if(l) FROM k UNION ALL SELECT 2, 'annotations', count_if(NOT even AND NOT w), count_if(even AND NOT w), count_if(w) FROM k""")
def drv2_status(spark, sf):
    """What became of the keys in a run over half of them and one over all: those that failed are tried again, and fail no other."""
    levels, (series, events) = _levels(spark, sf), _series(spark, sf)
    first = levels.run(series, events, keys=series.filter("key % 2 = 0")).withColumn("run", F.lit(1))
    return first.unionByName(levels.run(series, events).withColumn("run", F.lit(2)))


@query("drv3_sweep", f"""WITH {N}, c(config, span, advance) AS (VALUES ('s0_o33', 12, 8), ('s1_o33', 24, 16), ('s2_o33', 36, 24), ('s1_o00', 24, 24), ('s1_o50', 24, 12)),
w AS (SELECT key, config, n_frames, span, advance, unnest(range(0, greatest(0, ceil((n_frames - span) / advance))::BIGINT + 1)) AS w FROM n, c)
SELECT config, count(*) AS windows, sum(least(w * advance + span - 1, n_frames - 1) - w * advance + 1)::BIGINT AS frames, max(w)::INT AS last FROM w GROUP BY config""")
def drv3_sweep(spark, sf):
    n = T.frames(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n_frames"))
    grid = {"s0_o33": (12, 0, 0.33), "s1_o33": (12, 1, 0.33), "s2_o33": (12, 2, 0.33), "s1_o00": (12, 1, 0.0), "s1_o50": (12, 1, 0.5)}
    return W.sweep(n, grid).groupBy("config").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.col("w_end") - F.col("w_start") + 1).alias("frames"), F.max("w").alias("last"))


# Poses, probes, labels and records.


POSE16 = "p AS (SELECT vec_id, embedding[1:16] AS m, CASE WHEN vec_id % 3 > 0 THEN CASE WHEN vec_id % 11 = 0 THEN 'nan'::DOUBLE ELSE abs(embedding[17])::DOUBLE * 4 END END AS c FROM embeddings)"


def _pose16(spark, sf):
    v = T.read(spark, sf, "embeddings")
    own = F.abs(F.get("embedding", F.lit(16))).cast("double") * 4
    confidence = F.when(F.col("vec_id") % 3 > 0, F.when(F.col("vec_id") % 11 == 0, F.lit(float("nan"))).otherwise(own))
    return v.select("vec_id", F.slice("embedding", 1, 16).alias("m"), confidence.alias("c"))


@query("sig1_translation", f"WITH {POSE16} SELECT vec_id, m[4]::DOUBLE AS x, m[8]::DOUBLE AS y, m[12]::DOUBLE AS z FROM p")
def sig1_translation(spark, sf):
    return _pose16(spark, sf).select("vec_id", G.translation(F.col("m")).alias("t")).select("vec_id", "t.*")


@query("sig2_rotation", f"WITH {POSE16} SELECT vec_id, {', '.join(f'm[{4 * (i // 3) + i % 3 + 1}]::DOUBLE AS r{i}' for i in range(9))} FROM p")
def sig2_rotation(spark, sf):
    return _pose16(spark, sf).select("vec_id", G.rotation(F.col("m")).alias("r")).select("vec_id", *[F.get("r", F.lit(i)).alias(f"r{i}") for i in range(9)])


@query("sel6_joint_valid", f"WITH {POSE16} SELECT vec_id, CASE WHEN c IS NOT NULL THEN NOT isnan(c) AND c >= 0.5 ELSE vec_id % 5 > 0 END AS valid FROM p")
def sel6_joint_valid(spark, sf):
    """Every fifth pose has an entry that is no number."""
    broken = F.transform("m", lambda v, i: F.when((F.col("vec_id") % 5 == 0) & (i == 7), F.lit(float("nan"))).otherwise(v))
    return _pose16(spark, sf).select("vec_id", G.joint_valid(F.col("c"), broken).alias("valid"))


@query("sel14_ongoing", f"""WITH {FRAMES}, c AS (SELECT key, frame AS start, least(frame + 1 + floor(x / 50), 16 * (frame // 16) + 15)::BIGINT AS "end", CASE WHEN frame % 3 > 0 THEN frame % 3 = 1 END AS ongoing FROM f WHERE kind IN ('view', 'click'))
SELECT key, start, "end", coalesce(ongoing, FALSE) AS ongoing FROM c WHERE "end" > start""")
def sel14_ongoing(spark, sf):
    c = T.intervals(spark, sf).withColumns({"action": F.when(F.col("action").isin("view", "click"), "reach").otherwise("dance"), "sentence": F.lit(" a step "), "w_start": F.floor(F.col("start") / 16) * 16, "ongoing": F.when(F.col("start") % 3 > 0, F.col("start") % 3 == 1)})
    return W.valid_candidates(c.withColumn("w_end", F.col("w_start") + 15)).select("key", "start", "end", "ongoing")


@query("srt2_numeric_stems", "SELECT p_brand, p_partkey::VARCHAR AS stem, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part")
def srt2_numeric_stems(spark, sf):
    stems = T.read(spark, sf, "part").select("p_brand", F.col("p_partkey").cast("string").alias("stem"))
    return stems.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(S.numeric_stem(F.col("stem")), "stem")).cast("long"))


SRC7 = """WITH e AS (SELECT o_custkey AS episode, ['transforms/leftHand', 'transforms/rightHand', 'transforms/camera', 'transforms/leftThumbTip', 'transforms/rightIndexFingerTip', 'confidences/leftHand', 'transforms/rightThumbTip'][o_orderkey % 7 + 1] AS name, o_orderkey % 100 AS length FROM orders)
SELECT episode, concat_ws(' ', CASE WHEN NOT bool_or(name LIKE 'transforms/%') THEN 'transforms' END, CASE WHEN NOT bool_or(name = 'transforms/camera') THEN 'transforms/camera' END, CASE WHEN NOT bool_or(name = 'transforms/leftHand') THEN 'transforms/leftHand' END, CASE WHEN NOT bool_or(name = 'transforms/leftThumbTip') THEN 'transforms/leftThumbTip' END) AS missing,
  coalesce(string_agg(DISTINCT name[12:], ' ' ORDER BY name[12:]) FILTER (name LIKE 'transforms/left%' AND name <> 'transforms/leftHand'), '') AS joints_left, coalesce(string_agg(DISTINCT name[12:], ' ' ORDER BY name[12:]) FILTER (name LIKE 'transforms/right%' AND name <> 'transforms/rightHand'), '') AS joints_right,
  max(length) FILTER (name = 'transforms/leftHand') AS n_frames, bool_or(name LIKE 'confidences/%') AS has_confidences FROM e GROUP BY episode"""


def _probed(spark, sf):
    names = ["transforms/leftHand", "transforms/rightHand", "transforms/camera", "transforms/leftThumbTip", "transforms/rightIndexFingerTip", "confidences/leftHand", "transforms/rightThumbTip"]
    entries = T.read(spark, sf, "orders").select(F.col("o_custkey").alias("episode"), F.get(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 7).cast("int")).alias("name"), (F.col("o_orderkey") % 100).alias("length"))
    return files.probe_keys(entries, ["transforms", "transforms/camera", "transforms/leftHand", "transforms/leftThumbTip"])


@query("src7_probe", SRC7)
def src7_probe(spark, sf):
    out = _probed(spark, sf)
    return out.select("episode", *[F.array_join(c, " ").alias(c) for c in ("missing", "joints_left", "joints_right")], "n_frames", "has_confidences")


@query("evt16_transitions", f"""WITH {FRAMES}, t AS (SELECT key, least(frame + CASE WHEN x > 60 THEN 1 ELSE 0 END, last) AS frame, 'from ' || prev AS before, 'to ' || kind AS after, frame AS nth FROM (SELECT *, lag(kind) OVER (PARTITION BY key ORDER BY frame) AS prev, max(frame) OVER (PARTITION BY key) AS last FROM f) WHERE kind <> prev),
b AS (SELECT key, 0 AS frame, NULL AS before, NULL AS after, -1 AS nth FROM f GROUP BY key UNION ALL SELECT * FROM t UNION ALL SELECT key, max(frame), NULL, NULL, 1000000000 FROM f GROUP BY key),
g AS (SELECT *, lead(frame) OVER (PARTITION BY key ORDER BY frame, nth) AS "end" FROM b)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY frame) - 1 AS id, frame AS start, "end", before, after FROM g WHERE "end" > frame""")
def evt16_transitions(spark, sf):
    """Boundaries where the kind changes, some of which fall on one frame; what was seen before and after them goes to the segment on their right."""
    line, whole = Window.partitionBy("key").orderBy("frame"), Window.partitionBy("key")
    f = T.frames(spark, sf).withColumns({"prev": F.lag("kind").over(line), "last": F.max("frame").over(whole)})
    at = F.least(F.col("frame") + (F.col("x") > 60).cast("long"), F.col("last"))
    found = f.filter("kind <> prev").select("key", at.alias("frame"), F.concat(F.lit("from "), "prev").alias("before"), F.concat(F.lit("to "), "kind").alias("after"), F.col("frame").alias("nth"))
    ends = f.groupBy("key").agg(F.max("frame").alias("l")).select("key", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("frame"), F.lit(-1).cast("long").alias("nth")), F.struct(F.col("l").alias("frame"), F.lit(1 << 40).alias("nth")))).alias("e")).select("key", "e.*")
    return E.segments_between(found.unionByName(ends, allowMissingColumns=True), order=["frame", "nth"]).select("key", "id", "start", "end", "before", "after")


@query("fn5_category_block", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'Task family ' || p_brand || '.' || chr(10) ELSE 'Task family ' || p_brand || ': ' || p_type || ' Verbs often seen in it: ' || CASE WHEN p_size % 2 = 0 THEN 'grasp, ' ELSE '' END || 'place (a prior, no rule).' || chr(10) END AS block FROM part""")
def fn5_category_block(spark, sf):
    name = F.when(F.col("p_size") % 4 > 0, F.col("p_brand"))
    hint = F.when(F.col("p_size") % 4 > 1, F.concat(F.lit(" "), "p_type", F.lit(" ")))
    verbs = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("grasp"), F.lit("place"))).otherwise(F.array(F.lit("place")))
    return T.read(spark, sf, "part").select("p_partkey", L.category_block(name, hint, verbs).alias("block"))


@query("udf6_rounds", f"""WITH {N}, q AS (SELECT key, w, w * 12 + key % 7 AS start, w + 1 AS nth FROM (SELECT key, unnest(range(0, ceil(n_frames / 12)::BIGINT)) AS w FROM n)), lost AS (SELECT key, min(nth) AS nth FROM q WHERE start % 41 = 37 GROUP BY key)
SELECT q.key, w AS id, CASE WHEN q.nth < coalesce(l.nth, 1000000) THEN ['reach', 'grasp', 'place'][start % 3 + 1] END AS action, CASE WHEN q.nth < coalesce(l.nth, 1000000) THEN 'step at ' || start || ' after ' || least(q.nth - 1, 3) END AS sentence, q.nth = coalesce(l.nth, 1000000) AS failed
FROM q LEFT JOIN lost l ON l.key = q.key WHERE q.nth <= coalesce(l.nth, 1000000)""")
def udf6_rounds(spark, sf):
    """Chunks of series as segments. Sentences tell how many of those before were in the prompt; a key's labelling ends where its labeler breaks down."""

    def answers(prompt: str) -> str:
        label = json.loads(_answers(prompt))
        return json.dumps(label | {"sentence": f"{label['sentence']} after {prompt.count('Before: ')}"})

    n = T.frames(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n_frames"))
    start = F.col("w_start") + F.col("key") % 7
    rows = L.prompts(W.tumbling(n, frames=12).select("key", F.col("w").cast("long").alias("id"), start.alias("start"), (start + 11).alias("end")))
    out = L.label_in_rounds(rows, lambda: answers, commits.shared_folder(spark), attempts=2, wait_s=0.0, strict=True)
    return out.select("key", "id", "action", "sentence", F.col("error").isNotNull().alias("failed"))


@query("con4_level0", f"""WITH u AS ({ORACLE_SQL['jn1_unpaired']}), pr AS ({ORACLE_SQL['src7_probe']}), sa AS ({ORACLE_SQL['sig14_sanity']}), ca AS ({ORACLE_SQL['sig14_camera']}), sn AS (SELECT invalid_share, camera_travel, camera_above FROM sa FULL JOIN ca USING (key)),
le AS (SELECT c_custkey % 7 AS n, c_nationkey % 9 AS d FROM customer),
c AS (SELECT 'paired' AS k, (SELECT count(*) FROM u) AS failing UNION ALL SELECT 'wrists', (SELECT count_if(contains(missing, 'Hand')) FROM pr) UNION ALL SELECT 'pinch', (SELECT count_if(contains(missing, 'Tip')) FROM pr) UNION ALL SELECT 'camera', (SELECT count_if(contains(missing, 'camera')) FROM pr)
  UNION ALL SELECT 'encoding', (SELECT count_if(invalid_share IS NULL) FROM sn) UNION ALL SELECT 'world_frame', (SELECT count_if(NOT coalesce(camera_travel > 0.01 AND camera_above, FALSE)) FROM sn) UNION ALL SELECT 'invalid_share', (SELECT count_if(coalesce(invalid_share >= 0.15, TRUE)) FROM sn) UNION ALL SELECT 'length', (SELECT count_if(abs(n - d) > 1) FROM le))
SELECT k AS "check", failing::BIGINT AS failing, failing = 0 AS passed FROM c""")
def con4_level0(spark, sf):
    poses = _poses(spark, sf).withColumns({"valid": F.lit(True), "up": F.col("p1") - F.col("p4")})
    camera = G.sanity(poses, ["p3"], "valid", camera=["p0", "p1"], height="up").select("key", "camera_travel", "camera_above")
    sanity = G.sanity(T.frames(spark, sf), ["x"], "valid").select("key", "invalid_share").join(camera, "key", "full_outer")
    lengths = T.read(spark, sf, "customer").select((F.col("c_custkey") % 7).alias("n_frames"), (F.col("c_nationkey") % 9).alias("declared"))
    return U.audit_level0(jn1_unpaired(spark, sf), _probed(spark, sf), sanity, lengths, most_invalid=0.15)
