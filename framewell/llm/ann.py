"""Nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard, stored as flat neighbour arrays, with shard results merged."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import table

#: Vectors in a shard, which bounds an index row and the memory of a task, and the fewest shards of a large table.
SHARD_ROWS, LEAST_SHARDS = 32768, 6
#: Neighbours of a node in the upper levels and in the lowest one; candidates for neighbours.
M, M0, CANDIDATES = 16, 40, 56
#: By how many powers of two the lengths of a shard's vectors may differ.
SPREAD = 2
#: Each level holds one of so many nodes of the one below.
THIN = 16
#: Nodes that a search keeps in the lowest level, and in those above.
EF, EF_UPPER = 200, 24
#: Rows that numpy handles at once.
BLOCK = 512


@dataclass
class Graph:
    """Vectors of one shard; for each level its nodes and their neighbours, -1 where there are fewer. Level 0 has all nodes."""

    vectors: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]


def _select(near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, m: int) -> np.ndarray:
    """For each row of candidates, nearest first, those nearer to the node than to any chosen one; the nearest of the rest fill up to m."""
    between = np.einsum("bid,bjd->bij", vectors[near], vectors[near], optimize=True)
    chosen = np.zeros(near.shape, bool)
    closest = np.full(near.shape, -np.inf, np.float32)
    for j in range(near.shape[1]):
        take = (closest[:, j] < sims[:, j]) & (chosen.sum(1) < m) & (near[:, j] >= 0) & np.isfinite(sims[:, j])
        chosen[:, j] = take
        closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
    order = np.argsort(np.where(chosen, 0, 1) + np.where(np.isfinite(sims), 0, 2), axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(near, order, 1)
    return np.where(np.isfinite(np.take_along_axis(sims, order, 1)), out, -1)


def _nearest(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, pool: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of ``pool`` to each query but itself, nearest first."""
    sims = queries @ vectors[pool].T
    sims[own[:, None] == pool[None, :]] = -np.inf
    k = min(k, len(pool))
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(pool) else np.broadcast_to(np.arange(k), (len(queries), k))
    got = np.take_along_axis(sims, at, 1)
    order = np.argsort(-got, axis=1, kind="stable")
    return pool[np.take_along_axis(at, order, 1)], np.take_along_axis(got, order, 1)


def _level(vectors: np.ndarray, size: int, m: int, upper: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One level with the first ``size`` nodes, below the levels ``upper`` (lowest first): its nodes and their neighbours.

    Nodes are inserted in order, up to BLOCK at once and never more than there are already. A new node searches the graph as it stands, chooses half of its m neighbours among
    what it finds and among the nodes inserted with it by the selection rule, and keeps them; the other half are the nearest of those that chose it.
    """
    nodes, half = np.arange(size, dtype=np.int32), m // 2
    links, back = np.full((size, m), -1, np.int32), np.full((size, m - half), -np.inf, np.float32)
    begin = 0
    while begin < size:
        own = nodes[begin : min(size, begin + max(min(begin, BLOCK), 1))]
        ids, sims = _nearest(vectors[own], own, vectors, own, min(half, len(own)))
        sims = np.where(ids == own[:, None], -np.inf, sims)
        if begin:
            graph = Graph(vectors, [(nodes[:begin], links[:begin]), *upper])
            start = _descend(graph, vectors[own])
            start = np.concatenate([np.where(start < begin, start, -1), np.broadcast_to(nodes[: min(begin, 4)], (len(own), min(begin, 4)))], 1)
            found, near = _beam(graph, 0, vectors[own], start, CANDIDATES)
            ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, near], 1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :CANDIDATES]
        chosen = _select(np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), vectors, half)
        links[own, : chosen.shape[1]] = chosen
        begin += len(own)

        target, source = chosen.ravel(), np.repeat(own, chosen.shape[1])
        new = target >= 0
        new[new] = ~(links[target[new], :half] == source[new, None]).any(1)
        target, source = target[new], source[new]
        near = np.einsum("ij,ij->i", vectors[target], vectors[source])
        order = np.lexsort((-near, target))
        target, source, near = target[order], source[order], near[order]
        touched, first, counts = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, counts)
        keep, row = rank < m - half, np.repeat(np.arange(len(touched)), counts)
        ids, sims = np.full((len(touched), m - half), -1, np.int32), np.full((len(touched), m - half), -np.inf, np.float32)
        ids[row[keep], rank[keep]], sims[row[keep], rank[keep]] = source[keep], near[keep]
        ids, sims = np.concatenate([links[touched, half:], ids], 1), np.concatenate([back[touched], sims], 1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : m - half]
        links[touched, half:], back[touched] = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return nodes, links


def build(vectors: np.ndarray) -> Graph:
    """The graph of a shard, built by insertion from the top level down. Positions are a random order, so that a level's nodes are the first ones."""
    sizes = [len(vectors)]
    while sizes[-1] > 2 * THIN:
        sizes.append(math.ceil(sizes[-1] / THIN))
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(len(sizes) - 1, -1, -1):
        levels.insert(0, _level(vectors, sizes[at], M if at else M0, levels))
    return Graph(vectors, levels)


def _beam(graph: Graph, level: int, queries: np.ndarray, start: np.ndarray, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries in step: the ef nearest found and their similarities, nearest first, -1 where fewer."""
    nodes, links = graph.levels[level]
    b, n, rows = len(queries), len(nodes), np.arange(len(queries))[:, None]
    seen = np.zeros((b, n + 1), bool)
    ids = np.full((b, ef), -1, np.int32)
    sims = np.full((b, ef), -np.inf, np.float32)
    done = np.ones((b, ef), bool)
    new = start
    while True:
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new = np.where(seen[rows, new], -1, new)
        seen[rows, new] = True
        seen[:, n] = False
        near = np.einsum("bkd,bd->bk", graph.vectors[new], queries)
        near[new < 0] = -np.inf
        ids, sims, done = np.concatenate([ids, new], 1), np.concatenate([sims, near], 1), np.concatenate([done, new < 0], 1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
        ids, sims, done = (np.take_along_axis(x, order, 1) for x in (ids, sims, done))
        todo = np.argsort(done, axis=1, kind="stable")[:, :width]
        fresh = ~np.take_along_axis(done, todo, 1)
        if not fresh.any():
            return ids, sims
        np.put_along_axis(done, todo, True, 1)
        at = np.where(fresh, np.take_along_axis(ids, todo, 1), -1)
        new = np.where((at >= 0)[:, :, None], links[at], -1).reshape(b, -1)


def _descend(graph: Graph, queries: np.ndarray) -> np.ndarray:
    """Where to start in the lowest level: from the top level's nodes down, keeping EF_UPPER of each level."""
    top = graph.levels[-1][0]
    start = np.broadcast_to(top, (len(queries), len(top)))
    for level in range(len(graph.levels) - 1, 0, -1):
        start = _beam(graph, level, queries, start, EF_UPPER)[0]
    return start


def search(graph: Graph, queries: np.ndarray, ef: int = EF) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest found in the lowest level, and their similarities, nearest first."""
    return _beam(graph, 0, queries, _descend(graph, queries), ef)


def _numbers(col: str) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not all zero."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(col).isNotNull() & (F.size(col) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(col, lambda x: x != 0)


def _length(col: str) -> Column:
    """The binary logarithm of a vector's length, by its largest component, so that no square overflows."""
    most = F.array_max(F.transform(col, lambda x: F.abs(x.cast("double"))))
    square = F.aggregate(col, F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / most, 2))
    return F.log2(most) + F.log2(square) / 2


def lifted(raw: np.ndarray) -> np.ndarray:
    """Rows in units of the longest one, with a last coordinate that makes all lengths equal, so that the largest inner product is also the least distance; in single precision."""
    most = np.abs(raw).max()
    unit = raw.astype(np.float64) / most
    square = np.einsum("ij,ij->i", unit, unit)
    rest = np.sqrt(np.maximum(square.max() - square, 0.0))
    return (np.concatenate([unit, rest[:, None]], 1) / np.sqrt(square.max())).astype(np.float32)


def nearest(data: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", ef: int = EF) -> DataFrame:
    """For each query (query_id, vector) its k nearest rows of ``data`` found: query_id, rank (int, from 1), vec_id and score (double), nearest first, ties to smaller ids.

    Nearness is the inner product in double precision. Rows whose vector is null, empty, zero or holds null or non-finite components take no part, nor do rows with
    null ids or of another length than most. A row with the query's own id is no candidate. Equal (id, vector) rows count once. Equal vectors are one node of the graph
    with its k + 1 smallest ids, of which no more can be among a query's k nearest; they are picked in two steps, so that one vector may be a third of all rows.
    Fewer candidates than k give fewer rows; an empty table gives none. Shards have about SHARD_ROWS nodes at most, every query searches every shard, and a
    shard's index is sent once, to the task that streams through its queries. A shard's vectors have lengths within a factor of 2 ** SPREAD, counted from the median
    length, and are lifted to their own longest: very long or short vectors elsewhere don't blur what tells them apart.
    """
    spark = data.sparkSession
    kind = np.float64 if dict(data.dtypes)[vector_col] == "array<double>" else np.float32
    rows = data.filter(_numbers(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.filter(_numbers("vector") & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").alias("v")).distinct()
    stats = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(_length("v"), 0.5).alias("middle")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not stats:
        return spark.createDataFrame([], schema)
    d, n, middle = stats[0]
    rows, asked = rows.filter(F.size("v") == d), asked.filter(F.size("v") == d)

    hashed = rows.withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.reverse("v"), F.lit(1)), "salt": F.pmod(F.xxhash64("id"), F.lit(256))}).dropDuplicates(["id", "a", "b"])
    few = lambda df, *keys: df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("r") <= k + 1).drop("r")
    nodes = few(few(hashed, "a", "b", "salt"), "a", "b").groupBy("a", "b").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
    # Exponents of doubles bound the number of ranges of lengths.
    nodes = nodes.withColumn("range", F.floor((_length("v") - middle + SPREAD / 2) / SPREAD).cast("int"))
    first, shards = {}, 0
    for at, count in sorted((r["range"], r["count"]) for r in rows.groupBy(F.floor((_length("v") - middle + SPREAD / 2) / SPREAD).cast("int").alias("range")).count().collect()):
        here = max(math.ceil(count / SHARD_ROWS), min(math.ceil(LEAST_SHARDS * count / n), math.ceil(count / 1024)))
        first[at], shards = (shards, here), shards + here
    part = lambda i: F.element_at(F.create_map(*[F.lit(x) for at, of in first.items() for x in (at, of[i])]), F.col("range"))
    nodes = nodes.withColumn("shard", (part(0) + F.pmod(F.col("a"), part(1))).cast("int")).drop("range")

    def indexed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["b", "a"])  # a random order, the same in every attempt
        raw = np.array(pdf["v"].tolist(), dtype=kind)
        graph = build(lifted(raw))
        ids = np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf["ids"]])
        sizes = [len(x) for _, x in graph.levels]
        flat = np.concatenate([x.ravel() for _, x in graph.levels])
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "vectors": [raw.tobytes()], "ids": [ids.tobytes()], "counts": [[len(x) for x in pdf["ids"]]], "sizes": [sizes], "links": [flat.tobytes()]})

    index = table(nodes.groupBy("shard").applyInPandas(indexed, "shard int, vectors binary, ids binary, counts array<int>, sizes array<int>, links binary"))
    stream = asked.select("query_id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("part"))
    stream = index.withColumn("part", F.lit(0)).unionByName(stream, allowMissingColumns=True)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = raw = ids = counts = ends = None
        for pdf in batches:
            for whole in (x for _, x in pdf.groupby(["shard", "part"])):
                if whole["part"].iloc[0] == 0:
                    row = whole.iloc[0]
                    raw = np.frombuffer(row["vectors"], dtype=kind).reshape(-1, d)
                    levels, at, flat = [], 0, np.frombuffer(row["links"], dtype=np.int32)
                    for size in row["sizes"]:
                        width = M0 if not levels else M
                        levels.append((np.arange(size, dtype=np.int32), flat[at : at + size * width].reshape(size, width)))
                        at += size * width
                    graph = Graph(lifted(raw), levels)
                    ids, counts = np.frombuffer(row["ids"], dtype=np.int64), np.asarray(row["counts"])
                    ends, shard = np.cumsum(counts), row["shard"]
                    continue
                if graph is None or whole["shard"].iloc[0] != shard:
                    continue  # a shard without nodes
                for begin in range(0, len(whole), BLOCK):
                    part = whole.iloc[begin : begin + BLOCK]
                    vectors = np.array(part["v"].tolist(), dtype=kind)
                    # A query's own length orders nothing.
                    unit = vectors.astype(np.float64) / np.abs(vectors).max(1, keepdims=True)
                    got, _ = search(graph, np.concatenate([unit, np.zeros((len(part), 1))], 1).astype(np.float32), max(ef, 2 * k))
                    out = []
                    for query, vector, at in zip(part["query_id"], vectors, got, strict=True):
                        at = at[at >= 0]
                        score = (raw[at].astype(np.float64) * vector.astype(np.float64)).sum(1)
                        best = np.argsort(-score, kind="stable")
                        # Nodes that tie with the last needed one stay: their ids decide.
                        at, score = at[best], score[best]
                        cut = score >= score[min(len(at) - 1, k)]
                        at, score = at[cut], score[cut]
                        member = np.concatenate([ids[ends[i] - counts[i] : ends[i]] for i in at])
                        score = np.repeat(score, counts[at])
                        other = member != query
                        member, score = member[other], score[other]
                        order = np.lexsort((member, -score))[:k]
                        out.append(pd.DataFrame({"query_id": np.int64(query), "vec_id": member[order], "score": score[order]}))
                    yield pd.concat(out)

    # A task holds one shard's index at a time, read once, and streams through the queries behind it.
    hits = stream.repartitionById(shards, "shard").sortWithinPartitions("shard", "part").mapInPandas(found, "query_id long, vec_id long, score double")
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return hits.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
