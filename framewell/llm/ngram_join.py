"""Similarity join of documents by the Jaccard similarity of their word shingles, and its connected components.

Each document publishes a prefix of its shingles in order of their frequency over the corpus. A prefix of the least length shares one shingle with that of every similar
document; one that is longer by m - 1 shares m. Every document picks the m whose estimated candidates cost least, and a pair becomes a candidate when it shares as many
prefix shingles as the smaller m of the two. Candidates are gathered in groups, whose texts' shingle sets are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shingles import batch_shingles, batch_words, mix, runs
from ._spark import table

#: Counters of the frequency sketch and of the filter of candidates: both are of a fixed size, whatever the corpus, and only save work.
SKETCH, FILTER_BITS = 1 << 20, 1 << 23
#: The largest m, and what comparing a candidate costs against reading one entry of a posting list.
MOST_MATCHES, VERIFY_COST = 4, 50.0
#: A shingle in more prefixes than this ties its documents into one group instead of giving pairs.
HOT = 64
#: Documents in a block of a group; a task compares two blocks.
BLOCK = 512
#: Sets that a task remembers in order to send the prefix of equal ones once.
REMEMBERED = 200_000
#: Ids from here on stand for classes of which no row has an id.
NAMELESS = 1 << 62


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How often shingles occur in the whole corpus, by SKETCH hashed counters."""
    parts = 256
    width = SKETCH // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for _, hashes, begin in batch_words(batch.column(0)):
                keep = np.ones(max(len(hashes) - n + 1, 0), dtype=bool)
                for k in range(1, n):  # no run goes on into the next text
                    at = begin[1:-1] - k
                    keep[at[(at >= 0) & (at < len(keep))]] = False
                seen += np.bincount((runs(hashes, n)[keep] & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        rows = [np.minimum(p, 0xFFFFFFFF).astype(np.uint32).tobytes() for p in seen.reshape(parts, width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(rows, pa.binary())], names=["part", "counts"])

    def add(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in groups:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = np.frombuffer(counts, dtype=np.uint32 if len(counts) == 4 * width else np.int64)
                sums[part] = sums.get(part, np.zeros(width, np.int64)) + now
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"])

    # A task streams through the arrays of its parts and holds one sum for each; all of them are SKETCH counters, whatever the corpus.
    schema = "part int, counts binary"
    sums = docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema)
    out = np.zeros((parts, width), dtype=np.int64)
    for r in sums.toLocalIterator():
        out[r["part"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return out.ravel()


def prefix(shingles: np.ndarray, counts: np.ndarray, mean: float, percent: int) -> tuple[np.ndarray, int]:
    """A document's published shingles and its m; ``mean`` is that of the counters, most of which is other shingles' noise."""
    size = len(shingles)
    seen = counts[(shingles & np.uint64(SKETCH - 1)).astype(np.int64)]
    least = size - -(-percent * size // 100) + 1
    most = min(MOST_MATCHES, size - least + 1)
    order = np.lexsort((shingles, seen))[: least + most - 1]
    cost = np.cumsum(np.maximum(seen[order] - mean, 1.0))[least - 1 :]
    # At most a share 1/m of the entries read are documents that share m shingles.
    m = 1 + int(np.argmin(cost * (1.0 + VERIFY_COST / np.arange(1, most + 1) ** 2)))
    return shingles[order[: least + m - 1]], m


def _key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    a, b = mix(shingles), mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    with np.errstate(over="ignore"):
        return mix(np.array([a.sum(dtype=np.uint64) + np.uint64(len(shingles)), b.sum(dtype=np.uint64) ^ np.uint64(len(shingles))], dtype=np.uint64)).tobytes()


def _number(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _scan(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """doc_id, key and size of every row's set, its number for candidates, m and prefix; the prefix is null where a task has sent that of an equal set before."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        mean = shared.value.mean()
        for batch in batches:
            keys, sizes, numbers, ms, prefixes = [], [], [], [], []
            for s in batch_shingles(batch.column(1), n):
                key = _key(s) if len(s) else None
                keys.append(key)
                sizes.append(len(s))
                numbers.append(_number(key) if key else None)
                new = key is not None and key not in sent
                p, m = prefix(s, shared.value, mean, percent) if new else (None, None)
                if new:
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(key)
                ms.append(m)
                prefixes.append(p)
            lengths = [0 if p is None else len(p) for p in prefixes]
            flat = np.concatenate([p for p in prefixes if p is not None] or [np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(np.cumsum([0, *lengths], dtype=np.int32), flat)
            columns = [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64()), pa.array(ms, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "key", "size", "number", "m", "prefix"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, key binary, size long, number long, m int, prefix array<long>")


def _candidates(scanned: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between numbers of sets that may be similar; whatever is similar is connected by them."""
    posted = scanned.filter(F.col("m").isNotNull()).select(F.explode("prefix").alias("shingle"), "number")
    # A shingle that only one set publishes is left out. Its lowest and highest set are partial sums, so that a common one is never gathered.
    ends = posted.groupBy("shingle").agg(F.min("number").alias("low"), F.max("number").alias("high")).filter("low < high").select("shingle")
    posted = table(posted.join(ends, "shingle").distinct())
    facts = scanned.filter(F.col("m").isNotNull()).groupBy("number").agg(F.min("size").alias("size"), F.max("size").alias("most"), F.min("m").alias("m"))
    lists = posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("low"))
    posted = posted.join(lists, "shingle")
    hot = posted.filter(F.col("n") > HOT).select(F.col("low").alias("a"), F.col("number").alias("b")).distinct()
    few = posted.filter(F.col("n") <= HOT).select("shingle", "number").join(facts, "number")
    left = few.select("shingle", F.col("number").alias("a"), F.col("size").alias("size_a"), F.col("most").alias("most_a"), F.col("m").alias("m_a"))
    right = few.select("shingle", F.col("number").alias("b"), F.col("size").alias("size_b"), F.col("most").alias("most_b"), F.col("m").alias("m_b"))
    close = (percent * F.col("size_a") <= 100 * F.col("most_b")) & (percent * F.col("size_b") <= 100 * F.col("most_a"))
    pairs = left.join(right, "shingle").filter((F.col("a") < F.col("b")) & close)
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first(F.least("m_a", "m_b")).alias("m")).filter("n >= m")
    return pairs.select("a", "b").union(hot)


def _filter(numbers: DataFrame) -> np.ndarray:
    """A bit for each hashed number, FILTER_BITS in all."""
    words = numbers.select(F.pmod(F.col("number"), F.lit(FILTER_BITS)).alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))
    packed = words.groupBy((F.col("at") / 512).cast("int").alias("part")).agg(F.collect_list("at").alias("at"), F.collect_list("bits").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in packed.toLocalIterator():
        out[r["at"]] = r["bits"]
    return out


def _sets(docs: DataFrame, n: int, wanted: np.ndarray) -> DataFrame:
    """key and set of the rows whose number passes the filter; a task sends equal ones once."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = shared.value, set()
        for batch in batches:
            out = []
            for s in batch_shingles(batch.column(0), n):
                if len(s):
                    key = _key(s)
                    number = _number(key)
                    bit = number % FILTER_BITS
                    if key not in sent and int(bits[bit // 64]) >> (bit % 64) & 1:
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent.add(key)
                        out.append((key, s.tobytes()))
            keys, sets = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "shingles"])

    return docs.select("text").mapInArrow(run, "key binary, shingles binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of ``left`` shares with each of ``right``: products of 0/1 matrices over the shingles that both sides have."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    common = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    placed = []
    for values, rows in sides:
        at = np.searchsorted(common, values)
        at[at == len(common)] = 0
        ok = common[at] == values if len(common) else np.zeros(len(values), bool)
        placed.append((at[ok], rows[ok]))
    for begin in range(0, len(common), 4096):
        dense = []
        for (at, rows), sets in zip(placed, (left, right), strict=True):
            here = (at >= begin) & (at < begin + 4096)
            m = np.zeros((len(sets), min(4096, len(common) - begin)), dtype=np.float32)
            m[rows[here], at[here] - begin] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all similar sets of each group; sets have node, grp, blocks and shingles. A task compares two blocks and sends a spanning forest."""
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks"))
    placed = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "shingles")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        sides = [pdf[pdf["block"] == x] for x in (i, j)]
        sets = [[np.frombuffer(s, dtype=np.uint64) for s in x["shingles"]] for x in sides]
        nodes = [x["node"].to_numpy() for x in sides]
        if not len(nodes[0]) or not len(nodes[1]):
            return pd.DataFrame({"a": [], "b": []})
        shared = overlaps(*sets)
        sizes = [np.array([len(s) for s in x]) for x in sets]
        hit = 100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        out = []
        for a, b in zip(*np.nonzero(hit), strict=True):
            x, y = int(nodes[0][a]), int(nodes[1][b])
            if (p := find(x)) != (q := find(y)):
                root[max(p, q)] = min(p, q)
                out.append((x, y))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return placed.groupBy("grp", "i", "j").applyInPandas(compare, "a long, b long")


def _components(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_hash, size, and component of every row of ``rows`` (doc_id, text); component is a node, NAMELESS or more where no row has an id, and null without a set."""
    scanned = table(_scan(rows, words, percent, sketch(rows, words)))
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64("key"), F.lit(NAMELESS - 1))
    classes = scanned.filter(F.col("key").isNotNull()).groupBy("key").agg(F.coalesce(F.min("doc_id"), F.min(nameless)).alias("node"), F.min("number").alias("number"))
    groups = table(components(_candidates(scanned, percent)).select(F.col("node").alias("number"), F.col("component").alias("grp")))
    sizes = groups.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = classes.join(groups.join(sizes, "grp"), "number").select("key", "node", "grp", "blocks")
    sets = _sets(rows, words, _filter(groups)).join(members, "key").dropDuplicates(["key"])
    links = table(_links(sets.select("grp", "blocks", "node", "shingles"), percent))
    named = classes.join(components(links), "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    return scanned.select("doc_id", "text_hash", "size", "key").join(named, "key", "left")


def similarity_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """For every row of ``docs``: doc_id, n_shingles (long) and component_id (long), the smallest doc_id reachable by links, the row's own included.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A document's set holds its distinct runs of ``words`` words; with fewer words, the whole sequence.
    Two documents link when their sets' intersection is at least ``percent`` per cent of the union. Null texts and texts without words have no set, link with nothing and are
    their own component. Equal sets are one class, compared once. Rows that share a doc_id are one node. A row with a null doc_id takes its component's smallest id, or null.
    No part of a group is dropped: shingles in very many prefixes tie their documents into groups, which are compared in blocks of BLOCK by BLOCK.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _components(rows, words, percent)
    component = F.when(F.col("component").isNull(), F.col("doc_id")).when(F.col("component") < NAMELESS, F.col("component"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less near copies: of each component of similarity_components the row with the smallest id stays, one row of it if it is repeated.

    Rows without words are no copies and stay, as do null and empty texts. A component in which no row has an id keeps one row. Columns may have any names; very long texts
    are taken whole.
    """
    some = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.filter(some).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))).alias("first")
    kept = _components(rows, words, percent).groupBy("component").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"))
    hashed = docs.filter(some).select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own"), F.xxhash64(F.col(text_col).cast("string")).alias("own_hash"))
    chosen = hashed.join(kept, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")), "left_semi")
    # Of rows that are equal in id and text one stays, found by a partial aggregate.
    chosen = chosen.groupBy("own", "own_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return chosen.select("row.*").unionByName(docs.filter(~some))
