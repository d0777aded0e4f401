"""Secrets: patterns propose spans, and how many owners share a value over the whole corpus tells examples from live-looking credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import content_key, let, matches, spans_text, spare, table

#: Kinds in the order that breaks ties of the start. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "token", "jwt", "pem")
_KEY = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_SIGN = r"[\"']?\x20*[:=]\x20*[\"']?"
_VALUE = "[A-Za-z0-9+/_.=-]"
# hex and access ask for their length at once: greedy runs that are too short hold no match that is long enough.
PATTERNS = {
    "assign": _KEY + _SIGN + _VALUE + "++",
    "access": "AKIA[A-Z0-9]{16,}+",
    "hex": "(?<![0-9a-f])[0-9a-f]{24,}+",
    "token": r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+)",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "pem": r"-----BEGIN\x20(?:[A-Z]++\x20){0,3}PRIVATE\x20KEY-----",
}
#: A cheap test that holds wherever the pattern can match.
_GUARDS = {
    "assign": lambda t: (F.instr(t, ":") > 0) | (F.instr(t, "=") > 0),
    "access": lambda t: F.instr(t, "AKIA") > 0,
    "hex": lambda t: F.lit(True),
    "token": lambda t: (F.instr(t, "_") > 0) | (F.instr(t, "xox") > 0),
    "jwt": lambda t: F.instr(t, "eyJ") > 0,
    "pem": lambda t: F.instr(t, "-----BEGIN ") > 0,
}
#: A value is an example once this many owners hold it, or this many repositories of SEVERAL owners. Whatever a single owner holds is live-looking, however often it occurs.
MIN_OWNERS, MIN_REPOSITORIES, SEVERAL = 3, 10, 2
#: Copies of each widely held value, so that its rows meet in as many tasks.
SALTS = 64
#: What redact puts in place of a live-looking credential.
MASK = "[SECRET]"


def candidates(text: Column) -> Column:
    """All spans of a text as an array of (start, rank, end, kind, value), by start and then kind; value is the credential alone."""

    def of(rank: int, kind: str) -> Column:
        value = lambda m: F.regexp_extract(m["value"], _KEY + _SIGN + f"({_VALUE}+)$", 1) if kind == "assign" else m["value"]
        found = F.transform(matches(text, PATTERNS[kind], _GUARDS[kind](text)), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), value(m).alias("value")))
        return F.filter(found, lambda s: F.length(s["value"]) >= 6) if kind == "assign" else found

    return F.array_sort(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)]))


def ownership(found: DataFrame, *, owner_col: str, repo_col: str) -> DataFrame:
    """For each value's hash, by how many distinct owners and repositories it is held: ``found`` has owner, repository and ``hashes``.

    Counts go from (value, owner, repository) to (value, owner) to value, each with partial sums before its shuffle, so that a value in a third of all rows stays spread out.
    """
    each = found.select(F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), F.explode("hashes").alias("hash"))
    by_owner = each.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def scan_secrets(docs: DataFrame, *, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", keep: tuple[str, ...] = (), min_owners: int = MIN_OWNERS, min_repositories: int = MIN_REPOSITORIES) -> DataFrame:
    """One row for every row of ``docs``: ``keep``'s columns, key, and ``secrets``, an array of (start, rank, end, kind, value, example).

    key is content_key of repository, owner and text, for joining back: rows with equal keys get equal spans. example is true for values that ``min_owners``
    distinct owners, or SEVERAL of them in ``min_repositories`` distinct repositories, hold anywhere in the corpus, and false for owner-specific, live-looking ones.
    The base kinds are leftmost non-overlapping matches that pass their length checks; they are in ``secrets`` whatever example says.
    A null or empty text has no spans; null owners are one owner, null repositories one repository. Repeated rows count once as holders. Where ``keep`` has a column of
    the name key or secrets, the new one gets an underscore before it. Very long texts are taken whole; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept")
    rows = docs.select(kept, F.col(owner_col).alias("_owner"), F.col(repo_col).alias("_repo"), content_key(F.col(repo_col), F.col(owner_col), F.col(text_col)).alias("key"), candidates(text).alias("found"))
    # The scan is the costly part; its result is narrow, so it is written once and read three times.
    rows = table(rows.withColumn("hashes", F.array_distinct(F.transform("found", lambda s: F.xxhash64(s["value"])))))
    several = (F.col("owners") >= SEVERAL) & (F.col("repos") >= min_repositories)
    shared = ownership(rows.filter(F.size("hashes") > 0), owner_col="_owner", repo_col="_repo").filter((F.col("owners") >= min_owners) | several)
    shared = shared.select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("example"))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    some = rows.filter(F.size("hashes") > 0).select("key", F.explode("hashes").alias("hash"), salt.alias("salt")).distinct()
    examples = some.join(shared, ["hash", "salt"]).groupBy("key").agg(F.collect_set("hash").alias("examples"))

    def judged(s: Column) -> Column:
        return s.withField("example", F.coalesce(F.array_contains(F.col("examples"), F.xxhash64(s["value"])), F.lit(False)))

    out = rows.join(examples, "key", "left")
    key, secrets = spare(list(keep), "key"), spare(list(keep), "secrets")
    return out.select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)], F.col("key").alias(key), F.transform("found", judged).alias(secrets))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of what scan_secrets found, with doc_id kept."""
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["rank"] < 3)
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: ~s["example"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: s["example"])).cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, *, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mask: str = MASK) -> DataFrame:
    """``docs`` with every live-looking credential replaced by ``mask``; examples that many owners share stay. All rows and columns are kept.

    Overlapping spans become one mask. Rows without such a span, and null texts, are unchanged. Columns may have any names.
    """
    found = scan_secrets(docs, text_col=text_col, owner_col=owner_col, repo_col=repo_col)
    key, spans = spare(docs.columns, "key"), spare(docs.columns, "live")
    live = found.select(F.col("key").alias(key), F.filter("secrets", lambda s: ~s["example"]).alias(spans)).filter(F.size(spans) > 0)
    live = live.groupBy(key).agg(F.first(spans).alias(spans))
    text = F.col(text_col)

    def masked(spans: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

        def step(a: Column, s: Column) -> Column:
            gap = F.substr(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
            out = F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(gap, F.lit(mask))))
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

        return let(F.aggregate(spans, start, step), lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, (a["at"] + 1).cast("int"))))

    rows = docs.withColumn(key, content_key(F.col(repo_col), F.col(owner_col), text))
    out = rows.join(live, key, "left")
    return out.withColumn(text_col, F.when(F.col(spans).isNotNull(), masked(F.col(spans))).otherwise(text)).select(*docs.columns)
