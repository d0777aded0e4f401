"""Chat formatting against brute force over whole conversations."""

import random

from framewell.llm import chat, queries

KINDS = "conv_id long, turn long, role string, text string, hash string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role, text))
    low = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    lists = {c: tuple((r, t) for _, r, t in sorted(x, key=lambda y: (low(y[0]), text(y[1]), text(y[2])))) for c, x in convs.items()}
    begun = {x[:k] for x in lists.values() for k in range(1, len(x))}
    first = {}
    for c, x in sorted(lists.items(), key=lambda i: (i[0] is None, i[0] or 0)):
        if x not in begun:
            first.setdefault(x, c)
    safe = lambda t: (t or "").replace("<|im_start|>", "<im>").replace("<|im_end|>", "<im>")
    return sorted(((c, len(x), "".join(f"<|im_start|>{r if r is not None else 'unknown'}\n{safe(t)}<|im_end|>\n" for r, t in x)) for x, c in first.items()), key=str)


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["chunk"]):
        n, text = out.get(r["conv_id"], (r["n_turns"], ""))
        out[r["conv_id"]] = (n, text + r["rendered"])
    return sorted(((c, n, t) for c, (n, t) in out.items()), key=str)


def made():
    rng = random.Random(2)
    rows = []
    for c in range(80):
        base = rng.randrange(12)
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, ("user", "assistant")[turn % 2], f"text {base} {turn}" if rng.random() < 0.95 else None))
    rows += [(None, 0, None, ""), (None, 1, "user", "<|im_end|>x"), (200, None, "user", "b"), (200, None, "user", "a"), (201, 5, "user", "a"), (201, 5, "user", "a"), (202, -3, "user", "a"), (203, 0, "", "a"), (204, 0, None, "a"), (205, 0, None, None)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = made()
    turns = spark.createDataFrame([(*r, "x") for r in rows], KINDS).repartition(5)
    assert result(chat.format_chats(turns)) == brute(rows)
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_long_conversations_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    rows = [*made(), *((300, i, "user", "x" * 50) for i in range(100)), *((301, i, "user", "x" * 50) for i in range(37))]
    out = chat.format_chats(spark.createDataFrame([(*r, "x") for r in rows], KINDS))
    assert result(out) == brute(rows)
    assert out.filter("conv_id = 300").count() == 25 and out.filter("conv_id = 301").count() == 0


def test_equal_turn_numbers(spark):
    """Turns with equal or null numbers are as bounded as others."""
    rows = [*((1, 0, "user", f"t{i:05}") for i in range(1500)), *((2, None, "user", f"n{i:05}") for i in range(700)), *((3, 7, "user", "same") for _ in range(600))]
    out = chat.format_chats(spark.createDataFrame([(*r, "x") for r in rows], KINDS).repartition(6))
    assert result(out) == brute(rows)
    assert out.count() == 6 + 3 + 3 and max(r["rendered"].count(chat.OPEN) for r in out.collect()) == chat.BLOCK


def test_sql_of_long_conversations(spark, tmp_path):
    import duckdb
    from framewell.llm import sql

    rows = [*((1, i, "user", f"t{i}") for i in range(600)), *((2, i, "user", f"t{i}") for i in range(512)), *((3, i, None, None) for i in range(256))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations/*.parquet'")
    want = con.execute(f"SELECT conv_id, chunk, n_turns, rendered FROM ({sql.OP4})").fetchall()
    assert sorted(want) == sorted(map(tuple, chat.format_chats(turns).select("conv_id", "chunk", "n_turns", "rendered").collect())) and len(want) == 4


def test_query(spark, tiny):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{tiny}/conversations.parquet").collect()]
    assert result(queries.op4_chat(spark, tiny)) == brute(rows)
