"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

#: CRC-32 of a text, four bits at a time; the table holds the sixteen remainders of the reflected polynomial 0xEDB88320.
_TABLE = [0] * 16
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _TABLE[_i] = _c
OP1 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         octet_length(encode(coalesce(text, ''))) + 8 AS size,
         coalesce('s' || source, 'n') AS src
  FROM documents
), e AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 2 * (size - 8)),
           lambda i: ('0x' || substr(hex(encode(t)), (i // 2 * 2 + 2 - i % 2)::INT, 1))::BIGINT)),
         lambda a, x: xor(a >> 4, {_TABLE}[xor(a & 15, x) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d
), r AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5('17:' || coalesce(doc_id::VARCHAR, ':' || text_crc32 || ':' || size)), doc_id, text_crc32, size) AS rk,
         count(*) OVER (PARTITION BY src) AS total,
         ('0x' || substr(md5('17:' || src), 1, 3))::BIGINT + 1 AS phase
  FROM e
), g AS (
  SELECT *, row_number() OVER (ORDER BY (4096 * rk - phase)::DOUBLE / (4096 * total)::DOUBLE, src, rk) - 1 AS pos,
         count(*) OVER () AS n
  FROM r
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (pos * 24 // n)::INTEGER AS shard,
       (pos - ((pos * 24 // n) * n + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source
FROM g
"""

OP4 = """
WITH c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS l FROM conversations GROUP BY conv_id
), p AS (
  SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)
), m AS (
  SELECT min(conv_id) AS conv_id, l FROM c WHERE l NOT IN (SELECT l FROM p) GROUP BY l
), k AS (
  SELECT conv_id, l, unnest(range(0, (len(l) + 255) // 256)) AS chunk FROM m
)
SELECT conv_id, chunk::INTEGER AS chunk, len(l)::BIGINT AS n_turns,
       array_to_string(list_transform(l[chunk * 256 + 1:chunk * 256 + 256], lambda x: '<|im_start|>' || coalesce(x.role, 'unknown') || chr(10) ||
         replace(replace(coalesce(x.text, ''), '<|im_start|>', '<im>'), '<|im_end|>', '<im>') || '<|im_end|>' || chr(10)), '') AS rendered
FROM k
"""


def _sized(value: str) -> str:
    return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"


def _climb(name: str, source: str) -> str:
    """The levels of the trees of ``source`` (tree, nodes): ``name`` (tree, level, nodes), up to a lone node."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, nodes FROM {source}
  UNION ALL
  SELECT tree, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM {name} WHERE len(nodes) > 1
)"""


def _walk(name: str, start: str, levels: str) -> str:
    """The ways of ``start`` (rid, tree, i, cur, proof) to the roots of ``levels``: ``name``, with level."""
    return f"""{name} AS (
  SELECT rid, tree, 0 AS level, i, cur, proof FROM {start}
  UNION ALL
  SELECT rid, w.tree, w.level + 1, w.i // 2, sha256(CASE WHEN w.i % 2 = 1 THEN v.nodes[w.i] || cur ELSE cur || coalesce(v.nodes[w.i + 2], '') END),
         proof || CASE WHEN w.i % 2 = 1 THEN v.nodes[w.i] ELSE coalesce(v.nodes[w.i + 2], '') END
  FROM {name} w JOIN {levels} v ON v.tree = w.tree AND v.level = w.level WHERE len(v.nodes) > 1
)"""


OP13 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || lang, 'n') AS tree, doc_id::VARCHAR AS id, n_chars,
         {_sized('doc_id::VARCHAR')} || {_sized('source')} || {_sized('lang')} AS head, {_sized('text')} AS tail
  FROM documents
), e AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 2 * octet_length(encode(id))),
           lambda i: ('0x' || substr(hex(encode(id)), (i // 2 * 2 + 2 - i % 2)::INT, 1))::BIGINT)),
         lambda a, x: xor(a >> 4, {_TABLE}[xor(a & 15, x) + 1])), 4294967295::BIGINT) AS crc
  FROM d
), f AS (
  SELECT rid, doc_id, tree, sha256(head || {_sized('n_chars::VARCHAR')} || tail) AS leaf,
         sha256(head || {_sized('(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR')} || tail) AS shown
  FROM e
), p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM f
), g AS (SELECT tree, list(leaf ORDER BY i) AS nodes FROM p GROUP BY tree
), {_climb('gl', 'g')},
s AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i FROM gl WHERE len(nodes) = 1
), t AS (SELECT '' AS tree, list(subroot ORDER BY i) AS nodes FROM s
), {_climb('tl', 't')},
a AS (SELECT rid, tree, i, shown AS cur, '' AS proof FROM p), {_walk('gw', 'a', 'gl')},
b AS (SELECT rid, '' AS tree, s.i, cur, proof FROM (SELECT * FROM gw QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level DESC) = 1) w JOIN s USING (tree)), {_walk('tw', 'b', 'tl')},
z AS (SELECT * FROM tw QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level DESC) = 1)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(z.proof) AS proof_sha256, z.cur AS folded_root, z.cur = r.root AS verified
FROM p JOIN s USING (tree) JOIN z USING (rid) CROSS JOIN (SELECT nodes[1] AS root FROM tl WHERE len(nodes) = 1) r
"""

ORACLE_SQL: dict[str, str] = {"op1_sharding": OP1, "op4_chat": OP4, "op13_merkle": OP13}
