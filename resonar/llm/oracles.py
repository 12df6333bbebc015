"""SQL of what the operators' base columns must be, and of whole results where SQL can say them."""

from __future__ import annotations

from .embedding_dedup import COSINE
from .near_dedup import PERCENT, WIDTH
from .secrets import LEAST_ACCESS, LEAST_ASSIGN
from .sharding import SHARDS

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _components(nodes: str, links: str) -> str:
    """CTEs reach and least(node, component): the smallest node that links lead to. nodes(node), links(a, b)."""
    return (
        f"reach AS (SELECT node, node AS r FROM {nodes} UNION SELECT l.a, reach.r FROM reach JOIN (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}) l ON l.b = reach.node), "
        "least AS (SELECT node, min(r) AS component FROM reach GROUP BY node)"
    )


def _crc_table() -> str:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(str(n))
    return "[" + ", ".join(out) + "]::BIGINT[]"


def crc32(text: str) -> str:
    """crc32 of ASCII text."""
    step = f"xor(c >> 8, ({_crc_table()})[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}), 4294967295::BIGINT)"


NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, unnest(CASE WHEN len(words) >= {WIDTH} THEN list_transform(range(1, len(words) - {WIDTH - 2}), lambda i: array_to_string(words[i:i + {WIDTH - 1}], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)),
nodes AS (SELECT doc_id AS node FROM documents),
{_components("nodes", "links")}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, d.doc_id = component AS kept, d.doc_id = component AS first
FROM documents d LEFT JOIN n USING (doc_id) JOIN least ON least.node = d.doc_id
"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= {COSINE}),
nodes AS (SELECT vec_id AS node FROM embeddings),
{_components("nodes", "links")},
many AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM links UNION ALL SELECT b FROM links) GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, component AS component_id, vec_id = component AS kept
FROM embeddings LEFT JOIN many ON many.node = vec_id JOIN least ON least.node = vec_id
"""

LM_BASE = f"""
WITH d AS (SELECT doc_id, {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 2 AS held_out, list_append({_WORDS}, chr(10)) AS tokens FROM documents),
t AS (SELECT doc_id, held_out, unnest(tokens) AS tok FROM d),
c AS (SELECT tok, count(*) AS n FROM t WHERE NOT held_out GROUP BY tok),
total AS (SELECT sum(n) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.n) AS n_known, CAST(any_value(total.n) AS BIGINT) AS train_tokens,
       round(sum(log10((coalesce(c.n, 0) + 1) / (total.n + total.v + 1))), 4) AS base_score
FROM t LEFT JOIN c USING (tok) CROSS JOIN total GROUP BY doc_id, held_out
"""

SECRET_COUNTS = f"""
SELECT doc_id,
       len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= {LEAST_ASSIGN})) AS n_assign,
       len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= {LEAST_ACCESS})) AS n_access,
       len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
FROM documents
"""

SHARD_ROWS = f"""
WITH n AS (SELECT count(*) AS n FROM documents)
SELECT CAST(s AS INTEGER) AS shard, n // {SHARDS} + CASE WHEN s < n % {SHARDS} THEN 1 ELSE 0 END AS n_rows, n // {SHARDS} + CASE WHEN s < n % {SHARDS} THEN 1 ELSE 0 END AS n_slots
FROM n, range({SHARDS}) t(s) WHERE n // {SHARDS} + CASE WHEN s < n % {SHARDS} THEN 1 ELSE 0 END > 0
"""

SHARD_SIZES = "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, 'rows' AS law FROM documents"
HELD_OUT = f"SELECT doc_id, {crc32('CAST(doc_id AS VARCHAR)')} % 3 = 1 AS held_out FROM documents"
