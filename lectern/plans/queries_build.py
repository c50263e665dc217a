"""Registered queries: chunking, corpus building, table clean-up; semantic joins by key."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import build
from ..operators import simjoin
from ..session import spread
from ..sources import documents
from .queries_bookkeeping import SEMANTIC
from .queries_retrieval import WALK, rounded, walk
from .registry import query


# Line chunks step by step: w[i + 1] words stand before line i; a chunk is lines a to e.
_K = "(len(list_filter(w, lambda x: x <= w[a + 1] + 300)) - 1)"
_E = f"least(greatest(CASE WHEN w[{_K} + 1] = w[a + 1] THEN {_K} + 1 ELSE {_K} END, a + 1), len(rows))"
LINES = f"""d0 AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS rows FROM documents WHERE {{where}}),
d1 AS (SELECT *, list_transform(rows, lambda r: len(regexp_extract_all(r, '\\S+'))) AS n FROM d0),
d AS (SELECT *, list_transform(range(0, len(rows) + 1), lambda i: coalesce(list_sum(n[1:i]), 0)::BIGINT) AS w FROM d1),
s AS (SELECT doc_id, a, {_E} AS e FROM (SELECT *, 0::BIGINT AS a FROM d WHERE w[-1] > 300)
  UNION ALL SELECT doc_id, a, {_E} AS e FROM (SELECT d.*, greatest(s.a + 1, least(len(list_filter(w, lambda x: x <= w[s.e + 1] - 50)) - 1, s.e)) AS a
    FROM s JOIN d USING (doc_id) WHERE s.e < len(rows))),
c AS (SELECT doc_id, source, a, regexp_replace(array_to_string(rows[a + 1:e], chr(10)), '^\\s+|\\s+$', '', 'g') AS text FROM s JOIN d USING (doc_id)),
parts AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS part, text FROM c WHERE text <> ''
  UNION ALL SELECT doc_id, source, 0, text FROM d WHERE w[-1] <= 300)"""


@query("b1_chunk_lines", f"WITH RECURSIVE {LINES.format(where='true')} SELECT * FROM parts")
def _(t):
    return build.chunk_documents(spread(t.documents.select("doc_id", "source", "text")), 300, 50)


@query("b2_split_by_chars", """
WITH RECURSIVE s AS (SELECT doc_id, text AS whole, 0::BIGINT AS n, NULL::VARCHAR AS piece, text AS rest FROM documents
  UNION ALL SELECT doc_id, whole, n + 1, left(rest, o), regexp_replace(substr(rest, o + 1), '^\\s+', '') FROM (
    SELECT *, CASE WHEN o0 <= 3000 THEN 6000 ELSE o0 END AS o FROM (
      SELECT *, 6000 - length(regexp_extract(left(rest, 6001), '\\S*$')) AS o0 FROM s WHERE length(rest) > 6000))),
p AS (SELECT doc_id, whole, n, piece FROM s WHERE n > 0 UNION ALL SELECT doc_id, whole, n + 1, rest FROM s WHERE length(rest) <= 6000),
q AS (SELECT doc_id, n, CASE WHEN length(whole) <= 6000 THEN whole ELSE regexp_replace(piece, '^\\s+|\\s+$', '', 'g') END AS text, length(whole) <= 6000 AS small FROM p)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS part, text FROM q WHERE text <> '' OR small""")
def _(t):
    return build.chunk_documents(t.documents.select("doc_id", "text"), 10**9, 0, limit=6000)


@query("b3_passage_break_split", """
WITH p AS (SELECT conv_id, turn, unnest([text, role]) AS tx, unnest([0, 1]) AS part FROM conversations)
SELECT conv_id, turn, part, regexp_replace(tx, '^\\s+|\\s+$', '', 'g') AS text FROM p WHERE regexp_replace(tx, '\\s', '', 'g') <> ''""")
def _(t):
    joined = F.concat("text", F.lit(documents.PASSAGE_BREAK), "role")
    return documents.split_passages(t.conversations.select("conv_id", "turn", joined.alias("text")))


@query("b4_build_corpus", """
WITH w AS (SELECT source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS idx,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE trim(text) <> '')
SELECT idx, source || ' (part ' || k || '/' || n || ')' AS label, lag(idx) OVER (PARTITION BY source ORDER BY idx) AS prev_idx,
  lead(idx) OVER (PARTITION BY source ORDER BY idx) AS next_idx FROM w""")
def _(t):
    built = build.build_corpus(t.documents.select("doc_id", "source", "text"), "doc_id", 10**9, 0)
    return built["passages"].select("idx", "label", "prev_idx", "next_idx")


@query("b4b_build_corpus_chunked", f"""WITH RECURSIVE {LINES.format(where="trim(text) <> ''")},
i AS (SELECT source, row_number() OVER (ORDER BY doc_id, part) - 1 AS idx FROM parts)
SELECT source, count(*) AS chunks, min(idx) AS first_idx FROM i GROUP BY 1""")
def _(t):
    built = build.build_corpus(t.documents.select("doc_id", "source", "text"), "doc_id", 300, 50)
    return built["files"].select("source", "chunks", "first_idx")


NUMERIC = """trim(val) <> '' AND length(trim(val)) <= 24 AND length(regexp_replace(trim(val), '[^0-9]', '', 'g')) > 0
  AND length(regexp_replace(trim(val), '[^0-9]', '', 'g')) / greatest(length(trim(val)), 1)::DOUBLE >= 0.5"""
query("b5_table_classify_rows", f"""
WITH r AS (SELECT table_id, row, count_if(val <> '') AS f, count_if({NUMERIC}) AS n FROM cells GROUP BY 1, 2),
h AS (SELECT table_id, min(row) AS hr FROM r WHERE n = 0 AND f >= 4 GROUP BY 1)
SELECT r.table_id, r.row, CASE WHEN r.row = hr THEN 'header' WHEN n >= 2 THEN 'data' ELSE 'prose' END AS kind FROM r LEFT JOIN h ON r.table_id = h.table_id WHERE f > 0""")(
    lambda t: build.classify_rows(t.cells))
query("b6_drop_empty_columns", """
WITH u AS (SELECT DISTINCT table_id, col FROM cells WHERE trim(val) <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY col) - 1 AS nc FROM u)
SELECT c.table_id, c.row, nc::INT AS col, val FROM cells c JOIN n ON n.table_id = c.table_id AND n.col = c.col""")(
    lambda t: build.drop_empty_columns(t.cells))


@query("b6b_merge_disjoint_columns", """
WITH f AS (SELECT table_id, row, col, val FROM cells),
k AS (SELECT table_id, bool_or(v3 <> '' AND v4 <> '') AS c34, bool_or(v4 <> '' AND v5 <> '') AS c45 FROM (SELECT table_id, row, max(CASE WHEN col = 3 THEN val END) AS v3,
  max(CASE WHEN col = 4 THEN val END) AS v4, max(CASE WHEN col = 5 THEN val END) AS v5 FROM f GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT f.table_id, row, val, CASE col WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 3 END AS col FROM f JOIN k ON f.table_id = k.table_id)
SELECT table_id, row, col, max(val) AS val FROM m GROUP BY 1, 2, 3""")
def _(t):
    return build.merge_disjoint_columns(t.cells)


# joins also known under their own names
query("j11_nearest_neighbour_join", WALK)(walk)


@query("j10_similarity_theta_join", """
WITH l AS (SELECT v, min(idx) AS rep FROM old_vec GROUP BY v), r AS (SELECT v, min(idx) AS rep FROM new_vec GROUP BY v)
SELECT l.rep AS left_rep, r.rep AS right_rep, round(list_cosine_similarity(l.v, r.v), 6) AS similarity FROM l JOIN r ON list_cosine_similarity(l.v, r.v) > 0.35""")
def _(t):
    return rounded(simjoin.similar_pairs(simjoin.vector_groups(t.old_vec), simjoin.vector_groups(t.new_vec), 0.35), "similarity")


@query("j13_snapshot_semantic_match", f"WITH {SEMANTIC} SELECT new_idx, old_idx FROM sx WHERE new_idx IS NOT NULL AND old_idx IS NOT NULL")
def _(t):
    return simjoin.greedy_match(t.old_vec, t.new_vec, 0.92).select("new_idx", "old_idx")
