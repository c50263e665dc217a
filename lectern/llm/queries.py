"""The registered queries of this package: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import license_scan
from .common import table, tokenizer_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run
    return add


@query("op1_language_id")
def op1(spark, sf_dir):
    from .language_id import language_report
    return language_report(table(spark, sf_dir, "documents"))


@query("op2_decision_list_quality")
def op2(spark, sf_dir):
    from .quality_rules import quality_report
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_huffman_token_ids")
def op3(spark, sf_dir):
    from .token_codec import store_and_read
    return store_and_read(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op4_best_fit_packing")
def op4(spark, sf_dir):
    from .packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op5_pair_index_bpe")
def op5(spark, sf_dir):
    from .bpe import round_trip
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


#: The documents as files: four levels of folders from source and id, every fifth one a licence file.
_FILES = ("SELECT doc_id, concat(source, '/', CAST(floor(doc_id / 1000) AS BIGINT), '/', CAST(floor(doc_id / 100) AS BIGINT), "
          "'/', CASE WHEN doc_id % 5 = 0 THEN 'LICENSE-' ELSE 'page-' END, doc_id, '.txt') AS path, text FROM {0}")


def _files(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.sql(_FILES.format("{docs}"), docs=docs)


@query("op6_license_scan", sql=license_scan.sql_for(_FILES.format("documents")))
def op6(spark, sf_dir):
    return license_scan.scan_licences(_files(table(spark, sf_dir, "documents")))


#: Words and the set of word 5-grams of a text, as DuckDB SQL.
_WORDS = "regexp_extract_all(lower({0}), '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+')"
_GRAMS = ("list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) "
          "WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)")


@query("op7_jaccard_join", sql=f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
s AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM w), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE c / (i.n + j.n - c) >= 0.8),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS v, doc_id AS head FROM documents UNION SELECT l.y, r.head FROM r JOIN l ON r.v = l.x)
SELECT doc_id, (SELECT min(head) FROM r WHERE r.v = doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.x = doc_id) AS n_links FROM documents""")
def op7(spark, sf_dir):
    from .jaccard_join import jaccard_classes
    return jaccard_classes(table(spark, sf_dir, "documents"))


@query("op8_viterbi_counts")
def op8(spark, sf_dir):
    from .token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op9_maxscore_topk", sql="""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT q.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(q.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM x WHERE vec_id % 20 = 0) q JOIN x b ON q.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20""")
def op9(spark, sf_dir):
    from .topk import quantised, top_k
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter("vec_id % 20 = 0"))


# runs of words that are cut at any place of a text are beyond plain SQL; a test holds the query against brute force
@query("op10_substring_dedup")
def op10(spark, sf_dir):
    from .substring_dedup import RUN_WORDS, deduplicated
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), run_words=RUN_WORDS)


@query("op12_overlap_bpe")
def op12(spark, sf_dir):
    from .overlap_bpe import round_trip
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


#: The unsigned crc32 of a short ASCII string, bit by bit.
_CRC = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda d: CAST(ascii(d) AS BIGINT))), "
        "lambda c, d: list_reduce(list_prepend(xor(c, d), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")


@query("op11_prefix_trie", sql=f"""
WITH t AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS b, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS code
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list({{'code': code, 'b': b}} ORDER BY turn NULLS FIRST, code) AS own, {_CRC.format('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM t GROUP BY conv_id),
r AS (SELECT s.conv_id, list_concat(coalesce(f.own[:s.h], []), s.own[s.h + 1:]) AS seq FROM s LEFT JOIN s f ON f.conv_id = s.conv_id - s.conv_id % 5),
p AS (SELECT conv_id, d, list_transform(seq[:d], lambda x: x.code) AS path, CASE WHEN d > 0 THEN seq[d].b ELSE 0 END AS b, d = len(seq) AS ends
  FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
  sha256(array_to_string(coalesce(list(conv_id ORDER BY conv_id) FILTER (ends), []), ',')) AS ends_sha256 FROM p GROUP BY path, d),
k AS (SELECT path[:d - 1] AS path, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
u AS (SELECT path, count_if(leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved FROM (SELECT path[:i] AS path, leaf, saved FROM (
  SELECT n.path, unnest(range(0, d + 1)) AS i, k.n IS NULL AS leaf, (n_convs - 1) * b AS saved FROM n LEFT JOIN k ON k.path = n.path)) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, above.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, u.n_leaves, u.saved AS saved_tokens, n.ends_sha256
FROM n JOIN u ON u.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN n above ON n.d > 0 AND above.d = n.d - 1 AND above.path = n.path[:n.d - 1]""")
def op11(spark, sf_dir):
    from .prefix_trie import prefix_trie
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: Ten rounds of assignment and update, one after the other, and the last assignment.
_NEAR = ("SELECT vec_id, q, v, arg_min({{'d': d, 'k': k}}, (d, k)) AS m FROM (SELECT x.vec_id, x.q, x.v, c.k, CAST(list_sum(list_transform(list_zip(x.v, c.c), "
         "lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM x CROSS JOIN c{0} c) GROUP BY ALL")
_ROUND = ("a{0} AS MATERIALIZED (" + _NEAR + "), u{0} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(v) AS x, "
          "generate_subscripts(v, 1) AS i FROM a{0}) GROUP BY k, i), c{1} AS MATERIALIZED (SELECT c{0}.k, coalesce(w.c, c{0}.c) AS c FROM c{0} LEFT JOIN "
          "(SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM u{0} GROUP BY k) w ON w.k = c{0}.k)")


@query("op13_centroid_clusters", sql=f"""
WITH x AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS q, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS k, v AS c FROM x
  QUALIFY k < 8), {', '.join(_ROUND.format(r, r + 1) for r in range(10))},
f AS ({_NEAR.format(10)})
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c10.c, ',')) AS centroid_sha256 FROM f JOIN c10 ON c10.k = m.k""")
def op13(spark, sf_dir):
    from .centroids import clusters
    return clusters(table(spark, sf_dir, "embeddings"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)
