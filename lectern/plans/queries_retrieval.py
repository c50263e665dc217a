"""Registered queries: vector retrieval, rank measures and similarity joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import retrieval as rt
from ..operators import simjoin
from ..operators import vector_index as ix
from ..operators import joins
from ..session import scratch_path
from .fixtures import KEYWORDS, QUERY_IDX
from .registry import query
from .search import search

R6 = 6
HITS = " + ".join(
    f"(contains(t, '{k}') OR list_bool_or(list_transform(string_split_regex(t, '\\s+'), "
    f"lambda w: {{stem}} = '{s}')))::INT" for k, s in (("tion", "tion"), ("ering", "ering"), ("xylograph", "xylograph")))
SUFFIXES = "ings ing tion sion ness ment able ible ful less ous ive ed es s ly".split()


def stem_sql(word: str) -> str:
    """The suffix chain as SQL over a word expression."""
    arms = " ".join(f"WHEN ends_with({word}, '{s}') AND length({word}) > {len(s) + 2} "
                    f"THEN left({word}, length({word}) - {len(s)})" for s in SUFFIXES)
    return f"(CASE {arms} ELSE {word} END)"


STRIPPED = "trim(w, '.,!?;:''\"')"
HITS = HITS.replace("{stem}", stem_sql(STRIPPED))


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, R6))
    return df


FLAGSHIP = f"""
WITH cand AS (SELECT idx, cos, ham, 0.7 * cos + 0.3 * ham AS base FROM scored WHERE idx NOT IN (SELECT idx FROM passages WHERE tombstone) ORDER BY base DESC, idx LIMIT 40),
kept AS (SELECT c.*, p.text, lower(p.text) AS t FROM cand c JOIN passages p ON c.idx = p.idx
         WHERE NOT p.tombstone AND base >= 0.05),
hit AS (SELECT *, least(({HITS}) * 0.03, 0.12) AS boost FROM kept)
SELECT idx, text, round(cos, 6) AS cosine_score, round(ham, 6) AS hamming_score, round(boost, 6) AS keyword_boost,
       round(base + boost, 6) AS score FROM hit ORDER BY base + boost DESC, idx LIMIT 10"""


def flagship(t):
    found = rt.hamming_blend_topk(t.vectors, t.query_vec, t.passages, 10, KEYWORDS)
    return rounded(found, "cosine_score", "hamming_score", "keyword_boost", "score")


query("v3_hamming_blend_topk", FLAGSHIP)(flagship)


@query("v1_cosine_topk", f"""
WITH cand AS (SELECT idx, cos FROM scored WHERE idx NOT IN (SELECT idx FROM passages WHERE tombstone) ORDER BY cos DESC, idx LIMIT 20),
kept AS (SELECT c.*, lower(p.text) AS t FROM cand c JOIN passages p ON c.idx = p.idx WHERE NOT p.tombstone),
hit AS (SELECT idx, cos, cos + least(({HITS}) * 0.04, 0.12) AS s FROM kept)
SELECT idx, round(s, 6) AS score, round(cos, 6) AS cosine_score FROM hit ORDER BY s DESC, idx LIMIT 10""")
def _(t):
    return rounded(rt.cosine_topk(t.vectors, t.query_vec, 10, t.passages, KEYWORDS), "score", "cosine_score")


@query("v2_hamming_topk", "SELECT idx, round(ham, 6) AS score FROM scored ORDER BY ham DESC, idx LIMIT 10")
def _(t):
    return rounded(rt.hamming_topk(t.vectors, t.query_vec, 10), "score")


@query("v4_packed_hamming_topk", "SELECT idx, round(ham, 6) AS score FROM scored ORDER BY ham DESC, idx LIMIT 10")
def _(t):
    packed = t.vectors.select("idx", vx.pack_signs(F.col("v")).alias("bits"))
    bits = t.embeddings.filter(F.col("vec_id") == QUERY_IDX).select(vx.pack_signs(F.col("embedding"))).scalar()
    return rounded(rt.packed_hamming_topk(packed, bits, 64, 10), "score")


@query("v5_cosine_candidates", """
WITH cand AS (SELECT idx, v, cos FROM scored WHERE idx NOT IN (SELECT idx FROM passages WHERE tombstone) ORDER BY cos DESC, idx LIMIT 50)
SELECT c.idx, round(list_sum(c.v), 5) AS v_sum, p.text, round(cos, 6) AS score
FROM cand c JOIN passages p ON c.idx = p.idx""")
def _(t):
    found = rt.cosine_candidates(t.vectors, t.query_vec, t.passages, 50)
    total = F.aggregate(vx.doubles("v"), F.lit(0.0), lambda s, x: s + x)
    return rounded(found.select("idx", F.round(total, 5).alias("v_sum"), "text", "score"), "score")


SIGNATURES = """
WITH s AS (SELECT idx, list_inner_product(signature, q[1:32]) / (sqrt(list_inner_product(q[1:32], q[1:32])) + 1e-9)
  / (sqrt(list_inner_product(signature, signature)) + 1e-9) AS cos FROM signatures, query_vec),
cand AS (SELECT * FROM s ORDER BY cos DESC, idx LIMIT 20)
SELECT c.idx, round(cos, 6) AS score, round(cos, 6) AS signature_score FROM cand c JOIN passages p ON c.idx = p.idx
WHERE NOT p.tombstone ORDER BY cos DESC, c.idx LIMIT 10"""


@query("v6_signature_topk", SIGNATURES)
def _(t):
    q = rt.vector_of(t.signatures, QUERY_IDX, "signature")
    return rounded(rt.signature_topk(t.signatures, q, 10, t.passages), "score", "signature_score")


@query("v7_blend_rerank", """
WITH cand AS (SELECT idx, cos FROM scored ORDER BY cos DESC, idx LIMIT 50),
s AS (SELECT c.idx, cos, aux, 0.7 * aux + 0.3 * cos AS sc FROM cand c JOIN aux_scores a ON c.idx = a.idx)
SELECT idx, round(cos, 6) AS cosine_score, aux, round(sc, 6) AS score FROM s ORDER BY sc DESC, idx LIMIT 10""")
def _(t):
    return rounded(rt.blend_rerank(t.vectors, t.query_vec, t.aux_scores, 0.7, 10), "score", "cosine_score")


@query("v8_rerank_with_fill", """
WITH cand AS (SELECT idx FROM scored ORDER BY cos DESC, idx LIMIT 50)
SELECT s.idx, round(CASE WHEN c.idx IS NOT NULL THEN a.aux ELSE 0.5 * s.cos END, 6) AS score
FROM scored s LEFT JOIN cand c ON s.idx = c.idx LEFT JOIN aux_scores a ON s.idx = a.idx""")
def _(t):
    return rounded(rt.rerank_with_fill(t.vectors, t.query_vec, t.aux_scores, 50), "score")


def label_centroids(t):
    """One saved query per label: the mean vector of the label's rows."""
    parts = t.vectors.select("label", F.posexplode("v").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(F.col("label").alias("qid")).agg(F.transform(ordered, lambda p: p["m"]).alias("q"))


BATCH = """
WITH parts AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM vectors),
means AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY 1, 2),
qs AS (SELECT label AS qid, list(m ORDER BY pos) AS q FROM means GROUP BY 1),
s AS (SELECT qid, idx, round(list_inner_product(v, q) / (sqrt(list_inner_product(q, q)) + 1e-9)
  / (sqrt(list_inner_product(v, v)) + 1e-9), 6) AS score FROM vectors, qs),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS rank FROM s)
SELECT qid::BIGINT AS qid, idx, score, rank::INT AS rank FROM r WHERE rank <= 10"""


@query("v9_batch_topk", BATCH)
def _(t):
    return rounded(rt.batch_topk(t.vectors, label_centroids(t), 10), "score")


def indexed(t, lists):
    path = scratch_path(t.spark, "vector-index")
    ix.build_index(t.vectors, path, lists)
    return path


@query("v9b_index_topk_all_lists", BATCH)
def _(t):
    """Every list is probed, so the result is exact."""
    return rounded(ix.search_index(t.spark, indexed(t, 12), label_centroids(t), 10, probes=12), "score")


@query("v9c_index_topk_probed")
def _(t):
    """A quarter of the lists is read for each query."""
    return rounded(ix.search_index(t.spark, indexed(t, 12), label_centroids(t), 10, probes=3), "score")


@query("v10_walk_from", """
WITH cand AS (SELECT idx, cos FROM scored ORDER BY cos DESC, idx LIMIT 20)
SELECT c.idx, round(cos, 6) AS score, round(cos, 6) AS cosine_score FROM cand c JOIN passages p ON c.idx = p.idx
WHERE NOT p.tombstone ORDER BY cos DESC, c.idx LIMIT 10""")
def _(t):
    return rounded(rt.walk_from(t.vectors, QUERY_IDX, t.passages, 10), "score", "cosine_score")


PRIMARY = """cand AS (SELECT idx, cos FROM scored ORDER BY cos DESC, idx LIMIT 20),
prim AS (SELECT c.idx, cos AS score FROM cand c JOIN passages p ON c.idx = p.idx
  WHERE NOT p.tombstone ORDER BY cos DESC, c.idx LIMIT 10)"""
WALK = f"""
WITH {PRIMARY},
sims AS (SELECT a.idx AS p, b.idx, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) + 1e-9)
  / (sqrt(list_inner_product(b.v, b.v)) + 1e-9) AS s FROM vectors a JOIN prim ON a.idx = prim.idx, vectors b
  WHERE a.idx <> b.idx AND b.idx NOT IN (SELECT idx FROM tombstones)),
near AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s DESC, idx) AS r FROM sims),
w AS (SELECT idx, count(*) AS walk_count, avg(s) AS score FROM near WHERE r <= 10
  AND idx NOT IN (SELECT idx FROM prim) GROUP BY 1 HAVING count(*) >= 2),
shown AS (SELECT * FROM w ORDER BY walk_count DESC, score DESC, idx LIMIT 10)
SELECT idx, 0::BIGINT AS walk_count, round(score, 6) AS score, false AS from_walk FROM prim
UNION ALL SELECT idx, walk_count, round(score, 6), true FROM shown"""


def walk(t):
    primary = rt.walk_from(t.vectors, QUERY_IDX, t.passages, 10).select("idx", "score")
    return rounded(rt.walk_expand(t.vectors, primary, t.tombstones), "score")


query("v11_walk_expand", WALK)(walk)


@query("v12_epsilon_tiebreak_sort", """
WITH cand AS (SELECT idx, cos FROM scored ORDER BY cos DESC, idx LIMIT 50),
p AS (SELECT c.idx, cos, aux FROM cand c JOIN aux_scores a ON c.idx = a.idx),
e AS (SELECT max(aux) AS hi, 0.05 * (max(aux) - min(aux)) AS w FROM p)
SELECT idx, round(cos, 6) AS cosine_score, aux, floor((hi - aux) / w)::BIGINT AS bucket FROM p, e""")
def _(t):
    few = rt.best(t.vectors.select("idx", vx.cosine("v", t.query_vec).alias("cosine_score")), 50, "cosine_score")
    pool = t.aux_scores.join(F.broadcast(few), "idx")
    return rounded(rt.epsilon_tiebreak_sort(pool), "cosine_score")


@query("v13_rank_displacement", """
WITH a AS (SELECT idx, row_number() OVER (ORDER BY cos DESC, idx) AS rank FROM scored QUALIFY rank <= 10),
b AS (SELECT idx, row_number() OVER (ORDER BY ham DESC, idx) AS rank FROM scored QUALIFY rank <= 10)
SELECT count_if(a.idx IS DISTINCT FROM b.idx)::BIGINT AS displaced, count(*) AS ranks FROM a FULL JOIN b ON a.rank = b.rank""")
def _(t):
    both = t.vectors.select("idx", vx.similarity("v", t.query_vec).alias("s"))
    a = joins.rank_results(rt.best(both.select("idx", F.col("s.cosine").alias("score")), 10))
    b = joins.rank_results(rt.best(both.select("idx", F.col("s.hamming").alias("score")), 10))
    return rt.rank_displacement(a.select("rank", "idx"), b.select("rank", "idx"), 10)


@query("v14_sign_preservation", "SELECT idx, round(ham, 6) AS preserved FROM scored")
def _(t):
    same = vx.sign_preservation(F.col("v"), F.col("q"))
    return rounded(t.vectors.withColumn("q", t.query_vec).select("idx", same.alias("preserved")), "preserved")


@query("v15_l2_normalize", """
SELECT idx, round(sqrt(list_inner_product(v, v)), 6) AS norm,
  round(v[1] / CASE WHEN sqrt(list_inner_product(v, v)) < 1e-9 THEN 1.0 ELSE sqrt(list_inner_product(v, v)) END, 6) AS first,
  len(v)::INT AS dim FROM vectors""")
def _(t):
    unit = t.vectors.select("idx", vx.norm(F.col("v")).alias("norm"), vx.l2_normalize(F.col("v")).alias("u"))
    return rounded(unit.select("idx", "norm", F.col("u")[0].alias("first"), F.size("u").alias("dim")), "norm", "first")


@query("v16_minmax_quantize", """
SELECT idx, list_sum(list_transform(v, lambda x: floor((x - list_min(v)) / (list_max(v) - list_min(v)) * 255.0)))::BIGINT AS u8_sum,
  round(list_sum(list_transform(v, lambda x: (x - list_min(v)) / (list_max(v) - list_min(v)))), 5) AS unit_sum FROM vectors""")
def _(t):
    u8 = F.aggregate(vx.quantize_u8(F.col("v")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    unit = F.aggregate(vx.minmax_normalize(F.col("v")), F.lit(0.0), lambda s, x: s + x)
    return t.vectors.select("idx", u8.alias("u8_sum"), F.round(unit, 5).alias("unit_sum"))


@query("v17_minmax_cosine", """
WITH m AS (SELECT idx, list_transform(v, lambda x: (x - list_min(v)) / (list_max(v) - list_min(v) + 1e-9)) AS v FROM vectors)
SELECT idx, round(list_inner_product(v, q) / (sqrt(list_inner_product(q, q)) + 1e-9) / (sqrt(list_inner_product(v, v)) + 1e-9), 6) AS score
FROM m, query_vec ORDER BY list_inner_product(v, q) / (sqrt(list_inner_product(q, q)) + 1e-9) / (sqrt(list_inner_product(v, v)) + 1e-9) DESC, idx LIMIT 10""")
def _(t):
    return rounded(rt.minmax_cosine(t.vectors, t.query_vec, 10), "score")


@query("v18_contrastive_center", """
WITH parts AS (SELECT unnest(v) AS x, unnest(range(64)) AS pos FROM vectors),
mean AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS m FROM parts GROUP BY pos))
SELECT idx, round(list_sum(list_transform(list_zip(v, m), lambda p: greatest(0.0, least(1.0, p[1] - 0.3 * p[2])))), 5) AS total
FROM vectors, mean""")
def _(t):
    centered = rt.contrastive_center(t.vectors, 0.3)
    return centered.select("idx", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("v19_get_vector", "SELECT idx, v FROM vectors WHERE idx = 7")
def _(t):
    return t.vectors.filter(F.col("idx") == QUERY_IDX).select("idx", vx.doubles("v").alias("v"))


@query("v20_search_dispatch", """
WITH cand AS (SELECT idx, cos FROM scored ORDER BY cos DESC, idx LIMIT 50),
s AS (SELECT c.idx, cos, aux FROM cand c JOIN aux_scores a ON c.idx = a.idx),
sm AS (SELECT 'smart' AS mode, idx, 0.7 * aux + 0.3 * cos AS score FROM s ORDER BY score DESC, idx LIMIT 10),
asc_ AS (SELECT 'associate' AS mode, idx, aux AS score FROM s ORDER BY score DESC, idx LIMIT 10),
fc AS (SELECT idx, cos FROM scored ORDER BY cos DESC, idx LIMIT 20),
fa AS (SELECT 'fast' AS mode, fc.idx, cos AS score FROM fc JOIN passages p ON fc.idx = p.idx WHERE NOT p.tombstone
  ORDER BY score DESC, fc.idx LIMIT 10)
SELECT mode, idx, round(score, 6) AS score FROM (SELECT * FROM sm UNION ALL SELECT * FROM asc_ UNION ALL SELECT * FROM fa)""")
def _(t):
    out = None
    for mode in ("smart", "associate", "fast"):
        found = search(mode, t.vectors, t.query_vec, t.passages, aux=t.aux_scores, k=10)
        found = found.select(F.lit(mode).alias("mode"), "idx", F.round("score", R6).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


ASSOCIATED = """cand AS (SELECT idx, cos FROM scored ORDER BY cos DESC, idx LIMIT 50),
prim AS (SELECT c.idx, aux AS score FROM cand c JOIN aux_scores a ON c.idx = a.idx ORDER BY aux DESC, c.idx LIMIT 10)"""


@query("v20b_search_modes", f"""
SELECT 'hamming' AS mode, idx, score, false AS from_walk FROM ({FLAGSHIP})
UNION ALL SELECT 'pure_brain', idx, score, false FROM ({SIGNATURES})
UNION ALL SELECT 'associate', idx, score, from_walk FROM ({WALK.replace(PRIMARY, ASSOCIATED)})""")
def _(t):
    """The other modes of the same entry: the default with keywords, signatures, and associate with its walk."""
    q = rt.vector_of(t.signatures, QUERY_IDX, "signature")
    asked = {"hamming": {"keywords": KEYWORDS}, "pure_brain": {"signatures": t.signatures, "signature_query": q},
             "associate": {"aux": t.aux_scores, "walk": True, "deleted": t.tombstones}}
    found = [search(mode, t.vectors, t.query_vec, t.passages, 10, **more) for mode, more in asked.items()]
    shown = [df.select(F.lit(mode).alias("mode"), "idx", F.round("score", R6).alias("score"), F.col("from_walk") if "from_walk" in df.columns
                       else F.lit(False).alias("from_walk")) for mode, df in zip(asked, found)]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query("v21_similarity_join", """
WITH l AS (SELECT v, min(idx) AS rep, count(*) AS n FROM old_vec GROUP BY v),
r AS (SELECT v, min(idx) AS rep, count(*) AS n FROM new_vec GROUP BY v)
SELECT l.rep AS left_idx, l.n AS left_copies, r.rep AS right_idx, r.n AS right_copies,
  round(list_cosine_similarity(l.v, r.v), 6) AS similarity
FROM l LEFT JOIN r ON list_cosine_similarity(l.v, r.v) > 0.8""")
def _(t):
    return rounded(simjoin.similarity_left_join(t.old_vec, t.new_vec, 0.8), "similarity")


@query("v21b_similarity_join_approximate")
def _(t):
    """Pairs of similarity 0.5 or more with a recall of 0.95; the exact mode above has the SQL."""
    return rounded(simjoin.similarity_left_join(t.old_vec, t.new_vec, 0.5, recall=0.95), "similarity")


@query("v22_relevance_view", """
SELECT p.idx, p.source, round(cos, 6) AS relevance FROM passages p JOIN scored s ON p.idx = s.idx
WHERE p.source LIKE '%1' AND cos > 0.1""")
def _(t):
    rt.relevance_view(t.passages, t.vectors, t.query_vec, "scored_corpus")
    return t.spark.sql("SELECT idx, source, round(relevance, 6) AS relevance FROM scored_corpus "
                       "WHERE source LIKE '%1' AND relevance > 0.1 ORDER BY relevance DESC, idx")
