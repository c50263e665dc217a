"""Registered queries: keyword boosts, strict reranking, token retrieval."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexical as lx
from ..functions import vectors as vx
from ..operators import filters, joins
from ..operators import lexical_search as ls
from ..operators import retrieval as rt
from .fixtures import KEYWORDS
from .queries_functions import TOKENS, sql_list
from .queries_retrieval import HITS, rounded
from .registry import query

ASK = "the attionnd thention of the ndhend"
ASK_TOKENS = ls.query_tokens(ASK)

query("k1_keyword_match", f"WITH p AS (SELECT idx, lower(text) AS t FROM passages) SELECT idx, ({HITS})::INT AS hits FROM p")(
    lambda t: t.wide_passages.select("idx", lx.keyword_hits(KEYWORDS, F.col("text")).alias("hits")))

BOOSTED = "WITH p AS (SELECT s.idx, cos, lower(text) AS t FROM scored s JOIN passages p ON s.idx = p.idx) SELECT idx, round(cos + least(({h}) * {w}, {c}), 6) AS score FROM p"


def _scored(t):
    return t.vectors.select("idx", vx.cosine("v", t.query_vec).alias("score")).join(t.wide_passages, "idx")


query("k2_keyword_boost_add", BOOSTED.format(h=HITS, w=0.04, c=0.12))(lambda t: rounded(_scored(t).select(
    "idx", (F.col("score") + lx.boost(lx.keyword_hits(KEYWORDS, F.col("text")), 0.04, 0.12)).alias("score")), "score"))
query("k3_keyword_boost_blend", BOOSTED.format(h=HITS, w=0.03, c=0.12))(lambda t: rounded(_scored(t).select(
    "idx", (F.col("score") + lx.boost(lx.keyword_hits(KEYWORDS, F.col("text")), 0.03, 0.12)).alias("score")), "score"))
query("k4_keyword_boost_title", """
WITH p AS (SELECT s.idx, cos, lower(split_part(text, chr(10), 1)) AS t FROM scored s JOIN passages p ON s.idx = p.idx)
SELECT idx, round(cos + least((contains(t, 'tion')::INT + contains(t, 'ering')::INT + contains(t, 'xylograph')::INT) * 0.1, 0.3), 6) AS score FROM p""")(
    lambda t: rounded(ls.title_boosted(_scored(t), KEYWORDS).select("idx", "score"), "score"))


@query("k5_keyword_boost_fielded", """
WITH cand AS (SELECT idx, cos FROM scored ORDER BY cos DESC, idx LIMIT 100),
p AS (SELECT c.idx, cos, lower(text) AS b, lower(split_part(text, chr(10), 1)) AS t FROM cand c JOIN passages p ON c.idx = p.idx WHERE NOT tombstone),
h AS (SELECT *, contains(t, 'tion')::INT + contains(t, 'ering')::INT + contains(t, 'xylograph')::INT AS nt,
  contains(b, 'tion')::INT + contains(b, 'ering')::INT + contains(b, 'xylograph')::INT AS nb FROM p),
s AS (SELECT idx, cos + least(nt * 0.1, 0.3) + least((nb - nt) * 0.05, 0.2) + CASE WHEN nb >= 2 THEN least(0.05 + nb * 0.05, 0.25) ELSE 0 END AS sc FROM h)
SELECT idx, round(sc, 6) AS score FROM s ORDER BY sc DESC, idx LIMIT 10""")
def _(t):
    few = rt.best(t.vectors.select("idx", vx.cosine("v", t.query_vec).alias("score")), ls.FIELDED_POOL)
    return rounded(ls.fielded_topk(few, t.passages, KEYWORDS, 10), "score")


@query("k6_strict_keyword_rerank", """
WITH cand AS (SELECT idx, cos FROM scored ORDER BY cos DESC, idx LIMIT 50),
r AS (SELECT c.idx, lower(text) AS b, row_number() OVER (ORDER BY cos DESC, c.idx)::INT AS rank FROM cand c JOIN passages p ON c.idx = p.idx WHERE NOT tombstone)
SELECT idx, rank, contains(b, 'the on')::INT AS has_phrase, contains(b, 'tion')::INT + contains(b, 'ering')::INT + contains(b, 'xylograph')::INT AS keyword_hits
FROM r WHERE contains(b, 'tion') OR contains(b, 'ering') OR contains(b, 'xylograph')""")
def _(t):
    few = rt.best(t.vectors.select("idx", vx.cosine("v", t.query_vec).alias("score")), 50)
    ranked = joins.rank_results(rt.with_passages(few, t.passages))
    return ls.strict_rerank(ranked, "The on", KEYWORDS).select("idx", "rank", "has_phrase", "keyword_hits")


PAIRS = [f"{a} {b}" for a, b in zip(ASK_TOKENS, ASK_TOKENS[1:])]
RETRIEVED = f"""k AS (SELECT idx, source, text, {TOKENS} AS ts FROM passages WHERE NOT tombstone),
sc AS (SELECT idx, source, text, (len(list_filter(ts, lambda x: list_contains({sql_list(ASK_TOKENS)}, x)))
  + 3.0 * len(list_filter(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]), lambda x: list_contains({sql_list(PAIRS)}, x))))
  / (1.0 + sqrt(len(ts)) / 10.0) AS score FROM k),
hits AS (SELECT * FROM sc WHERE score > 0 ORDER BY score DESC, idx LIMIT {{n}})"""

query("k7_token_bigram_retrieve", f"WITH {RETRIEVED.format(n=20)} SELECT idx, source, text, round(score, 6) AS score FROM hits")(
    lambda t: rounded(ls.token_retrieve(t.wide_passages, ASK, 20), "score"))
query("k8_context_block", f"""WITH {RETRIEVED.format(n=8)}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, idx) AS rank FROM hits)
SELECT string_agg('[' || rank || '] (' || source || ') ' || trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) || chr(10) ORDER BY rank) AS block FROM r""")(
    lambda t: ls.context_block(joins.rank_results(ls.token_retrieve(t.wide_passages, ASK, 8))))


@query("k9_retrieve_with_fallback", f"""WITH {RETRIEVED.format(n=5)}
SELECT 'hit' AS ask, idx, false AS fallback FROM hits UNION ALL SELECT 'miss', idx, true FROM (SELECT idx FROM passages WHERE NOT tombstone ORDER BY idx LIMIT 5)""")
def _(t):
    hit = ls.retrieve_with_fallback(t.wide_passages, ASK, 5).select(F.lit("hit").alias("ask"), "idx", "fallback")
    miss = ls.retrieve_with_fallback(t.wide_passages, "zzyzx quux", 5).select(F.lit("miss").alias("ask"), "idx", "fallback")
    return hit.unionByName(miss)


@query("k10_curate_sources", """
WITH g AS (SELECT source, count(*) AS n, min(idx) AS cited_idx FROM passages WHERE NOT tombstone GROUP BY 1)
SELECT * FROM (SELECT 'top' AS kind, * FROM g ORDER BY n DESC, source LIMIT 5) UNION ALL
SELECT * FROM (SELECT 'thin' AS kind, * FROM g WHERE n < 48 ORDER BY n, lower(source), source LIMIT 8)""")
def _(t):
    live = filters.live(t.passages)
    return ls.leading_sources(live).select(F.lit("top").alias("kind"), "source", "n", "cited_idx").unionByName(
        ls.thin_sources(live, 48).select(F.lit("thin").alias("kind"), "source", "n", "cited_idx"))


@query("k11_sample_width", f"WITH {RETRIEVED.format(n=6)} SELECT idx, round(score, 6) AS score FROM hits")
def _(t):
    return rounded(ls.token_retrieve(t.wide_passages, ASK, ls.sample_width("medium", 6, 8)).select("idx", "score"), "score")
