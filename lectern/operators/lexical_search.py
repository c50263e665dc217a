"""Keyword reranking and token/bigram retrieval."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical as lx
from ..functions import text as tx
from . import filters

# Passages drawn per difficulty.
WIDTHS = {"easy": 3, "medium": 5, "hard": 8}
FIELDED_POOL = 100


def title_boosted(scored: DataFrame, keywords) -> DataFrame:
    """.1 per keyword in the first line, at most .3, over the whole table."""
    title = F.lower(F.split("text", "\n", 2)[0])
    bonus = lx.boost(lx.contains_hits(keywords, title), 0.1, 0.3)
    return scored.withColumn("score", F.col("score") + bonus)


def fielded_topk(few: DataFrame, passages: DataFrame, keywords, k: int = 10) -> DataFrame:
    """Rerank a pool of at most 100 by title, body and several-keyword boosts."""
    from .retrieval import best, with_passages
    kept = with_passages(few, passages)
    return best(kept.select("idx", (F.col("score") + lx.fielded_boost(keywords, F.col("text"))).alias("score")), k)


def strict_rerank(results: DataFrame, query: str, keywords) -> DataFrame:
    """Drop results without a keyword; phrase first, then hits, then the old rank."""
    kept = filters.any_keyword(results, keywords)
    low = F.lower("text")
    phrase = F.contains(low, F.lit(query.strip().lower())).cast("int")
    hits = lx.contains_hits(keywords, low)
    return kept.withColumn("has_phrase", phrase).withColumn("keyword_hits", hits).orderBy(
        F.desc("has_phrase"), F.desc("keyword_hits"), "rank")


def token_score(tokens: Column, query_tokens: list[str]) -> Column:
    """Occurrences of query tokens plus 3 per query bigram, over a mild length norm.

    A bigram is looked up only where its first token is a query token, so no pair is built elsewhere.
    """
    wanted = list(dict.fromkeys(query_tokens))
    pairs = list(dict.fromkeys(f"{a} {b}" for a, b in zip(query_tokens, query_tokens[1:])))
    singles = F.size(F.filter(tokens, lambda t: t.isin(*wanted)))

    def begins_pair(t, i):
        return t.isin(*wanted) & F.concat_ws(" ", t, F.get(tokens, i + 1)).isin(*pairs)

    doubles = F.size(F.filter(tokens, begins_pair)) if pairs else F.lit(0)
    return (singles + 3.0 * doubles) / (1.0 + F.sqrt(F.size(tokens)) / 10.0)


def query_tokens(query: str) -> list[str]:
    import re
    stop = set(lx.TOKEN_STOPWORDS)
    found = (t.lower() for t in re.findall(lx.TOKEN_PATTERN, query or ""))
    return [t for t in found if t not in stop and len(t) > 2]


def _in_mode(passages: DataFrame, mode: str) -> DataFrame:
    if mode not in ("active", "all"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "all":
        return passages
    if {"flags", "perms", "lifecycle"} <= set(passages.columns):
        return filters.by_lifecycle(passages)
    return filters.live(passages) if "tombstone" in passages.columns else passages


def token_retrieve(passages: DataFrame, query: str, n: int, head_chars: int | None = None, mode: str = "active") -> DataFrame:
    """Best n passages by token and bigram overlap; without query tokens, the first n.

    ``active`` ranks live passages, and where the table has flag bytes only readable ones in active life; ``all`` ranks
    everything.
    """
    wanted = query_tokens(query)
    text = F.col("text") if head_chars is None else F.substring("text", 1, head_chars)
    rows = _in_mode(passages, mode).select("idx", "source", text.alias("text"))
    if not wanted:
        return rows.orderBy("idx").limit(n).withColumn("score", F.lit(0.0))
    # a substring test on the raw text spares tokenising passages that cannot match
    maybe = F.lit(False)
    for t in dict.fromkeys(wanted):
        maybe = maybe | F.contains(F.lower("text"), F.lit(t))
    scored = rows.filter(maybe).withColumn("tokens", lx.content_tokens(F.col("text"))).withColumn(
        "score", token_score(F.col("tokens"), wanted)).drop("tokens")
    return scored.filter("score > 0").orderBy(F.desc("score"), "idx").limit(n)


def context_block(hits: DataFrame) -> DataFrame:
    """One text block of numbered passages; ``hits`` is a bounded result with a rank."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] ("), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown source")),
                    F.lit(") "), tx.collapse_spaces(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n\n").alias("block"))


def retrieve_with_fallback(passages: DataFrame, query: str, n: int, head_chars: int | None = None) -> DataFrame:
    """No hit at all: the first n passages, flagged."""
    hits = token_retrieve(passages, query, n, head_chars)
    rest = token_retrieve(passages, "", n, head_chars).withColumn("_none", hits.agg((F.count("*") == 0)).scalar())
    return hits.withColumn("fallback", F.lit(False)).unionByName(
        rest.filter("_none").drop("_none").withColumn("fallback", F.lit(True)))


def sample_width(difficulty: str, questions: int, cap: int, briefing: bool = False) -> int:
    if briefing:
        return 2 * cap
    return min(max(WIDTHS.get(difficulty, WIDTHS["medium"]), questions), cap)


def thin_sources(live: DataFrame, minimum: int = 5, shown: int = 8) -> DataFrame:
    """Sources with fewer than ``minimum`` passages, thinnest first, with one cited passage."""
    counts = live.filter(F.col("source") != "").groupBy("source").agg(
        F.count("*").alias("n"), F.min("idx").alias("cited_idx"))
    return counts.filter(F.col("n") < minimum).orderBy("n", F.lower("source"), "source").limit(shown)


def leading_sources(live: DataFrame, shown: int = 5) -> DataFrame:
    counts = live.filter(F.col("source") != "").groupBy("source").agg(
        F.count("*").alias("n"), F.min("idx").alias("cited_idx"))
    return counts.orderBy(F.desc("n"), "source").limit(shown)
