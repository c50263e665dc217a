"""Subset overlap and snapshot diffs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import filters, ranking, simjoin

SEMANTIC_THRESHOLD = 0.92      # fixed values of the change log
SIZE_RATIO = 0.5
REBUILD_RATIO = 0.98


def in_subset(query: str) -> Column:
    """Query is a substring of the text or of the source."""
    if not query:
        return F.lit(False)
    return filters.holds(F.col("text"), query) | filters.holds(F.coalesce("source", F.lit("")), query)


def subset_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of either subset with their side; one scan, no join."""
    flagged = df.withColumn("in_a", in_subset(a)).withColumn("in_b", in_subset(b)).filter("in_a OR in_b")
    side = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "only_a").otherwise("only_b")
    return flagged.withColumn("side", side).drop("in_a", "in_b")


def union_primary_walk(primary: DataFrame, walked: DataFrame) -> DataFrame:
    return primary.withColumn("from_walk", F.lit(False)).unionByName(walked.withColumn("from_walk", F.lit(True)))


def diff_exact(old: DataFrame, new: DataFrame) -> DataFrame:
    """Match equal texts as multisets: (status, new_idx, old_idx, source).

    The n-th new copy by rising idx meets the n-th old copy by falling idx, so surplus new copies
    are the later ones and surplus old copies the earlier ones. Texts are told apart by 128 bits of hash. One grouping
    settles the texts that each side holds at most once; the copies of the others are numbered, and the position is
    part of the join key, which spreads a text that fills a third of the corpus over all tasks. A null text matches nothing. The
    groups and positions are written when this is called.
    """
    keys = ["k", "l"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("idx", "source", F.xxhash64("text").alias("k"), F.xxhash64(F.lit(7), "text").alias("l"), F.col("text").isNull().alias("_none"))

    o, n = keyed(old), keyed(new)
    both = o.withColumn("old", F.lit(True)).unionByName(n.withColumn("old", F.lit(False))).filter(~F.col("_none"))
    row, is_old = F.struct("idx", "source"), F.col("old")
    groups = materialize(both.groupBy(*keys).agg(
        F.count_if(is_old).alias("n_old"), F.count_if(~is_old).alias("n_new"), F.max(F.when(is_old, row)).alias("o"),
        F.max(F.when(~is_old, row)).alias("n")), "texts")
    once = (F.col("n_old") <= 1) & (F.col("n_new") <= 1)
    columns = ["new_idx", "old_idx", "new_source", "old_source"]
    alone = groups.filter(once).select(F.col("n.idx").alias("new_idx"), F.col("o.idx").alias("old_idx"),
                                       F.col("n.source").alias("new_source"), F.col("o.source").alias("old_source"))
    several = groups.filter(~once).select(*keys)
    # old copies count from the highest idx down
    turn = both.join(several, keys, "left_semi").withColumn("at", F.when(is_old, -F.col("idx")).otherwise(F.col("idx")))
    placed = ranking.in_order(turn.select("idx", "source", "old", "at", *keys), ["old", *keys], [F.col("at")], "nth")
    o_turn, n_turn = (placed.filter(side).select(*keys, "nth", F.col("idx").alias(f"{name}_idx"), F.col("source").alias(f"{name}_source"))
                      for side, name in ((is_old, "old"), (~is_old, "new")))
    copies = n_turn.join(o_turn, [*keys, "nth"], "full").select(*columns)
    nothing = F.lit(None)
    unread = n.filter("_none").select(F.col("idx").alias("new_idx"), nothing.cast("bigint").alias("old_idx"), F.col("source").alias("new_source"),
                                      nothing.cast("string").alias("old_source")).unionByName(
        o.filter("_none").select(nothing.cast("bigint").alias("new_idx"), F.col("idx").alias("old_idx"), nothing.cast("string").alias("new_source"),
                                 F.col("source").alias("old_source")))
    status = F.when(F.col("old_idx").isNull(), "added").when(F.col("new_idx").isNull(), "removed").otherwise("unchanged")
    return alone.unionByName(copies).unionByName(unread).select(
        status.alias("status"), "new_idx", "old_idx", F.coalesce("new_source", "old_source").alias("source"))


def diff_semantic(old: DataFrame, new: DataFrame, threshold: float = SEMANTIC_THRESHOLD) -> DataFrame:
    """Match by cosine >= threshold, greedily in new order; no size cap."""
    pairs = simjoin.greedy_match(old, new, threshold)
    o = old.select(F.col("idx").alias("old_idx"), F.sha2("text", 256).alias("old_key"), F.col("source").alias("old_source"))
    n = new.select(F.col("idx").alias("new_idx"), F.sha2("text", 256).alias("new_key"), F.col("source").alias("new_source"))
    both = n.join(pairs, "new_idx", "left").join(o, "old_idx", "full")
    status = (F.when(F.col("new_idx").isNull(), "removed").when(F.col("old_idx").isNull(), "added")
              .when(F.col("old_key") == F.col("new_key"), "unchanged").otherwise("modified"))
    return both.select(status.alias("status"), "new_idx", "old_idx",
                       F.coalesce("new_source", "old_source").alias("source"))


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("source", "status").agg(F.count("*").alias("n"))


def diff_totals(changes: DataFrame) -> DataFrame:
    def n(s):
        return F.count_if(F.col("status") == s).alias(s)
    return changes.agg(n("added"), n("removed"), n("modified"), n("unchanged"))


def diff_notes(totals: DataFrame, same_fingerprint: Column) -> DataFrame:
    """Structural note: sizes differ by more than half. Rebuild note: nearly everything matched,
    something changed, and the vectors differ."""
    matched = F.col("unchanged") + F.col("modified")
    n_new, n_old = matched + F.col("added"), matched + F.col("removed")
    larger = F.greatest(n_new, n_old)
    ratio = F.abs(n_new - n_old) / F.greatest(larger, F.lit(1))
    changed = (F.col("added") > 0) | (F.col("removed") > 0) | (F.col("modified") > 0)
    return totals.select(
        "*", n_old.alias("n_old"), n_new.alias("n_new"),
        ((n_new > 0) & (n_old > 0) & (ratio > SIZE_RATIO)).alias("structural_note"),
        ((matched / F.greatest(larger, F.lit(1)) >= REBUILD_RATIO) & ~same_fingerprint & changed).alias("rebuild_note"))
