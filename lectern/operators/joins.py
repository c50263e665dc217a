"""Joins between passages, vectors, sources, metadata and results."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def passages_with_vectors(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    return passages.join(vectors, "idx")


def length_mismatch(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows present on one side only."""
    p = passages.select("idx", F.lit(True).alias("p"))
    v = vectors.select("idx", F.lit(True).alias("v"))
    sides = p.join(v, "idx", "full").select(
        "idx", F.coalesce("p", F.lit(False)).alias("has_passage"), F.coalesce("v", F.lit(False)).alias("has_vector"))
    return sides.filter(~(F.col("has_passage") & F.col("has_vector")))


def with_source_names(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` (source_idx, source); its measured size decides whether it is broadcast."""
    return rows.join(sources, "source_idx", "left").withColumn("source", F.coalesce("source", F.lit("")))


def attach(results: DataFrame, *sides: DataFrame) -> DataFrame:
    """Left joins of a bounded result to per-passage tables. The result is computed once; each
    table is scanned for its ids alone."""
    results = cut_lineage(results)
    for side in sides:
        near = side.join(results.select("idx"), "idx", "left_semi")
        results = results.join(near, "idx", "left")
    return results


def keep_ids(df: DataFrame, ids: DataFrame, on: str = "idx") -> DataFrame:
    return df.join(ids.select(on), on, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, on: str = "idx") -> DataFrame:
    return df.join(ids.select(on), on, "left_anti")


def toc_mismatch(toc: DataFrame, passages: DataFrame) -> DataFrame:
    """Declared against actual passages per source."""
    actual = passages.groupBy("source").agg(F.count("*").alias("actual"))
    both = toc.join(actual, "source", "full").select(
        "source", F.coalesce("declared", F.lit(0)).cast("bigint").alias("declared"),
        F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.filter("declared <> actual")


def with_proposals(results: DataFrame, proposals: DataFrame) -> DataFrame:
    """Each result with its sorted set of proposal kinds; there are four kinds."""
    kinds = proposals.groupBy("idx").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return results.join(kinds, "idx", "left")


def rank_results(few: DataFrame, score: str = "score") -> DataFrame:
    """1..k over an already cut result."""
    return few.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "idx")))
