"""Centroid clustering of integer vectors in built-in expressions.

The centroids of a round are literals in its plan: ``zip_with`` and ``aggregate`` give a row's squared distance to each,
``array_min`` of (distance, number) structs chooses, and sums of one column per component update them. A round is one
scan whose tasks send one row a cluster; only those rows reach the driver.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SIZE, SCALE, CENTROIDS, ROUNDS = 64, 1024, 8, 10


def quantised(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of the components of every vector that has exactly ``size`` of them, none null or
    non-finite; other vectors are left out. Components beyond 2^27 after scaling would overflow a distance and are refused."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    small = F.forall("v", lambda x: F.abs(x) <= 1 << 27)
    return vectors.filter((F.size("embedding") == size) & ~bad).select("vec_id", v.alias("v")).withColumn(
        "v", F.when(small, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large for a long distance"))))


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the centroid with the least squared distance, the smaller number on ties."""
    def distance(c: list[int]) -> Column:
        literal = F.array(*[F.lit(x).cast("long") for x in c])
        return F.aggregate(F.zip_with(v, literal, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda a, d: a + d)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster"))
                                 for k, c in enumerate(centroids)]))


def starts(rows: DataFrame, centroids: int = CENTROIDS) -> list[list[int]]:
    """The vectors with the least sha256 of ``3:<vec_id>``, rows without an id last; vectors of one id by their components."""
    order = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in rows.orderBy(order.asc_nulls_last(), "v").limit(centroids).select("v").collect()]


def trained(rows: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """Centroids after ``rounds`` rounds; one without vectors stays where it is."""
    size = len(centroids[0])
    for _ in range(rounds):
        sums = rows.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"),
                           *[F.get("v", F.lit(i)).alias(f"c{i}") for i in range(size)]).groupBy("cluster").agg(
            F.count("*").alias("n"), *[F.sum(f"c{i}").alias(f"s{i}") for i in range(size)]).collect()
        moved = {r.cluster: [r[f"s{i}"] // r.n for i in range(size)] for r in sums}
        after = [moved.get(k, c) for k, c in enumerate(centroids)]
        if after == centroids:   # every further round would give the same
            break
        centroids = after
    return centroids


def clusters(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that ``quantised`` keeps.

    Fewer vectors than ``centroids`` give fewer clusters; none give an empty result. Rows that repeat, or lack, an id are
    vectors of their own. Equal vectors among the starts leave the larger numbers empty. Other columns are not read.
    The rounds run when this is called; the quantised vectors are written below ``spark.checkpoint.dir`` once.
    """
    rows = materialize(quantised(vectors, size, scale), "quantised")
    first = starts(rows, centroids)
    if not first:
        return rows.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    last = trained(rows, first, rounds)
    near = nearest(F.col("v"), last)
    placed = materialize(rows.select("vec_id", near.alias("near")).select("vec_id", "near.cluster", "near.distance"), "clusters")
    sums = {r.cluster: int(r.d) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    digest = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in last])
    inertia = F.array(*[F.lit(sums.get(k, 0)).cast("long") for k in range(len(last))])
    return placed.select("vec_id", "cluster", "distance", F.get(inertia, F.col("cluster")).alias("cluster_inertia"),
                         F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(digest, F.col("cluster")).alias("centroid_sha256"))
