"""A stored inverted-file index over vectors: lists by nearest centroid, each a folder that a search may leave unread.

    <path>/centroids   (list, centroid)            one row a list
    <path>/lists       (idx, v) by list             partitioned, so probed lists are all that is scanned
    <path>/sizes       (list, n)                    vectors of each list
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..session import cut_lineage
from . import ranking
from .retrieval import PAIR_SCHEMA, _block_top, _emit, _empty_state, _unit

SAMPLE, ROUNDS, BLOCK = 65_536, 12, 4096
MOST_LISTS = 16_384


def _fit(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids of a sample; one without members takes the sample's vector that is worst placed."""
    rng = np.random.default_rng(seed)
    units = _unit(sample)
    centres = units[rng.choice(len(units), min(lists, len(units)), replace=False)]
    for _ in range(rounds):
        sims = units @ centres.T
        home, score = sims.argmax(axis=1), sims.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, units)
        size = np.bincount(home, minlength=len(centres))
        sums[size == 0] = units[np.argsort(score)[:int((size == 0).sum())]]
        centres = _unit(sums)
    return centres


def _homes(vectors: DataFrame, centres: np.ndarray, nearest: int, schema: str) -> DataFrame:
    """One row for each of the ``nearest`` lists of a vector; ``schema`` names its id, its vector and the list."""
    ids, v, _ = (c.split()[0] for c in schema.split(","))

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sims = _unit(vx.matrix(batch.column(v))) @ centres.T
            lists = np.argsort(-sims, axis=1, kind="stable")[:, :nearest]
            rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), lists.shape[1])))
            yield pa.RecordBatch.from_arrays([rows.column(ids), rows.column(v), pa.array(lists.ravel().astype(np.int32))], names=[ids, v, "list"])

    return vectors.select(F.col(ids).cast("bigint").alias(ids), vx.doubles(v).alias(v)).filter(F.col(v).isNotNull()).mapInArrow(work, schema)


def build_index(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 1) -> None:
    """Write an index of ``vectors`` (idx, v) below ``path``.

    Centroids are fitted on at most ``sample`` vectors, chosen by hash; every vector is then put on its list. There are about as many
    lists as a list has vectors by default, at most ``MOST_LISTS``. A list of any size is written by several tasks. Null
    vectors are left out.
    """
    spark, rows = vectors.sparkSession, vectors.filter("v IS NOT NULL")
    total = rows.count()
    wanted = lists or max(1, min(MOST_LISTS, math.isqrt(total)))
    share = rows if total <= sample else rows.filter(F.pmod(F.xxhash64("idx"), F.lit(1 << 20)) < math.ceil(sample / total * (1 << 20)))
    picked = share.select(vx.doubles("v").alias("v")).limit(sample).collect()
    centres = _fit(np.array([r["v"] for r in picked], dtype=np.float64), wanted, rounds, seed) if picked else np.zeros((0, 1))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    homes = _homes(rows, centres, 1, "idx bigint, v array<double>, list int") if picked else spark.createDataFrame([], "idx bigint, v array<double>, list int")
    # rebalancing splits a large list over tasks and joins small ones
    homes.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")
    spark.read.schema("idx bigint, v array<double>, list int").parquet(f"{path}/lists").groupBy("list").agg(
        F.count("*").alias("n")).write.parquet(f"{path}/sizes")


def probed_lists(spark: SparkSession, path: str, queries: DataFrame, probes: int) -> DataFrame:
    """(qid, q, list): the ``probes`` lists nearest to each query."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()      # at most MOST_LISTS rows
    if not rows:
        return spark.createDataFrame([], "qid bigint, q array<double>, list int")
    return _homes(queries, np.array([r["centroid"] for r in rows]), probes, "qid bigint, q array<double>, list int")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 8, exclude_self: bool = False) -> DataFrame:
    """(qid, idx, score, rank): the k most similar vectors on each query's nearest ``probes`` lists.

    Only the lists that some query probes are read. With as many probes as lists the result is that of ``batch_topk``.
    Queries and vectors of a list meet in blocks of ``BLOCK`` rows, whatever the size of the list or the number of
    queries that probe it; a block gives its k best for each query. The probes are written when this is called.
    """
    asked = cut_lineage(probed_lists(spark, path, queries, probes))
    wanted = [r["list"] for r in asked.select("list").distinct().collect()]       # at most MOST_LISTS numbers
    stored = spark.read.schema("idx bigint, v array<double>, list int").parquet(f"{path}/lists").filter(F.col("list").isin(wanted))
    sizes = spark.read.schema("list int, n bigint").parquet(f"{path}/sizes")
    cuts = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_qb")).join(sizes, "list").select(
        "list", "n_qb", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_vb"))       # one row a list

    def split(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        return df.join(F.broadcast(cuts), "list").withColumn(own, F.pmod(F.xxhash64(key), F.col(f"n_{own}")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.schema([("qid", pa.int64()), ("idx", pa.int64()), ("score", pa.float64())]).empty_table()
        ids = left.column("qid").to_numpy()
        fold = _block_top(ids, _unit(vx.matrix(left.column("q"))), exclude_self, k)
        return pa.Table.from_batches([_emit(ids, fold(_empty_state(len(ids)), right.column("idx").to_numpy(), vx.matrix(right.column("v"))))])

    spot = ["list", "qb", "vb"]
    found = split(asked, "qid", "qb", "vb").select(*spot, "qid", "q").groupBy(*spot).cogroup(
        split(stored, "idx", "vb", "qb").select(*spot, "idx", "v").groupBy(*spot)).applyInArrow(meet, PAIR_SCHEMA)
    return ranking.top_per_key(found, ["qid"], k, [F.desc("score"), F.asc("idx")], "idx")
