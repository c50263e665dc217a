"""Exact inner-product top-k over quantised vectors, by MaxScore within shards.

A vector is a bag of terms (its dimensions) with integer weights. In one shard, dimension d ranges
over [low, high], so for a query weight q its contribution above the shard's least is between 0 and
q * range. Dimensions are sorted by that bound. Those whose bounds together cannot lift a
vector over the query's k-th best score so far are non-essential: the essential postings are
summed for every vector of a block, the others are probed in falling order of bound, only for
vectors that can still compete. Each shard yields its k best per query, and shards are merged.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
EVERY = 20
QUERY_BLOCK = 4096
BLOCK = 8192
PROBES = 4
SCALE = 64.0
_EXACT = 2.0 ** 53


def quantised(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id and ``v``, the floor of each component times ``scale``; rows whose vector is null or holds a
    null, NaN or infinite component are left out, and so are rows without an id."""
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("_x")).filter(
        F.col("vec_id").isNotNull() & F.col("_x").isNotNull()).filter(
        F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))).select(
        "vec_id", F.transform("_x", lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``column`` as int64, filled with 0 (an absent term) up to ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = at < width
    out[rows[keep], at[keep]] = flat[keep]
    return out


class Best:
    """The k best (score, lowest id first) of one query so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores, self.least = k, np.empty(0, np.int64), np.empty(0, np.int64), None

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[order], scores[order]
        self.least = int(self.scores[-1]) if len(order) == self.k else None


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                 best: list[Best]) -> None:
    """Fold one block of vectors into the queries' best lists."""
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    bounds = np.abs(queries).astype(float).sum(axis=1) * max(1.0, float(np.abs(vectors).max(initial=0)))
    kind = np.float64 if bounds.max(initial=0) < _EXACT / 2 else np.int64  # whole numbers either way
    columns = np.ascontiguousarray(vectors.T).astype(kind)
    for n, q in enumerate(queries):
        mine, found = best[n], ids != query_ids[n]
        if mine.least is None:
            scores = q.astype(kind) @ columns
            top = np.flatnonzero(found)
            if len(top) > 4 * mine.k:
                edge = np.partition(scores[top], len(top) - mine.k)[len(top) - mine.k]
                top = top[scores[top] >= edge]
            mine.add(ids[top], scores[top].astype(np.int64))
            continue
        gain = np.maximum(q * low, q * high)          # most that each term adds
        spread = gain - np.minimum(q * low, q * high)
        order = np.argsort(-spread, kind="stable")
        after = np.concatenate([np.cumsum(gain[order][::-1])[::-1], [0]])  # most that terms from i on add
        # non-essential: the tail of terms that, with the least of the head, cannot reach the k-th score
        head = np.cumsum(np.minimum(q * low, q * high)[order])
        reach = head + after[1:]
        essential = int(np.argmax(reach < mine.least)) + 1 if (reach < mine.least).any() else len(order)
        step = order[:essential]
        scores = q[step].astype(kind) @ columns[step]
        live = np.flatnonzero(found & (scores + after[essential] >= mine.least))
        scores = scores[live]
        for at in range(essential, len(order), PROBES):
            if not len(live):
                break
            step = order[at:at + PROBES]
            scores = scores + q[step].astype(kind) @ columns[np.ix_(step, live)]
            able = scores + after[min(at + PROBES, len(order))] >= mine.least
            live, scores = live[able], scores[able]
        if len(live):
            mine.add(ids[live], scores.astype(np.int64))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best rows of ``vectors`` other than its own id.

    Both inputs have vec_id and ``v`` (array of long). Ties go to the smaller id; a query meets
    fewer rows than ``k`` only if there are fewer. Shorter vectors lack terms, which count 0. Equal
    query rows count once; rows of ``vectors`` that share the query's id are its own. Empty tables
    give an empty result. Sums must stay below 2^63.

    Queries travel in blocks of ``query_block`` rows, a bounded broadcast each; every block scans
    the shards once, where they lie, and only k rows per query and shard are shuffled.
    """
    spark = vectors.sparkSession
    asked = queries.select("vec_id", "v").distinct()
    n = asked.count()
    schema = "query_id long, vec_id long, score long"
    blocks = max(1, -(-n // query_block))
    every = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(
            F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b)
        held = part.toArrow().combine_chunks()        # about ``query_block`` rows
        query_ids = held.column("vec_id").to_numpy()
        lists = held.column("v").combine_chunks()
        width = max([len(v) for v in lists if v.is_valid], default=0)
        sent = spark.sparkContext.broadcast((query_ids, _matrix(lists, width) if len(query_ids) else None, width))

        def scan(batches, sent=sent):
            ids_q, rows_q, wide = sent.value
            if rows_q is None:
                return
            best = [Best(k) for _ in ids_q]
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    piece = batch.slice(at, BLOCK)
                    rows = _matrix(piece.column("v"), wide)
                    search_block(piece.column("vec_id").to_numpy(zero_copy_only=False), rows, ids_q, rows_q, best)
            for at in range(0, len(best), 512):
                some = best[at:at + 512]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids_q[at:at + 512], [len(x.ids) for x in some]), pa.int64()),
                    pa.array(np.concatenate([x.ids for x in some]), pa.int64()),
                    pa.array(np.concatenate([x.scores for x in some]), pa.int64())],
                    names=["query_id", "vec_id", "score"])

        got = vectors.select("vec_id", "v").mapInArrow(scan, schema)
        every = got if every is None else every.unionByName(got)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
