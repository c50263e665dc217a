"""Vector retrieval: top-k by cosine, sign-Hamming and blends, walks and rank measures.

Inputs
    vectors   (idx, v)                    one embedding per passage
    passages  (idx, text[, tombstone])    one passage per idx

Scores read only ``idx`` and ``v``; passage text is joined after the cut, to at most a few dozen
broadcast candidates. Every order ends with ``idx`` so that results are stable.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical as lx
from ..functions import vectors as vx
from ..session import cut_lineage
from . import ranking

HAMMING_SHARE = 0.3       # fixed values of the blended score
BLEND_FLOOR = 0.05
EXTRA_POOL = 10
POOL = 50
QUERY_BYTES = 64 * 1024 * 1024


def best(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    return df.orderBy(F.desc(score), F.asc("idx")).limit(k)


def with_passages(few: DataFrame, passages: DataFrame) -> DataFrame:
    """Join a bounded candidate set to its passages; tombstoned ones fall out.

    A passage table laid out by ``idx_block`` is read only in the blocks that hold a candidate.
    """
    on = ["idx"]
    if "idx_block" in passages.columns:
        from ..sources.corpus_io import IDX_BLOCK
        # dynamic partition pruning wants a predicate on the broadcast side; ids start at 0
        few = few.filter(F.col("idx") >= 0).withColumn("idx_block", F.floor(F.col("idx") / IDX_BLOCK).cast("int"))
        on.append("idx_block")
    joined = passages.join(F.broadcast(few), on, "inner")
    if "tombstone" in passages.columns:
        joined = joined.filter(~F.col("tombstone"))
    return joined


def _rerank(few: DataFrame, passages: DataFrame | None, keywords, per_hit: float, k: int) -> DataFrame:
    if passages is None:
        return best(few, k)
    kept = with_passages(few, passages)
    if keywords:
        bonus = lx.boost(lx.keyword_hits(keywords, F.col("text")), per_hit, 0.12)
        kept = kept.withColumn("score", F.col("score") + bonus)
    return best(kept.select(*few.columns), k)


def live_only(scored: DataFrame, passages: DataFrame | None) -> DataFrame:
    """Scores of passages that are not tombstoned; only ids and scores meet, before any cut."""
    if passages is None:
        return scored
    return scored.join(passages.filter("tombstone").select("idx"), "idx", "left_anti")


def cosine_topk(vectors: DataFrame, query, k: int = 10, passages: DataFrame | None = None,
                keywords=(), v: str = "v") -> DataFrame:
    """Best k + 10 live passages by cosine, plus .04 per keyword (at most .12), cut to k."""
    scored = live_only(vectors.select("idx", vx.cosine(v, query).alias("score")), passages)
    few = best(scored, k + EXTRA_POOL).withColumn("cosine_score", F.col("score"))
    return _rerank(few, passages, keywords, 0.04, k)


def signature_topk(signatures: DataFrame, query, k: int = 10, passages: DataFrame | None = None,
                   keywords=()) -> DataFrame:
    """The same over the ``signature`` column."""
    found = cosine_topk(signatures, query, k, passages, keywords, v="signature")
    return found.withColumnRenamed("cosine_score", "signature_score")


def hamming_topk(vectors: DataFrame, query, k: int = 10) -> DataFrame:
    return best(vectors.select("idx", vx.hamming("v", query).alias("score")), k)


def packed_hamming_topk(packed: DataFrame, query_bits: Column, dim: int, k: int = 10) -> DataFrame:
    """``packed`` (idx, bits): sign words written once by ``pack_signs``."""
    score = vx.packed_hamming(F.col("bits"), F.col("_q"), F.lit(dim))
    return best(packed.withColumn("_q", query_bits).select("idx", score.alias("score")), k)


def hamming_blend_topk(vectors: DataFrame, query, passages: DataFrame, k: int = 10, keywords=()) -> DataFrame:
    """0.7 cosine + 0.3 Hamming; best max(4k, 20) live passages, then weak scores fall out, then .03 per
    keyword (at most .12), cut to k."""
    both = vectors.select("idx", vx.similarity("v", query).alias("s"))
    blended = (1 - HAMMING_SHARE) * F.col("s.cosine") + HAMMING_SHARE * F.col("s.hamming")
    scored = both.select("idx", blended.alias("base"), F.col("s.cosine").alias("cosine_score"),
                         F.col("s.hamming").alias("hamming_score"))
    few = best(live_only(scored, passages), max(4 * k, 20), "base")
    kept = with_passages(few, passages).filter(F.col("base") >= BLEND_FLOOR)
    bonus = (lx.boost(lx.keyword_hits(keywords, F.col("text")), 0.03, 0.12) if keywords else F.lit(0.0))
    out = kept.select("idx", "text", "cosine_score", "hamming_score", bonus.alias("keyword_boost"),
                      (F.col("base") + bonus).alias("score"))
    return best(out, k)


def cosine_candidates(vectors: DataFrame, query, passages: DataFrame, pool: int = POOL) -> DataFrame:
    """Top pool with score, vector and passage; a query of another size raises."""
    scored = vectors.select("idx", "v", vx.cosine("v", query).alias("score"))
    return best(with_passages(best(live_only(scored, passages), pool), passages), pool)


def blend_rerank(vectors: DataFrame, query, aux: DataFrame, alpha: float = 0.7, k: int = 10,
                 pool: int = POOL) -> DataFrame:
    """alpha * aux + (1 - alpha) * cosine over the top pool; ``aux`` is (idx, aux)."""
    few = best(vectors.select("idx", vx.cosine("v", query).alias("cosine_score")), pool, "cosine_score")
    joined = aux.join(F.broadcast(few), "idx", "inner")
    score = alpha * F.col("aux") + (1.0 - alpha) * F.col("cosine_score")
    return best(joined.select("idx", "cosine_score", "aux", score.alias("score")), k)


def rerank_with_fill(vectors: DataFrame, query, aux: DataFrame, pool: int = POOL) -> DataFrame:
    """Candidates take their aux score, every other row half its cosine."""
    scored = vectors.select("idx", vx.cosine("v", query).alias("cosine_score"))
    few = best(scored, pool, "cosine_score").select("idx")
    candidate_aux = aux.join(F.broadcast(few), "idx", "inner").select("idx", "aux")
    joined = scored.join(F.broadcast(candidate_aux), "idx", "left")
    return joined.select("idx", F.coalesce("aux", 0.5 * F.col("cosine_score")).alias("score"))


def minmax_cosine(vectors: DataFrame, query, k: int = 10) -> DataFrame:
    scaled = vectors.select("idx", vx.minmax_guarded(F.col("v")).alias("v"))
    return best(scaled.select("idx", vx.cosine("v", query).alias("score")), k)


def vector_of(vectors: DataFrame, idx: int, v: str = "v") -> Column:
    """One row's vector as a scalar subquery."""
    return vectors.filter(F.col("idx") == idx).select(v).scalar()


def walk_from(vectors: DataFrame, idx: int, passages: DataFrame | None = None, k: int = 10) -> DataFrame:
    """The row's own vector is the query; the row itself comes first."""
    return cosine_topk(vectors, vector_of(vectors, idx), k, passages)


# -- many queries ----------------------------------------------------------------------------

PAIR_SCHEMA = "qid bigint, idx bigint, score double"


SCORE_CELLS = 4_000_000


def _first_k(s, i, k):
    """k best per row by score, then idx; partitions first unless a tie crosses the cut."""
    if s.shape[1] > 4 * k:
        part = np.argpartition(-s, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(s, part, 1).min(axis=1)
        if ((s >= edge[:, None]).sum(axis=1) <= k).all():
            s, i = np.take_along_axis(s, part, 1), np.take_along_axis(i, part, 1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _block_top(q_ids, q_unit, exclude_self, k):
    """A function that folds (idx, v) batches into each query's k best."""
    step = max(1, SCORE_CELLS // max(len(q_ids), 1))

    def fold(state, all_ids, vectors):
        for at in range(0, len(all_ids), step):
            ids = all_ids[at:at + step]
            scores = np.round(q_unit @ _unit(vectors[at:at + step]).T, 12)
            if exclude_self:
                scores[q_ids[:, None] == ids[None, :]] = -np.inf
            s = np.concatenate([state[0], scores], axis=1)
            i = np.concatenate([state[1], np.broadcast_to(ids, scores.shape)], axis=1)
            state = _first_k(s, i, k)
        return state
    return fold


def _emit(q_ids, state):
    s, i = state
    qid = np.repeat(q_ids, s.shape[1])
    keep = np.isfinite(s.ravel())
    return pa.RecordBatch.from_arrays(
        [pa.array(qid[keep]), pa.array(i.ravel()[keep]), pa.array(s.ravel()[keep])],
        names=["qid", "idx", "score"])


def _empty_state(n):
    return np.zeros((n, 0)), np.zeros((n, 0), dtype=np.int64)


def _unit(m):
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + vx.NORM_GUARD)


def batch_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = False,
               query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Exact k best per query; ``queries`` is (qid, q).

    A query matrix within ``query_bytes`` (checked on a limited read) travels with the task
    closure, and the corpus is scanned once without a shuffle. A larger set is cut into blocks
    of that size; a corpus row is sent once per block, and each task sees one query block and
    one corpus block. Both emit only each block's k best, merged by a salted top-k. Null vectors
    take no part.
    """
    vectors = vectors.select(F.col("idx").cast("bigint").alias("idx"), "v").filter("v IS NOT NULL")
    queries = queries.select(F.col("qid").cast("bigint").alias("qid"), "q").filter("q IS NOT NULL")
    first = queries.select(F.size("q").alias("n")).limit(1).collect()
    dim = first[0]["n"] if first else 1
    block = max(1, query_bytes // (8 * max(dim, 1)))
    head = queries.limit(block + 1).collect()
    if len(head) <= block:
        q_ids = np.array([r["qid"] for r in head], dtype=np.int64)
        q_unit = _unit(np.array([r["q"] for r in head], dtype=np.float64).reshape(len(head), dim))
        fold = _block_top(q_ids, q_unit, exclude_self, k)

        def scan(batches):
            state = _empty_state(len(q_ids))
            for batch in batches:
                if batch.num_rows:
                    state = fold(state, batch.column("idx").to_numpy(), vx.matrix(batch.column("v")))
            yield _emit(q_ids, state)

        partial = vectors.mapInArrow(scan, PAIR_SCHEMA)
    else:
        partial = _grid_topk(vectors, queries, k, exclude_self, block)
    order = [F.desc("score"), F.asc("idx")]
    return ranking.top_per_key(partial, ["qid"], k, order, "idx")


def _grid_topk(vectors, queries, k, exclude_self, block):
    n_q = queries.count()
    q_blocks = math.ceil(n_q / block) * 2                 # hashed blocks stay below the budget
    v_blocks = max(1, math.ceil(vectors.count() / block)) * 2
    q = queries.select(F.pmod(F.xxhash64("qid"), F.lit(q_blocks)).alias("qb"), "qid", "q").withColumn(
        "vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    c = vectors.select(F.pmod(F.xxhash64("idx"), F.lit(v_blocks)).alias("vb"), "idx", "v").withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.schema([("qid", pa.int64()), ("idx", pa.int64()), ("score", pa.float64())]).empty_table()
        ids = left.column("qid").to_numpy()
        fold = _block_top(ids, _unit(vx.matrix(left.column("q"))), exclude_self, k)
        state = fold(_empty_state(len(ids)), right.column("idx").to_numpy(), vx.matrix(right.column("v")))
        return pa.Table.from_batches([_emit(ids, state)])

    return q.groupBy("qb", "vb").cogroup(c.groupBy("qb", "vb")).applyInArrow(cell, PAIR_SCHEMA)


def walk_expand(vectors: DataFrame, primary: DataFrame, deleted: DataFrame | None = None, walk_k: int = 10,
                min_hits: int = 2, show: int = 10) -> DataFrame:
    """Neighbours reached from several primary results, appended to them.

    ``primary`` (idx, score) is a bounded result. Tombstones leave before each neighbour cut; a deleted result still looks
    for neighbours.
    """
    queries = vectors.join(primary.select("idx"), "idx", "left_semi")
    live = vectors if deleted is None else vectors.join(deleted.select("idx"), "idx", "left_anti")
    # at most walk_k rows per primary result, read twice below
    hops = cut_lineage(batch_topk(live, queries.select(F.col("idx").alias("qid"), F.col("v").alias("q")),
                                  walk_k, exclude_self=True))
    walked = (hops.groupBy("idx").agg(F.count("*").alias("walk_count"), F.avg("score").alias("score"))
              .filter(F.col("walk_count") >= min_hits)
              .join(primary.select("idx"), "idx", "left_anti")
              .orderBy(F.desc("walk_count"), F.desc("score"), "idx").limit(show))
    head = primary.select("idx", F.lit(0).cast("bigint").alias("walk_count"), "score", F.lit(False).alias("from_walk"))
    return head.unionByName(walked.withColumn("from_walk", F.lit(True)))


# -- orders and measures -----------------------------------------------------------------------

def epsilon_tiebreak_sort(pool: DataFrame, score: str = "aux", then: str = "cosine_score") -> DataFrame:
    """Scores within 5 % of the pool's range count as equal, then the second score decides.

    A pairwise "equal within epsilon" is no order, so scores are put in buckets of that width.
    """
    ends = pool.agg(F.max(score).alias("hi"), F.min(score).alias("lo"), F.count("*").alias("n"))
    width = F.when(F.col("e.n") >= 2, 0.05 * (F.col("e.hi") - F.col("e.lo"))).otherwise(F.lit(1e-6))
    with_ends = pool.withColumn("e", ends.select(F.struct("hi", "lo", "n")).scalar())
    slot = F.when(width > 0, F.floor((F.col("e.hi") - F.col(score)) / width)).otherwise(F.lit(0))
    return with_ends.withColumn("bucket", slot.cast("bigint")).drop("e").orderBy("bucket", F.desc(then), "idx")


def rank_displacement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Number of the first k ranks at which two rankings (rank, idx) differ."""
    both = a.filter(F.col("rank") <= k).alias("a").join(b.filter(F.col("rank") <= k).alias("b"), "rank", "full")
    differs = ~F.col("a.idx").eqNullSafe(F.col("b.idx"))
    return both.agg(F.count_if(differs).alias("displaced"), F.count("*").alias("ranks"))


def contrastive_center(vectors: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Subtract alpha times the corpus mean and clip to 0..1."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    mean = vectors.select(Summarizer.mean(array_to_vector(vx.doubles("v"))).alias("m")).select(vector_to_array("m"))
    with_mean = vectors.withColumn("_m", mean.scalar())
    moved = F.zip_with(vx.doubles("v"), F.col("_m"),
                       lambda x, m: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x - alpha * m)))
    return with_mean.select("idx", moved.alias("v"))


def relevance_view(passages: DataFrame, vectors: DataFrame, query, name: str) -> DataFrame:
    """Register ``name``: every passage with a queryable ``relevance`` column."""
    scored = vectors.select("idx", vx.cosine("v", query).alias("relevance"))
    view = passages.join(scored, "idx")
    view.createOrReplaceTempView(name)
    return view
