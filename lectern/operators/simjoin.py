"""Exact cosine similarity join, and the one-to-one matching built on it.

Copies of one vector are joined once: both sides are first grouped by vector. Distinct vectors
are then placed by pivots. Each right vector lives in the cell of its nearest pivot; a left vector
visits every cell that can hold a partner, since a partner within distance e of it cannot lie
further than e beyond the plane between two pivots. Every qualifying pair therefore meets in
exactly one cell. Where the planes keep few vectors away, as without structure, one cell holds all. Large cells are cut into
sub-blocks on both sides. A task holds the left vectors of one such block and passes the right ones by in batches, emitting
qualifying pairs only, so its memory depends neither on the table nor on the number of pairs. Most pairs are ruled out by the
first dimensions and the length of the rest, in single precision; what these cannot tell is computed in double.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..session import cut_lineage
from . import ranking
from .components import components

PIVOTS = 256
PROBES = 256
CELL_ROWS = 32768
SLACK = 1e-6
SCORES = 1 << 21          # similarities that a task holds at once
NUMBERS = 1 << 23         # numbers of the vectors that a task holds
PAIRS = 1 << 29           # pairs that are worth a task
HEAD = 24                 # dimensions that rule pairs out
DENSE = 64                # one pair of so many is left by them: not worth while
FEW_EDGES = 1 << 21       # links between groups that one task settles
MATCH_ROWS = 1 << 18      # rows of a component that one task matches,
MATCH_WORK = 1 << 36      # and products of numbers
EDGE_SCHEMA = "left_rep bigint, right_rep bigint, similarity double"


def vector_groups(df: DataFrame) -> DataFrame:
    """(rep, n, v): one row per distinct vector, named by its lowest idx."""
    return df.groupBy("v").agg(F.min("idx").alias("rep"), F.count("*").alias("n"))


def group_members(df: DataFrame, groups: DataFrame) -> DataFrame:
    """(idx, rep) for every row. A vector copied many times is one row of ``groups``, so the join
    is skewed on one side only, which adaptive execution splits."""
    return df.select("idx", "v").join(groups.select("v", "rep"), "v").select("idx", "rep")


def _unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _packed(m: np.ndarray) -> pa.Array:
    """A row of doubles as one binary value, which moves as it is."""
    ends = np.arange(len(m) + 1, dtype=np.int32) * (8 * m.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(m, dtype=np.float64))])


def _unpacked(column) -> np.ndarray:
    rows = column.to_pylist()
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors of different length in one column")
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)


def _reached(square: np.ndarray, gap: np.ndarray, reach: float) -> np.ndarray:
    """Which cells may hold a partner, by the squared distances to the pivots and the gaps between these."""
    visit = np.ones(square.shape, dtype=bool)
    for j in range(len(gap)):
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = np.where(gap[j] > 0, (square - square[:, [j]]) / (2 * gap[j]), 0.0)
        visit &= beyond <= reach + SLACK
    return visit


def _squares(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", unit, unit)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * unit @ pivots.T


def _gaps(pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(_squares(pivots, pivots), 0.0))


def _pivots(groups: DataFrame, reach: float) -> np.ndarray:
    """Distinct directions, chosen by hash: one for every ``CELL_ROWS`` vectors, so that no row is sent to more cells than the
    table needs, and at most ``PIVOTS``: a bounded read. Only one, if others of the vectors would visit most of the cells."""
    wanted = min(PIVOTS, math.ceil(groups.count() / CELL_ROWS))
    first = groups.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(wanted + (PROBES if wanted > 1 else 0))
    rows = first.collect() if wanted else []
    if not rows:
        return np.zeros((0, 0))
    unit = _unit(np.array([r["v"] for r in rows], dtype=np.float64))
    pivots = np.unique(np.round(unit[:wanted], 9), axis=0)
    probes = unit[wanted:]
    if len(probes) and _reached(_squares(probes, pivots), _gaps(pivots), reach).mean() > 0.5:
        return pivots[:1]
    return pivots


def _place(groups: DataFrame, pivots: np.ndarray, reach: float | None) -> DataFrame:
    """(rep, v, cell): the home cell, or with ``reach`` every cell that may hold a partner; ``v`` is the packed unit vector."""
    gap = _gaps(pivots)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(vx.matrix(batch.column("v")))
            square = _squares(unit, pivots)
            if reach is None:
                row, cell = np.arange(len(unit)), square.argmin(axis=1)
            else:
                row, cell = np.nonzero(_reached(square, gap, reach))
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(row)), _packed(unit[row]), pa.array(cell.astype(np.int32))],
                                             names=["rep", "v", "cell"])

    return groups.select(F.col("rep").cast("bigint").alias("rep"), vx.doubles("v").alias("v")).mapInArrow(
        assign, "rep bigint, v binary, cell int")


def _split(placed: DataFrame, cuts: DataFrame, own: str, other: str) -> DataFrame:
    """Own sub-block by hash, one copy per sub-block of the other side."""
    joined = placed.join(F.broadcast(cuts), "cell")
    mine = joined.withColumn(own, F.pmod(F.xxhash64("rep"), F.col(f"n_{own}")).cast("int"))
    copied = mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
    return copied.select("cell", "lb", "rb", "rep", "v")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, inclusive: bool = False,
                  best: int | None = None, links: bool = False) -> DataFrame:
    """(left_rep, right_rep, similarity) between distinct vectors of two ``vector_groups``.

    With ``best``, at most that many partners of a left vector come from each batch that a task passes by, the most similar.
    With ``links``, only pairs that tie together what a task had not tied yet: the components are those of all pairs.
    A null vector has no partner.
    """
    left, right = left.filter("v IS NOT NULL"), right.filter("v IS NOT NULL")
    reach = math.sqrt(max(2.0 - 2.0 * threshold, 0.0))
    pivots = _pivots(right, reach)
    spark = left.sparkSession
    if not len(pivots):
        return spark.createDataFrame([], EDGE_SCHEMA)
    homes = cut_lineage(_place(right, pivots, None))
    visits = cut_lineage(_place(left, pivots, reach))
    most, cores = max(1, min(4 * CELL_ROWS, NUMBERS // max(1, pivots.shape[1]))), 2 * spark.sparkContext.defaultParallelism
    sizes = visits.groupBy("cell").agg(F.count("*").alias("l")).join(homes.groupBy("cell").agg(F.count("*").alias("r")), "cell")
    cuts = []
    for cell, n_left, n_right in sizes.select("cell", "l", "r").collect():        # one row per pivot at most
        lb = math.ceil(n_left / most)
        cuts.append((cell, lb, max(math.ceil(n_right / most), math.ceil(min(n_left * n_right / PAIRS, cores) / lb))))
    if not cuts:
        return spark.createDataFrame([], EDGE_SCHEMA)
    blocks, cut = sum(lb * rb for _, lb, rb in cuts), spark.createDataFrame(pa.table(dict(zip(
        ("cell", "n_lb", "n_rb"), (pa.array(x, pa.int32()) for x in zip(*cuts))))))
    l_parts = _split(visits, cut, "lb", "rb")
    r_parts = _split(homes, cut, "rb", "lb")
    return _meet(l_parts, r_parts, ["cell", "lb", "rb"], threshold, inclusive, best, links=links, tasks=min(4 * blocks, 4096))


def _linking(i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) tie together what was apart. ``left`` and ``right`` hold the label of each row, a right one -1
    until it is in a pair, and are brought up to date."""
    picked = []
    new = np.flatnonzero(right[j] < 0)
    if len(new):
        first = new[np.unique(j[new], return_index=True)[1]]
        right[j[first]] = left[i[first]]
        picked.append(first)
    while True:
        low, high = np.minimum(left[i], right[j]), np.maximum(left[i], right[j])
        apart = np.flatnonzero(low != high)
        if not len(apart):
            return np.concatenate(picked) if picked else apart
        apart = apart[np.lexsort((low[apart], high[apart]))]
        chosen = apart[np.unique(high[apart], return_index=True)[1]]      # each label goes to the least one it meets
        picked.append(chosen)
        to = np.arange(len(left))
        to[high[chosen]] = low[chosen]
        while (to[to] != to).any():
            to = to[to]
        left[:] = to[left]
        seen = right >= 0
        right[seen] = to[right[seen]]


def _heads(unit: np.ndarray) -> np.ndarray | None:
    """The first dimensions and the length of the others: two such rows multiply to no less than their vectors do."""
    if unit.shape[1] < HEAD + 8:
        return None
    return np.concatenate([unit[:, :HEAD], np.linalg.norm(unit[:, HEAD:], axis=1, keepdims=True)], axis=1).astype(np.float32)


def _meet(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, inclusive: bool = False, best: int | None = None,
          bands: int = 0, links: bool = False, tasks: int | None = None) -> DataFrame:
    """Qualifying pairs of left and right rows (rep, v) that share their whole-number ``keys``; ``v`` is a packed unit vector.

    Both sides are dealt by the keys, the left rows first. With ``bands``, the first key is a band, and rows that
    share one of their ``codes`` in an earlier band have met there.
    """
    columns = [*keys, "rep", "v", *(["codes"] if bands else [])]
    names = ["left_rep", "right_rep", "similarity"]
    loose = 1e-5          # more than single precision is off by, over HEAD + 1 products of unit vectors

    def codes(part):
        return part.column("codes").combine_chunks().flatten().to_numpy().reshape(part.num_rows, bands) if bands else None

    def side(part):
        part = part if isinstance(part, pa.Table) else pa.Table.from_batches([part])
        unit = _unpacked(part.column("v"))
        return part.column("rep").to_numpy(), unit, codes(part), _heads(unit)

    def found(a, b, a_head, b_head, tally):
        """(i, j, similarity) of the pairs that may qualify."""
        if a_head is not None and 2 * tally[1] <= tally[0] + 8:
            at = np.flatnonzero(a_head @ b_head.T > np.float32(threshold - loose))
            tally[0] += 1
            if DENSE * len(at) <= len(a) * len(b):
                i, j = np.divmod(at, len(b))
                step = max(1, SCORES // a.shape[1])
                sims = [np.einsum("ij,ij->i", a[i[n:n + step]], b[j[n:n + step]]) for n in range(0, len(at), step)]
                return i, j, np.concatenate(sims) if sims else np.zeros(0)
            tally[1] += 1
        scores = a @ b.T
        i, j = np.nonzero(scores > threshold - SLACK)
        return i, j, scores[i, j]

    def pairs(a, b, band, tally, label):
        (a_ids, a_unit, a_codes, a_head), (b_ids, b_unit, b_codes, b_head) = a, b
        step = max(1, SCORES // len(b_ids))
        b_label = np.full(len(b_ids), -1)
        for at in range(0, len(a_ids), step):
            i, j, sims = found(a_unit[at:at + step], b_unit, None if a_head is None else a_head[at:at + step], b_head, tally)
            sims = np.round(sims, 12)
            hit = sims >= threshold if inclusive else sims > threshold
            i, j, sims = i[hit], j[hit], sims[hit]
            if best is not None and len(i) > best:
                order = np.lexsort((b_ids[j], -sims, i))
                i, j, sims = i[order], j[order], sims[order]
                kept = np.arange(len(i)) - np.searchsorted(i, i) < best
                i, j, sims = i[kept], j[kept], sims[kept]
            if bands and band:
                first = ~(a_codes[at + i, :band] == b_codes[j, :band]).any(axis=1)
                i, j, sims = i[first], j[first], sims[first]
            if links and len(i):
                kept = _linking(at + i, j, label, b_label)
                i, j, sims = i[kept], j[kept], sims[kept]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(a_ids[at + i]), pa.array(b_ids[j]), pa.array(sims)], names=names)

    def work(batches):
        spot, waiting, held, label, tally = None, [], None, None, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in [*keys, "_right"]], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(at)]
            for lo, hi in zip(cuts, cuts[1:]):
                *here, passing = at[lo].tolist()
                part = batch.slice(lo, hi - lo)
                if here != spot:
                    spot, waiting, held = here, [], None
                if not passing:
                    waiting.append(part)
                    continue
                if held is None and waiting:
                    held, waiting = side(pa.Table.from_batches(waiting)), []
                    label = np.arange(len(held[0]))
                if held is not None:
                    yield from pairs(held, side(part), here[0], tally, label)

    both = left.select(*columns, F.lit(0).alias("_right")).unionByName(right.select(*columns, F.lit(1).alias("_right")))
    dealt = both.repartition(tasks, *keys) if tasks else both.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, "_right").mapInArrow(work, EDGE_SCHEMA)


# -- approximate mode ---------------------------------------------------------------------------

def plane_bands(threshold: float, recall: float, bits: int) -> int:
    """Bands of ``bits`` random planes that two vectors of similarity ``threshold`` meet in with probability ``recall``."""
    same = 1.0 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi      # one plane leaves both on one side
    return max(1, math.ceil(math.log1p(-recall) / math.log1p(-same ** bits))) if same < 1 else 1


def near_pairs(left: DataFrame, right: DataFrame, threshold: float, recall: float = 0.95, bits: int | None = None,
               seed: int = 1) -> DataFrame:
    """As ``similar_pairs``, but a pair is found with probability ``recall`` or more; what is found is verified.

    A vector's sides of ``bits`` random planes are its bucket in a band; a pair that shares a bucket in any band is compared,
    once, in the first band it shares. ``bits`` follows the logarithm of the number of right vectors by default, which
    keeps a bucket of vectors without structure at a few rows, and the number of bands follows from ``bits``, ``threshold``
    and ``recall``. A bucket with more than ``CELL_ROWS`` vectors is cut into blocks on both sides. A vector is sent to each of its
    bands; where these are more than the blocks it meets in the exact join, as with low thresholds, that one is the smaller
    work on disk and is taken, unless ``bits`` is given.
    """
    left, right = left.filter("v IS NOT NULL"), right.filter("v IS NOT NULL")
    spark, one = left.sparkSession, right.select(F.size("v").alias("n")).limit(1).collect()
    if not one:
        return spark.createDataFrame([], EDGE_SCHEMA)
    if bits is None:
        n_left, n_right = left.count(), right.count()
        bits = max(4, min(24, math.ceil(math.log2(max(n_right / 64, 1)))))
        # a row is sent once a band, or once a pivot or block
        if plane_bands(threshold, recall, bits) > max(math.ceil(n_left / CELL_ROWS), math.ceil(n_right / CELL_ROWS)):
            return similar_pairs(left, right, threshold)
    bands, dim = plane_bands(threshold, recall, bits), one[0]["n"]

    def banded(df: DataFrame) -> DataFrame:
        def work(batches):
            planes = np.random.default_rng(seed).normal(size=(dim, bands * bits))
            for batch in batches:
                if not batch.num_rows:
                    continue
                unit = _unit(vx.matrix(batch.column("v")))
                sides = (unit @ planes > 0).reshape(batch.num_rows, bands, bits)
                codes = (sides * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), _packed(unit), lists], names=["rep", "v", "codes"])

        coded = df.select(F.col("rep").cast("bigint").alias("rep"), vx.doubles("v").alias("v")).mapInArrow(
            work, "rep bigint, v binary, codes array<int>")
        return cut_lineage(coded).select("rep", "v", "codes", F.posexplode("codes").alias("band", "code"))

    lefts, rights = banded(left), banded(right)
    keys = ["band", "code"]

    def large(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(name)).filter(F.col(name) > 1)

    def split(df: DataFrame, own: str, other: str, mine: DataFrame, theirs: DataFrame) -> DataFrame:
        cut = df.join(mine, keys, "left").join(theirs, keys, "left").na.fill(1, [f"n_{own}", f"n_{other}"])
        return cut.withColumn(own, F.pmod(F.xxhash64("rep"), F.col(f"n_{own}")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).select(*keys, "lb", "rb", "rep", "v", "codes")

    l_big, r_big = large(lefts, "n_lb"), large(rights, "n_rb")     # few rows: a bucket counts once it is beyond CELL_ROWS
    return _meet(split(lefts, "lb", "rb", l_big, r_big), split(rights, "rb", "lb", r_big, l_big), [*keys, "lb", "rb"], threshold, bands=bands)


def similarity_left_join(left: DataFrame, right: DataFrame, threshold: float = 0.8, recall: float | None = None) -> DataFrame:
    """LEFT JOIN on similarity > threshold, one row per pair of distinct vectors.

    Copies are given as counts rather than as every pair of copies; ``group_members`` names them. With ``recall`` a pair
    is found with that probability at least (``near_pairs``) and the work no longer grows with the product of the sides; without it the join
    is exact.
    """
    l, r = vector_groups(left), vector_groups(right)
    pairs = similar_pairs(l, r, threshold) if recall is None else near_pairs(l, r, threshold, recall)
    named = pairs.join(r.select(F.col("rep").alias("right_rep"), F.col("n").alias("right_copies")), "right_rep")
    return l.select(F.col("rep").alias("left_idx"), F.col("n").alias("left_copies")).join(
        named.withColumnRenamed("left_rep", "left_idx"), "left_idx", "left").select(
        "left_idx", "left_copies", F.col("right_rep").alias("right_idx"), "right_copies", "similarity")


# -- one-to-one matching -------------------------------------------------------------------------

def _direction(v: str):
    """Key of a vector's direction at 12 decimals; null for a null vector."""
    @F.arrow_udf("binary")
    def keyed(vectors: pa.Array) -> pa.Array:
        keep = vectors.is_valid().to_numpy(zero_copy_only=False)
        unit = np.round(_unit(vx.matrix(vectors.filter(pa.array(keep)))), 12) + 0.0
        keys = iter([hashlib.md5(row.tobytes(), usedforsecurity=False).digest() for row in unit])
        return pa.array([next(keys) if k else None for k in keep], pa.binary())

    return keyed(v)


def _directed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (idx, v, key) and their groups (key, rep, n, v): one group per direction, since vectors that differ in length only
    are equally similar to everything."""
    rows = cut_lineage(df.select("idx", "v", _direction("v").alias("key")).filter("key IS NOT NULL"))
    groups = cut_lineage(rows.groupBy("key").agg(F.min("idx").alias("rep"), F.count("*").alias("n"), F.min_by("v", "idx").alias("v")))
    return rows, groups


def _members(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.select("idx", "key").join(groups.select("key", "rep"), "key").select("idx", "rep")


def _choices(left: DataFrame, right: DataFrame, slots: DataFrame, threshold: float, cap: int) -> tuple[DataFrame, DataFrame]:
    """What each new group asks for, in turn, and how long its list is.

    An entry is (old group, upto): one of the group's first ``upto`` rows. Old groups that are equally similar share their rows by
    idx: they are asked for in runs of rows that follow each other in idx order. Lists hold at most ``cap`` groups and end
    before a similarity that they may hold only in part; ``cut`` tells those.
    """
    pairs = similar_pairs(left, right, threshold, inclusive=True, best=cap)
    ranked = cut_lineage(ranking.top_per_key(pairs, ["left_rep"], cap, [F.desc("similarity"), F.asc("right_rep")], "right_rep", "at"))
    ends = ranked.groupBy("left_rep").agg((F.count("*") == cap).alias("cut"), F.min("similarity").alias("least"))
    whole = ranked.join(ends, "left_rep").filter(~F.col("cut") | (F.col("similarity") > F.col("least")))
    level = Window.partitionBy("left_rep", "similarity")
    classed = cut_lineage(whole.select("left_rep", "similarity", "right_rep", "at", F.count("*").over(level).alias("_ties")))
    room = right.select(F.col("rep").alias("right_rep"), F.col("n").alias("upto"))
    plain = classed.filter("_ties = 1").join(room, "right_rep").select("left_rep", "similarity", F.lit(0).cast("bigint").alias("run"), "right_rep", "upto")
    # rows of equally similar groups in idx order; a run ends where the next row is of another group
    by = level.orderBy("old_idx")
    tied = classed.filter("_ties > 1").join(slots, "right_rep").select(
        "left_rep", "similarity", "right_rep", F.col("place").alias("upto"), F.col("old_idx").alias("run"),
        F.lead("right_rep").over(by).alias("_next")).filter("_next IS NULL OR _next <> right_rep").drop("_next")
    entries = plain.unionByName(tied.select(*plain.columns)).select("*", F.row_number().over(
        Window.partitionBy("left_rep").orderBy(F.desc("similarity"), "run")).cast("bigint").alias("choice"))
    entries = cut_lineage(entries.drop("run"))
    lists = ends.join(entries.groupBy("left_rep").agg(F.count("*").alias("n_choices")), "left_rep", "left").select(
        "left_rep", "cut", F.coalesce("n_choices", F.lit(0)).alias("n_choices"))
    return entries, cut_lineage(lists)


def _lone_pairs(choices: DataFrame, lists: DataFrame) -> DataFrame | None:
    """Old and new groups that have no other partner, if that can be told: no list is cut."""
    if not lists.filter("cut").isEmpty():
        return None
    right = choices.groupBy("right_rep").agg(F.count("*").alias("n_asked"))
    return cut_lineage(choices.join(lists.filter("n_choices = 1"), "left_rep", "left_semi").join(
        right.filter("n_asked = 1"), "right_rep", "left_semi").select("left_rep", "right_rep", "similarity", "upto"))


def _shares(choices: DataFrame) -> bool:
    """Whether some row finds old groups equally similar."""
    return not choices.groupBy("left_rep", "similarity").count().filter("count > 1").isEmpty()


def _asked(state: DataFrame, choices: DataFrame, limited: bool) -> DataFrame:
    """One round of asking: what every row asks for with ``place`` and ``refused``."""
    asked = state.join(choices, ["left_rep", "choice"])
    ranked = ranking.in_order(asked, ["right_rep"], [F.col("new_idx")], "place")
    fits = F.col("place") <= F.col("upto")
    if not limited:
        return ranked.withColumn("refused", ~fits)
    # rows of one group may ask for different numbers of its rows: only those that surely stay count against a row
    sure = ranking.in_order(ranked.withColumn("_fits", fits.cast("bigint")), ["right_rep"], [F.col("new_idx")], "_again", {"_sure": "_fits"})
    return sure.withColumn("refused", ~fits & (F.col("_sure") >= F.col("upto"))).drop("_fits", "_again", "_sure")


def _match_in_rounds(o_rows: DataFrame, o_groups: DataFrame, n_rows: DataFrame, n_groups: DataFrame, threshold: float, first_cap: int) -> DataFrame:
    """``greedy_match`` of components of any size.

    Groups without other partners
    are matched at once, row by row. The rest is found in parallel rounds: each unmatched new row asks for its next
    choice, and each group of old rows of one direction keeps the lowest new rows it has room for. A round is one join and one
    ranking; refused rows ask again until none is refused, and the order of asking does not change the result. Choice
    lists start at ``first_cap`` groups and are lengthened, for the rows that used theirs up, until every row is placed or has
    no partner left.
    """
    slots = ranking.in_order(_members(o_rows, o_groups), ["rep"], [F.col("idx")], "place").select(
        F.col("rep").alias("right_rep"), "place", F.col("idx").alias("old_idx"))
    members = cut_lineage(_members(n_rows, n_groups).select(F.col("idx").alias("new_idx"), F.col("rep").alias("left_rep")))
    cap = first_cap
    choices, lists = _choices(n_groups, o_groups, slots, threshold, cap)
    out = ["new_idx", "right_rep", "similarity", "place"]
    done, lone = None, _lone_pairs(choices, lists)
    if lone is not None:
        done = ranking.in_order(members.join(lone, "left_rep"), ["right_rep"], [F.col("new_idx")], "place").filter(
            "place <= upto").select(*out)
        lists = cut_lineage(lists.join(lone, "left_rep", "left_anti"))
    state = members.join(lists, "left_rep").select("new_idx", "left_rep", F.lit(1).cast("bigint").alias("choice"), "cut", "n_choices")
    spent, any_cut = state.limit(0), lone is None
    limited = _shares(choices)
    while True:
        # _asked writes what it numbers, so a round's lineage starts there
        placed = _asked(state.filter("choice <= n_choices").select("new_idx", "left_rep", "choice"), choices, limited)
        if any_cut:
            spent = cut_lineage(spent.unionByName(state.filter("choice > n_choices AND cut")))
        if not placed.filter(F.col("place") > F.col("upto")).isEmpty():
            moved = placed.select("new_idx", "left_rep", (F.col("choice") + F.col("refused").cast("bigint")).alias("choice"))
        elif not any_cut or spent.isEmpty():
            break
        else:
            cap *= 8
            tired = cut_lineage(n_groups.join(spent.select(F.col("left_rep").alias("rep")).distinct(), "rep", "left_semi"))
            longer, long_lists = _choices(tired, o_groups, slots, threshold, cap)
            gone = tired.select(F.col("rep").alias("left_rep"))
            choices = cut_lineage(choices.join(gone, "left_rep", "left_anti").unionByName(longer.select(*choices.columns)))
            lists = cut_lineage(lists.join(gone, "left_rep", "left_anti").unionByName(long_lists.select(*lists.columns)))
            limited = _shares(choices)
            moved = placed.select("new_idx", "left_rep", "choice").unionByName(spent.select("new_idx", "left_rep", "choice"))
            spent = spent.limit(0)
        state = moved.join(lists, "left_rep").select("new_idx", "left_rep", "choice", "cut", "n_choices")
    both = placed.select(*out) if done is None else done.select(*out).unionByName(placed.select(*out))
    return both.join(slots, ["right_rep", "place"]).select("new_idx", "old_idx", "similarity")


def _serial(new_idx: np.ndarray, new_group: np.ndarray, new_unit: np.ndarray, old_rows: list[np.ndarray], old_unit: np.ndarray,
            threshold: float) -> tuple[list[int], list[int], list[float]]:
    """(new idx, old idx, similarity) of one component by the rule itself: ``new_idx`` rises, as do the rows of an old group."""
    out = [], [], []
    taken, first = [0] * len(old_rows), np.array([r[0] for r in old_rows])
    step = max(1, min(256, SCORES // len(old_rows)))
    for at in range(0, len(new_idx), step):
        sims = np.round(new_unit[new_group[at:at + step]] @ old_unit.T, 12)
        sims[~(sims >= threshold)] = -np.inf
        sims[:, [n == len(r) for n, r in zip(taken, old_rows)]] = -np.inf
        for row, idx in zip(sims, new_idx[at:at + step].tolist()):
            top = row[row.argmax()]
            if top == -np.inf:
                continue
            ties = np.flatnonzero(row == top)
            best = int(ties[first[ties].argmin()])
            for held, value in zip(out, (idx, int(first[best]), float(top))):
                held.append(value)
            taken[best] += 1
            if taken[best] < len(old_rows[best]):
                first[best] = old_rows[best][taken[best]]
            else:
                sims[:, best] = -np.inf
    return out


def _match_components(parts: DataFrame, threshold: float) -> DataFrame:
    """Matches of components that a task can hold. ``parts`` (root, side, key, idx, v): a row with ``v`` for each group, old
    ones on side 0, then one with ``idx`` for each of its rows."""
    least = -1 << 63        # stands for a null idx, which goes first

    def matched(batches):
        t = pa.Table.from_batches(batches)
        root, side, idx = (pc.fill_null(t.column(c), least).to_numpy() if c == "idx" else t.column(c).to_numpy() for c in ("root", "side", "idx"))
        v = t.column("v").combine_chunks()
        heads = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
        unit = _unit(vx.matrix(v.take(pa.array(heads))))
        ends = np.append(heads[1:], len(idx))
        starts = np.flatnonzero(np.append(True, root[heads][1:] != root[heads][:-1]))
        new_side = side[heads] == 1
        out = [], [], []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(heads)]):
            mid = lo + int(np.count_nonzero(~new_side[lo:hi]))
            rows = [idx[heads[g] + 1:ends[g]] for g in range(lo, hi)]
            if not lo < mid < hi:
                continue
            if hi - lo == 2:        # most are one group on each side
                top, n = round(float(unit[lo] @ unit[mid]), 12), min(len(rows[0]), len(rows[1]))
                found = (rows[1][:n].tolist(), rows[0][:n].tolist(), [top] * n) if top >= threshold else out[:0]
            else:
                named = np.concatenate(rows[mid - lo:])
                group = np.repeat(np.arange(hi - mid), [len(r) for r in rows[mid - lo:]])
                order = np.lexsort((group, named))
                found = _serial(named[order], group[order], unit[mid:hi], rows[:mid - lo], unit[lo:mid], threshold)
            for held, values in zip(out, found):
                held.extend(values)
        named = [pa.array(x, pa.int64(), mask=np.array(x, np.int64) == least) for x in out[:2]]
        return pa.RecordBatch.from_arrays([*named, pa.array(out[2], pa.float64())], names=["new_idx", "old_idx", "similarity"])

    def work(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            root = batch.column("root").to_numpy()
            if held and held[0].column("root")[0].as_py() == root[-1]:
                held.append(batch)
                continue
            cut = int(np.searchsorted(root, root[-1]))
            if held or cut:
                yield matched([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        if held:
            yield matched(held)

    order = ["root", "side", "key", F.col("v").isNull(), "idx"]
    return parts.repartition("root").sortWithinPartitions(*order).mapInArrow(work, "new_idx bigint, old_idx bigint, similarity double")


def greedy_match(old: DataFrame, new: DataFrame, threshold: float, first_cap: int = 16) -> DataFrame:
    """(new_idx, old_idx, similarity): in new order, each row takes its best old row still free, the lowest old idx on ties.

    Rows that no chain of similar pairs connects do not compete. So the similarity join only tells the components, and a
    task carries out the rule in each of those it holds, with their vectors. A component beyond ``MATCH_ROWS`` rows or
    ``MATCH_WORK`` is matched in rounds (``_match_in_rounds``): the rule is the stable matching in which every old row prefers the lowest
    new idx. Rows with a null vector have no partner. Similarities are compared at 12 decimals. All but the last step runs when
    this is called.
    """
    (o_rows, o_groups), (n_rows, n_groups) = _directed(old), _directed(new)
    links = similar_pairs(n_groups, o_groups, threshold, inclusive=True, links=True)

    def node(side: int, rep: str):
        return F.xxhash64(F.lit(side), F.col(rep).cast("bigint"))

    nodes = components(links.select(node(1, "left_rep").alias("a"), node(0, "right_rep").alias("b")), few=FEW_EDGES)
    sides = [(rows, cut_lineage(groups.withColumn("node", node(side, "rep")).join(nodes, "node").select("root", "key", "n", "v")))
             for side, (rows, groups) in enumerate(((o_rows, o_groups), (n_rows, n_groups)))]
    (_, o_at), (_, n_at) = sides
    count = [F.sum("n").alias("rows"), F.count("*").alias("groups"), F.max(F.size("v")).alias("dim")]
    sizes = o_at.groupBy("root").agg(*count).join(n_at.groupBy("root").agg(*[c for c in count[:2]]).toDF("root", "new_rows", "new_groups"), "root")
    large = cut_lineage(sizes.filter(
        (F.col("rows") + F.col("new_rows") > MATCH_ROWS) | ((F.col("groups") + F.col("new_groups")) * F.col("dim") > NUMBERS)
        | (F.col("new_rows").cast("double") * F.col("groups") * F.col("dim") > MATCH_WORK)).select("root"))
    parts = None
    for side, (rows, groups) in enumerate(sides):
        held = groups.join(large, "root", "left_anti")
        for df in (held.select("root", "key", F.lit(None).cast("bigint").alias("idx"), vx.doubles("v").alias("v")),
                   rows.select("idx", "key").join(held.select("key", "root"), "key").select(
                       "root", "key", F.col("idx").cast("bigint").alias("idx"), F.lit(None).cast("array<double>").alias("v"))):
            df = df.withColumn("side", F.lit(side))
            parts = df if parts is None else parts.unionByName(df)
    found = _match_components(parts, threshold)
    if large.isEmpty():
        return found
    o_large, n_large = (groups.join(at.join(large, "root", "left_semi"), "key", "left_semi") for groups, at in ((o_groups, o_at), (n_groups, n_at)))
    return found.unionByName(_match_in_rounds(o_rows, cut_lineage(o_large), n_rows, cut_lineage(n_large), threshold, first_cap))
