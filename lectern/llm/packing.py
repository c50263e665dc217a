"""Best-fit packing of documents into sequences of bounded length, by linear grouping.

1. A document longer than a sequence is cut into full pieces; only its first piece may be shorter.
2. Large pieces are ranked by length and grouped so that groups hold equally many pieces; a length
   counts as the largest of its group. The few group lengths make a cutting-stock problem whose
   configurations (how many pieces of each group share a sequence) come from column generation.
3. Real pieces take the slots of their group; slots the rounding down of the solution left out join
   the small pieces.
4. The rest go, longest first, where they leave the least room, and open sequences as needed.

Lengths are integers up to the sequence length, so steps 2 and 4 need only counts per length, of
which there are at most ``capacity``, whatever the number of documents. The driver solves these counts;
pieces are numbered within their length and matched to slots by joins.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .chunk_encoder import encoder
from .common import per_batch, slices

CAPACITY = 1024
END_ID = 2
GROUPS = 64
CELL = 5000
LARGE = 0.125
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: its ids by the tokenizer, then ``end_id``, cut at ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def work(batch):
        coder = encoder(path)
        for part in slices(batch, "text"):
            out = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            ids = coder.encode([t or "" for t in part.column("text").to_pylist()])
            for doc, raw in zip(part.column("doc_id").to_pylist(), ids):
                raw += end
                n = len(raw) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(raw[4 * a:4 * b]))
            yield out

    return per_batch(docs.select("doc_id", "text"), PIECES, work)


# -- on counts per length -----------------------------------------------------------------------


def group_lengths(counts: np.ndarray, groups: int) -> list[tuple[int, int]]:
    """Cut the lengths that occur into at most ``groups`` runs (low, high) of about equal counts."""
    present = np.flatnonzero(counts)
    if not len(present):
        return []
    upto = np.cumsum(counts[present])
    share = np.minimum((upto - counts[present] // 2 - 1).clip(0) * groups // upto[-1], groups - 1)
    edges = np.flatnonzero(np.diff(share)) + 1
    return [(int(run[0]), int(run[-1])) for run in np.split(present, edges)]


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable set of group lengths that fits one sequence."""
    value = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = sizes <= room
        gain = np.where(fits, worth + value[np.where(fits, room - sizes, 0)], -1.0)
        k = int(np.argmax(gain))
        value[room] = value[room - 1]
        if gain[k] > value[room] + 1e-12:
            value[room], took[room] = gain[k], k
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= int(sizes[took[room]])
    return float(value[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int,
                   rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Column generation for the cutting-stock problem; multiplicities are rounded down."""
    m = len(sizes)
    columns = [np.eye(m, dtype=np.int64)[i] * (capacity // int(sizes[i])) for i in range(m)]
    basis = np.array(columns, float).T
    inverse = np.linalg.inv(basis)
    level = inverse @ demand
    for step in range(rounds):
        prices = inverse.sum(axis=0)
        value, pattern = best_configuration(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        move = inverse @ pattern
        able = move > 1e-9
        ratio = np.where(able, level / np.where(able, move, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[out] = pattern
        basis[:, out] = pattern
        if step % 64 == 63:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / move[out]
            inverse = inverse - np.outer(move, row)
            inverse[out] = row
        level = np.maximum(inverse @ demand, 0)
    return [(c, int(x + 1e-7)) for c, x in zip(columns, level) if x + 1e-7 >= 1]


def best_fit(rest: np.ndarray, rooms: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """Longest first into the sequence with the least sufficient room, on counts alone.

    ``rooms[g]`` sequences have room g. Returns runs (room class at first, first number in that
    class, sequences, length): one piece of that length to each of these sequences; class -1 holds
    sequences opened here. A run of sequences treated alike is split only where a length runs out,
    so there are at most about ``capacity`` squared runs, whatever the counts.
    """
    free: dict[int, list[tuple[int, int, int]]] = {}
    for g in np.flatnonzero(rooms).tolist():
        free[g] = [(g, 0, int(rooms[g]))]
    opened, moves = 0, []
    for size in np.flatnonzero(rest).tolist()[::-1]:
        left = int(rest[size])
        while left:
            room = next((g for g in range(size, capacity + 1) if free.get(g)), None)
            if room is None:
                lots = -(-left // (capacity // size))
                free[capacity] = [(-1, opened, lots)]
                opened += lots
                room = capacity
            origin, at, many = free[room].pop()
            if many > left:
                free[room].append((origin, at + left, many - left))
                many = left
            moves.append((origin, at, many, size))
            free.setdefault(room - size, []).append((origin, at, many))
            left -= many
    return moves


# -- on rows ------------------------------------------------------------------------------------


def numbered(rows: DataFrame, key: str, order: list[str], out: str, largest: int) -> DataFrame:
    """0-based number of each row within ``key``, which may hold most rows: a key is cut by hash
    into cells of about ``CELL`` rows where it has ``largest``, cells are numbered one by one, and a small table
    carries their starts."""
    cell = F.pmod(F.xxhash64(*order), F.lit(largest // CELL + 1)).cast("int")
    held = rows.withColumn("_cell", cell)
    sizes = held.groupBy(key, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(key, "_cell").orderBy(*order)
    return held.withColumn("_at", F.row_number().over(inside) - 1).join(starts, [key, "_cell"]).withColumn(
        out, F.col("_from") + F.col("_at")).drop("_cell", "_at", "_from")


def _table(df: DataFrame, schema: str, rows: list[tuple]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    cols = {n: [r[i] for r in rows] for i, n in enumerate(names)}
    frame = pa.table({n: pa.array(v, pa.int64()) for n, v in cols.items()})
    return df.sparkSession.createDataFrame(frame)


def _rooms_of_plan(big: np.ndarray, runs: list[tuple[int, int]], slots: list[tuple], base: int, capacity: int) -> np.ndarray:
    """How many of the sequences of a plan have each room, from counts alone.

    Sequence s of a configuration holds the pieces ranked lo + s, lo + s + times, ... of each of its groups, so its room changes
    only where a length runs out; these places are few, whatever the counts.
    """
    lengths = [np.arange(hi, lo - 1, -1) for lo, hi in runs]
    ends = [np.cumsum(big[lo:hi + 1][::-1]) for lo, hi in runs]
    rooms, blocks = np.zeros(capacity + 1, np.int64), {}
    for g, lo, hi, at, times in slots:
        blocks.setdefault((at, times), []).append((g, lo, hi))
    for (_, times), parts in blocks.items():
        rows = [(g, begin, min(begin + times, hi)) for g, lo, hi in parts for begin in range(lo, hi, times)]
        cuts = np.unique(np.concatenate([[0, times], *[np.concatenate([ends[g] - begin, [end - begin]]) for g, begin, end in rows]]))
        cuts = cuts[(cuts >= 0) & (cuts <= times)]
        used, first = np.zeros(len(cuts) - 1, np.int64), cuts[:-1]
        for g, begin, end in rows:
            held = first < end - begin
            used[held] += lengths[g][np.searchsorted(ends[g], begin + first[held], side="right")]
        np.add.at(rooms, capacity - used, np.diff(cuts))
    return rooms


def plan(counts: np.ndarray, capacity: int, groups: int, large: float) -> tuple[list, list, int, int]:
    """Groups (low, high), slots (group, first rank, end rank, first sequence, sequences), how many sequences these take, and how
    many all pieces take with what best fit opens."""
    big = counts.copy()
    big[:int(capacity * large) + 1] = 0
    big[capacity] = 0
    runs = group_lengths(big, groups) if groups else []
    sizes = np.array([hi for _, hi in runs], np.int64)
    demand = np.array([int(big[lo:hi + 1].sum()) for lo, hi in runs], float)
    found = configurations(sizes, demand, capacity) if len(runs) else []
    # within a group, longest pieces first; config c repeats x times from sequence `base`
    slots, taken, base = [], np.zeros(len(runs), np.int64), 0
    for pattern, times in found:
        for g in np.flatnonzero(pattern).tolist():
            many = int(min(int(pattern[g]) * times, int(demand[g]) - taken[g]))
            if many > 0:
                slots.append((g, int(taken[g]), int(taken[g]) + many, base, times))
                taken[g] += many
        base += times
    rest = counts.copy()
    rest[capacity] = 0
    for g, (lo, hi) in enumerate(runs):
        left = int(taken[g])
        for n in range(hi, lo - 1, -1):
            gone = min(left, int(rest[n]))
            rest[n] -= gone
            left -= gone
    rooms = _rooms_of_plan(big, runs, slots, base, capacity)
    rooms[0] = 0
    # a run may open more sequences than it fills at once: what a later run then finds is room, so openings are counted by number
    opened = max((at + many for origin, at, many, _ in best_fit(rest, rooms, capacity) if origin < 0), default=0)
    return runs, slots, base, int(counts[capacity]) + base + opened


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Every row of ``pieces`` is placed once; lengths are 1 to ``capacity``. Rows with equal doc_id
    and piece are separate pieces, and equal rows are spread like others. The plan is made on counts per length: with
    ``groups`` groups and by best fit alone; the one with fewer sequences is carried out, the grouped one on ties. An empty table gives an empty result. Broadcast tables hold at most one row per configuration and slot,
    bounded by ``groups`` and ``capacity``. Jobs run when this is called.
    """
    given = pieces.columns
    pieces = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    runs, slots, base, _ = min((plan(counts, capacity, g, large) for g in (groups, 0)), key=lambda p: p[3])
    big = counts.copy()
    big[:int(capacity * large) + 1] = 0
    big[capacity] = 0
    order = ["length", "doc_id", "piece", "start", "ids_crc32", "_row"]

    group_of = np.full(capacity + 1, -1, np.int64)
    rank_from = np.zeros(capacity + 1, np.int64)
    for g, (lo, hi) in enumerate(runs):
        group_of[lo:hi + 1] = g
        down = big[lo:hi + 1][::-1]
        rank_from[lo:hi + 1] = (np.cumsum(down) - down)[::-1]
    places = _table(pieces, "length, _group, _rank_from",
                    [(n, int(group_of[n]), int(rank_from[n])) for n in range(1, capacity + 1)])
    ranked = numbered(pieces, "length", order[1:], "_no", int(counts.max())).join(F.broadcast(places), "length").withColumn(
        "_rank", F.when(F.col("_group") >= 0, F.col("_rank_from") + F.col("_no")))
    full = F.col("length") == capacity
    slot_rows = _table(pieces, "_g, _lo, _hi, _base, _times", slots)
    held = materialize(ranked.join(
        F.broadcast(slot_rows), (F.col("_group") == F.col("_g")) & (F.col("_rank") >= F.col("_lo"))
        & (F.col("_rank") < F.col("_hi")), "left").withColumn(
        "sequence_id", F.when(full, F.col("_no")).when(
            F.col("_g").isNotNull(), F.lit(int(counts[capacity])) + F.col("_base")
            + (F.col("_rank") - F.col("_lo")) % F.col("_times"))).select(*pieces.columns, "_rank", "sequence_id"), "slots")

    placed = held.filter("sequence_id IS NOT NULL")
    rooms_of = placed.filter(~full).groupBy("sequence_id").agg(
        (F.lit(capacity) - F.sum("length")).cast("long").alias("_room"))
    rooms = np.zeros(capacity + 1, np.int64)
    for r in rooms_of.groupBy("_room").count().collect():  # at most ``capacity`` rows
        rooms[r["_room"]] = r["count"]
    loose = held.filter("sequence_id IS NULL").drop("sequence_id", "_rank")
    rest = np.zeros(capacity + 1, np.int64)
    for r in loose.groupBy("length").count().collect():
        rest[r["length"]] = r["count"]
    rooms[0] = 0
    moves, seen, targets = best_fit(rest, rooms, capacity), np.zeros(capacity + 1, np.int64), []
    for origin, at, many, size in moves:
        targets.append((size, int(seen[size]), int(seen[size]) + many, origin, at))
        seen[size] += many
    opened_from = int(counts[capacity]) + base
    target_rows = _table(pieces, "_size, _lo, _hi, _origin, _at", targets)
    aimed = numbered(loose, "length", order[1:], "_no", int(rest.max())).join(
        F.broadcast(target_rows), (F.col("length") == F.col("_size")) & (F.col("_no") >= F.col("_lo"))
        & (F.col("_no") < F.col("_hi"))).withColumn("_spot", F.col("_at") + F.col("_no") - F.col("_lo"))
    new = aimed.filter("_origin < 0").withColumn("sequence_id", F.lit(opened_from) + F.col("_spot"))
    numbers = numbered(rooms_of.filter("_room > 0"), "_room", ["sequence_id"], "_spot", int(rooms.max())).withColumnRenamed("_room", "_origin")
    filled = aimed.filter("_origin >= 0").join(numbers, ["_origin", "_spot"])
    columns = [*pieces.columns, "sequence_id"]   # with _row, which settles the order of equal rows
    every = placed.select(*columns).unionByName(new.select(*columns)).unionByName(filled.select(*columns))
    line = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order[1:]).rowsBetween(
        Window.unboundedPreceding, 0)
    return every.withColumn("offset", (F.sum("length").over(line) - F.col("length")).cast("long")).select(
        *given, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a piece of one end id; a null doc_id stays null and is packed. A text
    of any length is cut into pieces; equal texts and equal lengths are separate pieces. Other columns are not read.
    Jobs run when this is called: lengths must be counted before they can be packed.
    """
    return pack(token_pieces(docs, path, capacity, end_id), capacity).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
