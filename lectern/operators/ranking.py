"""Per-key ranking, running sums and neighbours that stay parallel on a hot key.

A plain window over a key that holds a third of all rows is one task. Here rows are dealt into sorted ranges of key and
order that hold about equally many; a task numbers and sums its range as it streams by, and one row a range
carries the totals of a key that runs on into the next (``in_order``). Neighbours use ranges of the ordering column instead.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..session import materialize

STEPS = 32
SALTS = 64


def _as_number(order: str, df: DataFrame) -> Column:
    kind = df.schema[order].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        whole = F.col(order).cast("timestamp_ntz") if kind == "timestamp" else F.col(order)
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), whole)
    if kind == "date":
        return F.unix_date(order).cast("bigint")
    return F.col(order).cast("bigint")


def with_range(df: DataFrame, order: str, steps: int = STEPS) -> DataFrame:
    """Adds ``_range``: which of ``steps`` squared quantile ranges ``order`` falls into; nulls go first.

    The cuts are approximate percentiles of the column alone. A row finds its range in two steps over
    ``steps`` cuts each.
    """
    at = _as_number(order, df)
    shares = [i / steps ** 2 for i in range(1, steps ** 2)]
    cuts = df.select(at.alias("_at")).agg(F.percentile_approx("_at", shares, 20 * steps ** 2).alias("cuts")).select(
        F.coalesce("cuts", F.array().cast("array<bigint>"))).scalar()
    spots = df.withColumn("_cuts", cuts).withColumn("_at", at).withColumn("_coarse", F.coalesce(F.size(F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(steps - 1)), lambda i: F.get("_cuts", i * steps - 1)),
        lambda c: c < F.col("_at"))), F.lit(0)))
    fine = F.size(F.filter(F.slice("_cuts", F.col("_coarse") * steps + 1, steps - 1), lambda c: c < F.col("_at")))
    return spots.withColumn("_range", F.col("_coarse") * steps + F.coalesce(fine, F.lit(0))).drop("_cuts", "_at", "_coarse")


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join that also matches null keys; keeps the left copy of the key columns."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    test = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, test, how).drop(*[f"_r_{c}" for c in on])


def in_order(df: DataFrame, keys: list[str], order: list[Column], out: str, sums: dict[str, str] | None = None,
             xors: dict[str, str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds ``out``, the 1-based position of a row within its keys by ``order``, and running totals up to and with the row.

    ``sums`` and ``xors`` map output names to whole-number columns; nulls count as 0. Rows are dealt into sorted ranges of
    (keys, order), so a key of any size lies over several tasks. A task numbers its range as the rows stream by, and
    its last row says what the key that runs on into the next range has had so far: one row a range is all that is
    summed over. ``ranges`` is the number of tasks, by default the session's number of shuffle partitions. The numbered ranges are
    written below ``spark.checkpoint.dir`` when this is called. Equal rows may take each other's place.
    """
    sums, xors = sums or {}, xors or {}
    by = [*[F.col(c) for c in keys], *order]
    ranged = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    kinds = StructType([*df.schema.fields, *[StructField(c, LongType()) for c in ("_n", *sums, *xors)],
                        StructField("_part", IntegerType()), StructField("_last", BooleanType())])
    held = materialize(ranged.sortWithinPartitions(*by).mapInArrow(_numbering(keys, sums, xors), kinds), "in-order")
    across, upto = Window.orderBy("_part"), Window.partitionBy(*keys).orderBy("_part")
    carried = held.filter("_last").select(  # one row a range
        *keys, F.lead("_part").over(across).alias("_into"), F.sum("_n").over(upto).alias("_c__n"),
        *[F.sum(o).over(upto).alias(f"_c_{o}") for o in sums], *[F.bit_xor(o).over(upto).alias(f"_c_{o}") for o in xors])
    joined = _null_safe(held.withColumn("_into", F.col("_part")), F.broadcast(carried), [*keys, "_into"], "left")

    def with_carry(c: str) -> Column:
        return F.col(c) + F.coalesce(f"_c_{c}", F.lit(0))

    return joined.select(*df.columns, with_carry("_n").alias(out), *[with_carry(o).alias(o) for o in sums],
                         *[F.col(o).bitwiseXOR(F.coalesce(f"_c_{o}", F.lit(0))).alias(o) for o in xors])


def _numbering(keys: list[str], sums: dict[str, str], xors: dict[str, str]):
    """Numbers the sorted rows of a task within runs of equal keys, batch by batch."""
    def totals(values: np.ndarray, begins: np.ndarray, run: np.ndarray, held: int, kind: np.ufunc, undo: np.ufunc) -> np.ndarray:
        whole = kind.accumulate(values)
        before = np.concatenate([[0], whole])[begins]
        before[0] = undo(np.int64(0), np.int64(held))      # the first run goes on from the batch before
        return undo(whole, before[run])

    def work(batches):
        from pyspark import TaskContext

        part, at, late = TaskContext.get().partitionId(), None, None
        carry: dict[str, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            new = np.zeros(n, bool)
            new[0] = True
            for c in keys:
                column = batch.column(c)
                a, b = column.slice(1), column.slice(0, n - 1)
                same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (
                    pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))
                new[1:] |= ~same
            begins = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            first = [batch.column(c)[0].as_py() for c in keys]
            if at is None or first != at:
                carry = {}
            at = [batch.column(c)[n - 1].as_py() for c in keys]
            got = {"_n": totals(np.ones(n, np.int64), begins, run, carry.get("_n", 0), np.add, np.subtract)}
            for named, kind, undo in ((sums, np.add, np.subtract), (xors, np.bitwise_xor, np.bitwise_xor)):
                for o, c in named.items():
                    values = pc.fill_null(batch.column(c), 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
                    got[o] = totals(values, begins, run, carry.get(o, 0), kind, undo)
            carry = {o: int(v[-1]) for o, v in got.items()}
            columns = [*batch.columns, *[pa.array(v) for v in got.values()], pa.array(np.full(n, part, np.int32))]
            names = [*batch.schema.names, *got, "_part", "_last"]
            if late:
                yield pa.RecordBatch.from_arrays([*late[0], pa.array(np.zeros(late[1], bool))], names)
            late = columns, n
        if late:
            last = np.zeros(late[1], bool)
            last[-1] = True
            yield pa.RecordBatch.from_arrays([*late[0], pa.array(last)], names)

    return work


def row_number(df: DataFrame, keys: list[str], order: str, out: str = "rn", desc: bool = False) -> DataFrame:
    """1-based position of each row within its keys, by a unique column."""
    return in_order(df, keys, [F.desc(order) if desc else F.asc(order)], out, ranges=_ranges(df))


def running_before(df: DataFrame, keys: list[str], order: str, tie: str, sums: dict[str, str]) -> DataFrame:
    """Sums of earlier rows of the same keys: ``sums`` maps an output name to a whole-number column.

    ``order`` need not be unique; ``tie`` settles equal values.
    """
    done = in_order(df, keys, [F.asc(order), F.asc(tie)], "_rn", {f"_upto_{o}": c for o, c in sums.items()}, ranges=_ranges(df))
    return done.select(*df.columns, *[(F.col(f"_upto_{o}") - F.coalesce(c, F.lit(0))).cast("bigint").alias(o) for o, c in sums.items()])


def _ranges(df: DataFrame) -> int | None:
    """One range for each input file where there are more of them than shuffle partitions, so that tasks grow with the input."""
    files = len(df.inputFiles())
    return files if files > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def neighbours(df: DataFrame, keys: list[str], order: str, prev: str = "prev", nxt: str = "next") -> DataFrame:
    """Previous and next value of a unique ``order`` column within the keys."""
    ranged = with_range(df, order)
    spot = [*keys, "_range"]
    edges = ranged.groupBy(*spot).agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_range")
    edges = edges.select(*spot, F.lag("_last").over(across).alias("_prev"),
                         F.lead("_first").over(across).alias("_next"))
    inside = Window.partitionBy(*spot).orderBy(order)
    local = ranged.withColumn(prev, F.lag(order).over(inside)).withColumn(nxt, F.lead(order).over(inside))
    joined = _null_safe(local, edges, spot, "inner")
    return joined.withColumn(prev, F.coalesce(prev, "_prev")).withColumn(
        nxt, F.coalesce(nxt, "_next")).drop("_range", "_prev", "_next")


def top_per_key(df: DataFrame, keys: list[str], k: int, order: list[Column], salt_on: str,
                out: str = "rank") -> DataFrame:
    """First k rows per key: k per salt first, so a hot key never meets in one task whole."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(SALTS)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    few = salted.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k).drop("_rn", "_salt")
    last = Window.partitionBy(*keys).orderBy(*order)
    return few.withColumn(out, F.row_number().over(last)).filter(F.col(out) <= k)
