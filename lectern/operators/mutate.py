"""Changes to a passage table, as rows to append: new passages, a tombstone log, successions.

Nothing is rewritten in place. The log is (idx, op, ts) with op ``delete`` or ``restore``; the
latest entry of an idx wins, so replaying a change is harmless.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flags as fl
from ..session import cut_lineage
from ..sources.corpus_io import IDX_BLOCK
from . import filters, ranking


def append(passages: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """New rows numbered from max(idx) + 1 in ``order``; a blank text is an error."""
    top = passages.agg(F.coalesce(F.max("idx"), F.lit(-1))).scalar()
    numbered = ranking.row_number(rows, [], order, "_n").withColumn("_top", top)
    checked = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.raise_error(F.lit("blank passage")).cast("string")
                     ).otherwise(F.col("text"))
    keep = [c for c in rows.columns if c != "text"]
    return numbered.select((F.col("_top") + F.col("_n")).alias("idx"), checked.alias("text"), *keep)


def apply_log(passages: DataFrame, log: DataFrame) -> DataFrame:
    """Current tombstones: the latest entry per idx, else what the table says."""
    latest = log.groupBy("idx").agg(F.max_by("op", F.struct("ts", "op")).alias("op"))
    joined = passages.join(latest, "idx", "left")
    now = F.coalesce(F.col("op") == "delete", F.col("tombstone"))
    return joined.withColumn("tombstone", now).drop("op")


def deletions(ids: DataFrame, ts, op: str = "delete") -> DataFrame:
    return ids.select("idx", F.lit(op).alias("op"), ts.alias("ts"))


def list_deleted(passages: DataFrame, log: DataFrame) -> DataFrame:
    return apply_log(passages, log).filter("tombstone").select("idx", "source")


def delete_source(passages: DataFrame, source: str, ts) -> DataFrame:
    """Log entries that tombstone every live passage of a source."""
    return deletions(filters.live(passages).filter(F.col("source") == source), ts)


def edit(passages: DataFrame, edits: DataFrame, ts) -> dict[str, DataFrame]:
    """``edits`` (idx, new_text) -> appended passages, successions and tombstones. A blank or null text, one that
    changes nothing but white space at its ends, and an idx that is not in the corpus are errors."""
    known = passages.select("idx", F.col("text").alias("old_text"), "source", F.lit(True).alias("_known"))
    both = edits.join(known, "idx", "left")
    new, old = (F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "") for c in ("new_text", "old_text"))
    problem = F.when(F.col("_known").isNull(), "unknown passage").when(new == "", "blank passage").when(
        new == old, "unchanged passage")
    sure = F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).isNull()
    rows = both.filter(sure).select(F.col("idx").alias("old_idx"), F.col("new_text").alias("text"), "source", "old_text")
    added = append(passages, rows, "old_idx")
    succession = added.select(filters.content_key(F.col("old_text")).alias("old_key"), filters.content_key(F.col("text")).alias("new_key"),
                              "old_idx", F.col("idx").alias("new_idx"))
    return {"appended": added.select("idx", "text", "source"), "succession": succession,
            "log": deletions(added.select(F.col("old_idx").alias("idx")), ts)}


def resolve_succession(keys: DataFrame, succession: DataFrame) -> DataFrame:
    """(key) -> (key, current): follow old -> new to its end.

    Each round joins the map with itself, so a chain of n edits takes log2 n rounds. A key whose
    chain never ends is in, or leads to, a cycle (an edit taken back) and stays as it is.
    """
    links = cut_lineage(succession.groupBy("old_key").agg(F.max_by("new_key", F.struct("ts", "new_key")).alias("new_key")))
    rounds = max(1, math.ceil(math.log2(links.count() + 1)) + 1)
    jump = links
    for _ in range(rounds):
        onward = jump.select(F.col("old_key").alias("new_key"), F.col("new_key").alias("next_key"))
        step = jump.join(onward, "new_key", "left")
        jump = cut_lineage(step.select("old_key", F.coalesce("next_key", "new_key").alias("new_key"),
                                       F.col("next_key").isNotNull().alias("moved")))
        if jump.filter("moved").isEmpty():
            break
        jump = jump.drop("moved")
    ends = jump.select("old_key", "new_key").join(links.select(F.col("old_key").alias("new_key")), "new_key", "left_anti")
    return keys.join(ends.withColumnRenamed("old_key", "key"), "key", "left").select(
        "key", F.coalesce("new_key", "key").alias("current"))


def disjoint_ranges(changes: DataFrame) -> DataFrame:
    """(lo, hi, mask) in which no two ranges overlap, from ranges (lo, hi, mask, seq) of which the highest seq counts.

    The sorted boundaries are numbered; a range then covers a run of elementary pieces, which is made of at most two nodes a level of
    the binary tree over these numbers. A node keeps its highest seq, and a piece takes the highest of its ancestors, one a level.
    So the work grows with the number of ranges and its logarithm, however they overlap. Pieces that no range covers have a
    null mask.
    """
    ends = cut_lineage(changes.select(F.col("lo").alias("at")).union(changes.select("hi")).distinct())
    bounds = cut_lineage(ranking.in_order(ends, [], [F.col("at")], "_n").select("at", (F.col("_n") - 1).alias("i")))
    levels = max(bounds.count() - 1, 1).bit_length()
    first, last = bounds.toDF("lo", "a"), bounds.toDF("hi", "b")
    every_level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    runs = changes.join(first, "lo").join(last, "hi").select("mask", "seq", "a", "b", every_level).select(
        "mask", "seq", "level", F.expr("shiftright(a + shiftleft(1L, level) - 1, level)").alias("a"), F.expr("shiftright(b, level)").alias("b")).filter("a < b")
    taken = F.filter(F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1)), lambda x: x.isNotNull())
    best = F.max_by(F.struct("mask", "seq"), "seq").alias("m")
    nodes = runs.select("level", F.explode(taken).alias("node"), "mask", "seq").groupBy("level", "node").agg(best).select("level", "node", "m.mask", "m.seq")
    pieces = bounds.join(bounds.select((F.col("i") - 1).alias("i"), F.col("at").alias("hi")), "i").withColumnRenamed("at", "lo")
    held = pieces.select("i", every_level).select("i", "level", F.expr("shiftright(i, level)").alias("node")).join(nodes, ["level", "node"]).groupBy(
        "i").agg(F.max_by("mask", "seq").alias("mask"))
    return pieces.join(held, "i", "left").select("lo", "hi", "mask")


def set_perms(passages: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (lo, hi, mask, seq) to the rows with lo <= idx < hi, the highest seq winning. A null lo is the start of the
    corpus, a null hi its end.

    Overlapping ranges become disjoint ones first. These and the passages are sorted together within blocks of ids, and a passage
    takes the mask of the last range that begins at or before it. A range that leaves the table is an error.
    """
    top = passages.agg(F.coalesce(F.max("idx"), F.lit(-1))).scalar()
    checked = changes.withColumn("_top", top).withColumn("lo", F.coalesce("lo", F.lit(0)).cast("bigint")).withColumn(
        "hi", F.coalesce("hi", F.col("_top") + 1).cast("bigint"))
    sound = (F.col("lo") >= 0) & (F.col("hi") <= F.col("_top") + 1) & (F.col("hi") >= F.col("lo"))
    sure = F.assert_true(F.coalesce(sound, F.lit(False)), F.lit("range outside the corpus")).isNull()
    spans = disjoint_ranges(cut_lineage(checked.filter(sure).select("lo", "hi", "seq", "mask").filter("hi > lo")))
    # a disjoint range begins again in every block it reaches; the last one's end is marked too
    ends = spans.agg(F.max("hi").alias("lo")).filter("lo IS NOT NULL").select("lo", (F.col("lo") + 1).alias("hi"), F.lit(None).cast(
        spans.schema["mask"].dataType).alias("mask"))
    begins = spans.unionByName(ends).withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("lo") / IDX_BLOCK), F.floor((F.col("hi") - 1) / IDX_BLOCK)))).select(
        F.greatest(F.col("lo"), F.col("_b") * IDX_BLOCK).alias("idx"), "_b", F.struct("mask").alias("_set"), F.lit(0).alias("_row"))
    rows = passages.withColumn("_b", F.floor(F.col("idx") / IDX_BLOCK)).withColumn("_row", F.lit(1))
    so_far = Window.partitionBy("_b").orderBy("idx", "_row").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.unionByName(begins, allowMissingColumns=True).withColumn("_mask", F.last("_set", ignorenulls=True).over(so_far)["mask"])
    return swept.filter("_row = 1").withColumn("perms", F.coalesce("_mask", "perms")).select(*passages.columns)


def id_ranges(spec: str) -> list[tuple[int | None, int | None]]:
    """Half-open ranges of a list such as ``5,12-15,42,100:`` in which a missing end is the end of the corpus."""
    out: list[tuple[int | None, int | None]] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        lo, mark, hi = part.partition(":" if ":" in part else "-")
        out.append((int(lo) if lo else None, int(hi) if hi else None) if mark else range_of(int(lo)))
    return out


def range_of(idx: int) -> tuple[int, int]:
    """A single id as a half-open range."""
    return idx, idx + 1


# -- statement-like forms ---------------------------------------------------------------------------

def insert_into(passages: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """INSERT: passages with the new rows, live and untagged unless given."""
    return passages.unionByName(append(passages, rows, order), allowMissingColumns=True)


def update_tags(passages: DataFrame, where, tags) -> DataFrame:
    """UPDATE ... SET tags."""
    return passages.withColumn("tags", F.when(where, F.array(*[F.lit(t) for t in tags])).otherwise(F.col("tags")))


def delete_where(passages: DataFrame, where) -> DataFrame:
    """DELETE: tombstones, does not remove."""
    return passages.withColumn("tombstone", F.col("tombstone") | F.coalesce(where, F.lit(False)))


def writable_only(passages: DataFrame) -> DataFrame:
    return passages.filter(fl.can_write_bits(F.col("perms")))
