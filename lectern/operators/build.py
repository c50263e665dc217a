"""Building a corpus: chunking, labels, links, table clean-up.

Chunk boundaries depend on the chunk before, so a document is cut by a small function over its
word or whitespace positions, in Arrow batches; documents are independent and nothing shuffles.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage
from . import corpus as cp


SPACES = re.compile(r"\s*")
TEXTS = 256


def line_chunks(text: str, size: int = 300, overlap: int = 50) -> list[str]:
    """Chunks of whole lines within ``size`` words; each begins with at least ``overlap`` words of
    the one before where whole lines allow, and always moves on by a line."""
    rows = text.split("\n")
    words = np.concatenate([[0], np.cumsum([len(r.split()) for r in rows])])
    if words[-1] <= size:
        return [text]
    last, at, out = len(rows), 0, []
    while True:
        end = int(np.searchsorted(words, words[at] + size, side="right")) - 1
        if words[end] == words[at]:
            end += 1          # an oversize line is taken whole
        end = min(max(end, at + 1), last)
        piece = "\n".join(rows[at:end]).strip()
        if piece:
            out.append(piece)
        if end >= last:
            return out
        back = int(np.searchsorted(words, words[end] - overlap, side="right")) - 1
        at = max(at + 1, min(back, end))


def char_chunks(text: str, limit: int = 6000) -> list[str]:
    """Pieces of at most ``limit`` characters, cut at the last space in the window's second half."""
    if len(text) <= limit:
        return [text]
    spaces = np.array([m.start() for m in re.finditer(r"\s", text)] or [-1])
    out, at = [], 0
    while len(text) - at > limit:
        cut = int(spaces[max(np.searchsorted(spaces, at + limit, side="right") - 1, 0)])
        if cut <= at + limit // 2 or cut > at + limit:
            cut = at + limit
        out.append(text[at:cut].strip())
        at = SPACES.match(text, cut).end()
    out.append(text[at:].strip())
    return [p for p in out if p]


def chunks(text: Column, size: int = 300, overlap: int = 50, limit: int | None = None) -> Column:
    """array<string> of a document's chunks: by lines, then by characters where given."""

    @F.arrow_udf("array<string>")
    def cut(a: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        done = [pa.array([], kind)]
        for at in range(0, len(a), TEXTS):     # few texts at a time are Python strings
            held = []
            for t in a.slice(at, TEXTS).to_pylist():
                parts = [] if t is None else line_chunks(t, size, overlap)
                if limit is not None:
                    parts = [q for p in parts for q in char_chunks(p, limit)]
                held.append(parts)
            done.append(pa.array(held, kind))
        return pa.concat_arrays(done)

    return cut(text)


def chunk_documents(df: DataFrame, size: int = 300, overlap: int = 50, limit: int | None = None) -> DataFrame:
    """One row per chunk: the columns of ``df`` with ``part`` and the chunk's ``text``."""
    keep = [c for c in df.columns if c != "text"]
    return df.select(*keep, F.posexplode(chunks(F.col("text"), size, overlap, limit)).alias("part", "text"))


def build_corpus(documents: DataFrame, order: str, size: int = 300, overlap: int = 50) -> dict[str, DataFrame]:
    """(source, text, ``order``) -> passages with idx, label, links, and the corpus header and files.

    Vectors are not computed here; join them by idx. The chunks are written when this is called, so each text is cut once; what is
    numbered are rows without their texts.
    """
    from . import ranking
    parts = cut_lineage(chunk_documents(documents.filter(F.trim("text") != ""), size, overlap).withColumn("_row", F.monotonically_increasing_id()))
    # idx follows document order, then part: offsets per document come from its chunk count
    counts = parts.groupBy(order).agg(F.count("*").alias("size"))
    starts = ranking.running_before(counts, [], order, order, {"start": "size"})
    placed = parts.join(starts.select(order, "start"), order).withColumn("idx", F.col("start") + F.col("part"))
    rows = placed.select("idx", "source")
    labelled = cp.chunk_labels(placed.select("idx", "source", "_row"))
    linked = cp.link_prev_next(rows)
    passages = parts.select("_row", "text").join(labelled, "_row").drop("_row").join(linked.select("idx", "prev_idx", "next_idx"), "idx")
    meta = rows.withColumn("kind", F.lit("document"))
    return {"passages": passages, "header": cp.corpus_header(meta), "files": cp.corpus_files(meta)}


# -- tables ---------------------------------------------------------------------------------------------

def classify_rows(cells: DataFrame) -> DataFrame:
    """(table_id, row) -> kind: the first wide row without numbers is the header, a row with two
    numbers is data, any other filled row is prose."""
    filled = F.coalesce("val", F.lit("")) != ""
    rows = cells.groupBy("table_id", "row").agg(
        F.count_if(filled).alias("filled"), F.count_if(tx.numeric_dominant(F.col("val"))).alias("numeric")).filter("filled > 0")
    wide = rows.filter("numeric = 0 AND filled >= 4").groupBy("table_id").agg(F.min("row").alias("header_row"))
    kind = F.when(F.col("row") == F.col("header_row"), "header").when(F.col("numeric") >= 2, "data").otherwise("prose")
    return rows.join(wide, "table_id", "left").select("table_id", "row", kind.alias("kind"))


def drop_empty_columns(cells: DataFrame) -> DataFrame:
    """Remove columns without any filled cell and close the gaps."""
    used = cells.groupBy("table_id", "col").agg(F.max((F.trim(F.coalesce("val", F.lit(""))) != "").cast("int")).alias("u")).filter("u = 1")
    numbered = _renumbered(used.select("table_id", "col"))
    return cells.join(numbered, ["table_id", "col"]).select("table_id", "row", F.col("new_col").alias("col"), "val")


def _renumbered(columns: DataFrame) -> DataFrame:
    """0-based positions of a table's remaining columns; a table's width bounds each group."""
    listed = columns.groupBy("table_id").agg(F.array_sort(F.collect_set("col")).alias("cols"))
    return listed.select("table_id", F.posexplode("cols").alias("new_col", "col"))


def merge_map(width: int, filled_together: set[tuple[int, int]]) -> list[int]:
    """New position of each column after merging neighbours never filled in one row, leftmost
    first. A merged column is filled wherever either was, so the pair set is all that is needed."""
    groups: list[set[int]] = []
    for col in range(width):
        clash = groups and any((min(a, col), max(a, col)) in filled_together for a in groups[-1])
        if groups and not clash:
            groups[-1].add(col)
        else:
            groups.append({col})
    position = {c: i for i, g in enumerate(groups) for c in g}
    return [position[c] for c in range(width)]


def merge_disjoint_columns(cells: DataFrame) -> DataFrame:
    """Merge adjacent columns that are never filled in the same row.

    Per row only the sorted list of filled columns matters; equal lists are counted once per
    table, and the column pairs they hold are at most the square of the table's width.
    """
    filled = F.coalesce("val", F.lit("")) != ""
    patterns = cells.groupBy("table_id", "row").agg(
        F.array_sort(F.collect_set(F.when(filled, F.col("col")))).alias("cols")).select("table_id", "cols").distinct()
    pairs = patterns.select("table_id", F.explode("cols").alias("a"), "cols").select(
        "table_id", "a", F.explode("cols").alias("b")).filter("a < b").distinct()
    widths = cells.groupBy("table_id").agg((F.max("col") + 1).alias("width"))
    held = widths.join(pairs.groupBy("table_id").agg(F.collect_set(F.struct("a", "b")).alias("pairs")), "table_id", "left")

    @F.arrow_udf("array<int>")
    def plan(width: pa.Array, together: pa.Array) -> pa.Array:
        done = [merge_map(w, {(p["a"], p["b"]) for p in (t or [])}) for w, t in zip(width.to_pylist(), together.to_pylist())]
        return pa.array(done, pa.list_(pa.int32()))

    moves = held.select("table_id", F.posexplode(plan("width", "pairs")).alias("col", "new_col"))
    moved = cells.join(moves, ["table_id", "col"])
    return moved.groupBy("table_id", "row", F.col("new_col").alias("col")).agg(F.max("val").alias("val"))
