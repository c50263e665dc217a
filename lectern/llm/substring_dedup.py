"""Removal of passages that repeat across or within documents: near copies of paragraphs by MinHash banding, and runs of
words that occur elsewhere, wherever lines begin and end."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .banding import candidate_components, classes, in_blocks, verify
from .common import per_batch, slices
from .repeated_runs import cutter, of_row, repeated_runs, row_hash
from .shingles import N, SIMILARITY, band_hashes, bands_for, set_keys, shingle_sets

MIN_WORDS = 30   # shorter paragraphs are stock phrases and stay
RECALL = 0.99    # of the paragraph bands: 12 of 5 rows, since each band moves a row a paragraph
MOST_HASHES = 64
RUN_WORDS = 50   # so many equal words in a row are a passage in any layout
BREAK = "\n"


def _paragraphs(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All paragraphs of all texts, the row each came from, and its place in its text."""
    lists = pc.split_pattern(pc.fill_null(text, ""), BREAK)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return lists.flatten(), row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _occurrences(docs: DataFrame, n: int, bands: int, rows: int, min_words: int) -> DataFrame:
    def work(batch):
        for part in slices(batch, "text", 1_000_000):
            flat, row, place = _paragraphs(part.column("text"))
            values, offsets, words = shingle_sets(flat, n)
            long = np.flatnonzero(words >= min_words)
            sizes = np.diff(offsets)
            keys, hashed = set_keys(values, offsets), band_hashes(values, offsets, bands, rows)
            yield {"doc_id": part.column("doc_id").take(pa.array(row[long])), "place": pa.array(place[long]),
                   "k0": keys[long, 0], "k1": keys[long, 1], "members_n": sizes[long],
                   "bands": pa.ListArray.from_arrays(
                       pa.array(np.arange(len(long) + 1, dtype=np.int32) * bands), pa.array(hashed[long].ravel()))}

    return per_batch(docs.select("doc_id", "text"),
                     "doc_id long, place int, k0 long, k1 long, members_n long, bands array<long>", work)


def repeated_paragraphs(docs: DataFrame, similarity: float = SIMILARITY, n: int = N, recall: float = RECALL,
                        min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, place, class_doc, first: every occurrence of a paragraph that occurs, or nearly occurs, elsewhere.

    Paragraphs of at least ``min_words`` words belong together if the Jaccard similarity of their word ``n``-gram sets
    reaches ``similarity``, or through others in between. ``class_doc`` is the document of the first occurrence, by (doc_id,
    place), and ``first`` marks that occurrence.
    """
    bands, rows = bands_for(similarity, recall, MOST_HASHES)
    full = materialize(_occurrences(docs.filter("doc_id IS NOT NULL"), n, bands, rows, min_words), "paragraphs")
    seen = materialize(full.select("doc_id", "place", "k0", "k1"), "occurrences")
    distinct = materialize(full.groupBy("k0", "k1").agg(
        F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.first("members_n").alias("members_n"),
        F.first("bands").alias("bands"), F.min(F.struct("doc_id", "place")).alias("head")).withColumn(
        "node", F.monotonically_increasing_id()), "distinct")
    discard(full)
    found = candidate_components(distinct)
    placed = in_blocks(found, distinct.select("node", "members_n", "copies", "first_doc", "k0", "k1"))
    # at most one row a paragraph of the document
    wanted = materialize(placed.groupBy(F.col("first_doc").alias("doc_id")).agg(F.collect_list(F.struct(
        "k0", "k1", "node", F.col("copies").alias("weight"), "root", "blocks", "block")).alias("wanted")), "wanted")
    # joins of texts are sorted ones at any size, as they are on large tables; marks of a small one would be broadcast
    texts = docs.select("doc_id", "text").join(wanted.select("doc_id"), "doc_id", "left_semi").join(wanted.hint("merge"), "doc_id")

    def members(batch):
        names = ("node", "weight", "root", "blocks", "block")
        for part in slices(batch, "text", 1_000_000):
            flat, row, _ = _paragraphs(part.column("text"))
            values, offsets, words = shingle_sets(flat, n)
            keys = set_keys(values, offsets)
            asked = [{(w["k0"], w["k1"]): w for w in ws} for ws in part.column("wanted").to_pylist()]
            out = {c: [] for c in (*names, "members")}
            for p in np.flatnonzero(words >= min_words).tolist():
                hit = asked[row[p]].pop((int(keys[p, 0]), int(keys[p, 1])), None)
                if hit is not None:
                    for c in names:
                        out[c].append(hit[c])
                    out["members"].append(np.sort(values[offsets[p]:offsets[p + 1]]).tobytes())
            yield out

    sets = per_batch(texts.select("wanted", "text"),
                     "node long, weight long, root long, blocks int, block int, members binary", members)
    _, joined = classes(verify(sets, similarity))
    # a paragraph without near ones is a class of its own
    every = distinct.select("node", "k0", "k1", "copies", "head").join(joined, "node", "left").withColumn(
        "class", F.coalesce("root", "node")).drop("root")
    heads = every.groupBy("class").agg(F.sum("copies").alias("n"), F.min("head").alias("first_head")).filter("n > 1")
    busy = every.join(heads, "class").select("k0", "k1", "first_head")
    at = F.struct("doc_id", "place")
    return seen.select("doc_id", "place", "k0", "k1").join(busy, ["k0", "k1"]).select(
        "doc_id", "place", F.col("first_head.doc_id").alias("class_doc"), (at == F.col("first_head")).alias("first"))


def _without(text: Column, gone: Column) -> Column:
    lines = F.split(text, BREAK, -1)
    return F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), BREAK)


def _marked(docs: DataFrame, similarity: float, min_words: int, run_words: int | None) -> tuple[DataFrame, Column, Column]:
    """``docs`` with _gone, _n, _runs and _docs joined, the cut text, and whether it was cut."""
    found = materialize(repeated_paragraphs(docs.select("doc_id", "text"), similarity, min_words=min_words).distinct(), "repeats")
    of_doc = found.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set(F.when(~F.col("first"), F.col("place"))).alias("_gone"), F.count("*").alias("_n"),
        F.array_sort(F.collect_set("class_doc")).alias("_docs"))
    some = F.coalesce(F.size("_gone") > 0, F.lit(False))
    names = docs.columns
    # near copies leave first, so that runs are looked for in what is kept alone
    of_doc = materialize(of_doc, "marks")
    base = docs.join(of_doc.hint("merge"), F.col("doc_id") == F.col("_id"), "left").withColumn("_was", some).withColumn(
        "text", F.when(some, _without(F.col("text"), F.col("_gone"))).otherwise(F.col("text")))
    if run_words is None:
        return base.withColumn("_runs", F.lit(0).cast("long")), F.col("text"), F.col("_was")
    runs = repeated_runs(base.select("doc_id", "text"), run_words).select(
        F.col("doc_id").alias("_rid"), F.col("row").alias("_row"), "starts", "first_docs")
    held = base.withColumn("_own", row_hash()).join(
        runs.hint("merge"), of_row("_own"), "left").withColumn(
        "_c", cutter(run_words)(F.when(F.col("starts").isNotNull(), F.col("text")), F.array().cast("array<int>"), F.col("starts")))
    held = held.select(
        *names, "_c", "_gone", "_was", F.coalesce("_c.runs", F.lit(0)).alias("_runs"),
        (F.coalesce("_n", F.lit(0)) + F.coalesce("_c.runs", F.lit(0))).alias("_n"),
        F.array_sort(F.array_union(F.coalesce("_docs", F.array().cast("array<bigint>")),
                                   F.coalesce("first_docs", F.array().cast("array<bigint>")))).alias("_docs"))
    text = F.when(F.col("_c").isNotNull(), F.col("_c.text")).otherwise(F.col("text"))
    return held, text, F.col("_c").isNotNull() | F.col("_was")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS,
                 run_words: int | None = None) -> DataFrame:
    """Columns of ``docs`` with every repeated passage but the first occurrence cut from ``text``, and
    ``n_removed``, ``n_repeated`` and ``class_docs`` appended.

    A paragraph is what stands between newlines; one of at least ``min_words`` words is a passage, and near copies of it
    repeat it. With ``run_words``, so is any run of that many words that occurs elsewhere word for word, over short lines or
    within longer ones; without it, only whole paragraphs are compared. What is left keeps its order and text.
    Near copies of paragraphs leave first; runs are then looked for in what is left, so the first occurrence of a run is
    one that is kept.
    ``n_repeated`` counts the document's paragraphs that occur elsewhere and the runs cut from other lines, ``n_removed``
    what was cut of these, and ``class_docs`` lists the documents that hold the first
    occurrences. A null or empty text, a text without passages and a row without doc_id stay as they are; a text may
    become empty. Rows with the same doc_id are one document as to paragraphs. Appended names replace columns of the same
    name. An empty table gives an empty result. Jobs run when this is called.
    """
    new = ("n_removed", "n_repeated", "class_docs")
    names = [c for c in docs.columns if c not in new]
    held, cut, _ = _marked(docs.select(*names), similarity, min_words, run_words)
    lines = F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0))
    return held.select(
        *[cut.alias("text") if c == "text" else F.col(c) for c in names],
        (lines + F.col("_runs")).cast("long").alias("n_removed"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_repeated"),
        F.coalesce("_docs", F.array().cast("array<bigint>")).alias("class_docs"))


def cut_repeats(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS,
                run_words: int | None = None) -> DataFrame:
    """``docs`` with the same cuts and no other columns; an ``n_chars`` column follows a text that was cut."""
    held, cut, changed = _marked(docs, similarity, min_words, run_words)
    columns = {"text": cut.alias("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length(cut)).otherwise(F.col("n_chars")).cast(
            docs.schema["n_chars"].dataType).alias("n_chars")
    return held.select(*[columns.get(c, F.col(c)) for c in docs.columns])
