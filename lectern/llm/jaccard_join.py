"""N-gram Jaccard self-join of documents by MinHash banding, verified on the full n-gram sets."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .banding import candidate_components, classes, in_blocks, verify
from .common import per_batch, slices
from .shingles import N, RECALL, SIMILARITY, band_hashes, bands_for, set_keys, shingle_sets


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def work(batch):
        for part in slices(batch, "text", 1_000_000):
            values, offsets, _ = shingle_sets(part.column("text"), n)
            keys, hashed, sizes = set_keys(values, offsets), band_hashes(values, offsets, bands, rows), np.diff(offsets)
            none = sizes == 0
            yield {"doc_id": part.column("doc_id"), "k0": pa.array(keys[:, 0], mask=none),
                   "k1": pa.array(keys[:, 1], mask=none), "members_n": pa.array(sizes),
                   "bands": pa.ListArray.from_arrays(
                       pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands), pa.array(hashed.ravel()))}

    return per_batch(docs.select("doc_id", "text"), "doc_id long, k0 long, k1 long, members_n long, bands array<long>", work)


def jaccard_classes(docs: DataFrame, similarity: float = SIMILARITY, n: int = N, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs``.

    Documents are linked if the Jaccard similarity of their sets of word ``n``-grams reaches ``similarity``; ``n_links``
    counts the other rows a row is linked to, copies one by one. ``class_id`` is the least doc_id of the rows that
    hang together by links. Band and row counts follow from ``similarity`` and ``recall``, the chance that
    a pair just at the threshold is looked at; every pair looked at is verified on the full sets.

    Texts shorter than ``n`` words have one n-gram, of all their words. A null or empty text, or
    one without a word, has none: its class is its own id and it has no links. Texts with equal sets are
    matched once, as one weighted set, so copies cost nothing beyond a count. A row without a doc_id takes no part
    and gets a null class. Rows that repeat a doc_id are rows of their own. An empty table gives an empty result; other
    columns are not read. Jobs run when this is called.
    """
    bands, rows = bands_for(similarity, recall)
    signed = materialize(_signatures(docs, n, bands, rows), "signatures")
    known = signed.filter("doc_id IS NOT NULL AND k0 IS NOT NULL")
    distinct = materialize(known.groupBy("k0", "k1").agg(
        F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.first("members_n").alias("members_n"),
        F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    found = candidate_components(distinct)
    placed = in_blocks(found, distinct.select("node", "members_n", "copies", "first_doc", "k0", "k1"))

    def members(batch):
        for part in slices(batch, "text", 1_000_000):
            values, offsets, _ = shingle_sets(part.column("text"), n)
            keys = set_keys(values, offsets)
            same = (keys[:, 0] == part.column("k0").to_numpy()) & (keys[:, 1] == part.column("k1").to_numpy())
            keep = pa.array(same)
            out = {c: part.column(c).filter(keep) for c in ("node", "weight", "root", "blocks", "block")}
            yield out | {"members": [np.sort(values[offsets[i]:offsets[i + 1]]).tobytes() for i in np.flatnonzero(same)]}

    texts = docs.select("doc_id", "text").join(
        placed.withColumnRenamed("first_doc", "doc_id").withColumnRenamed("copies", "weight"), "doc_id").select(
        "node", "weight", "root", "blocks", "block", "k0", "k1", "text")
    sets = per_batch(texts, "node long, weight long, root long, blocks int, block int, members binary", members)
    links, joined = classes(verify(sets, similarity))
    heads = joined.join(distinct.select("node", "first_doc"), "node")
    least = heads.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    of_node = heads.join(least, "root").select("node", "class_id").join(links, "node", "left")
    of_key = distinct.select("node", "k0", "k1", "first_doc", "copies").join(of_node, "node", "left").select(
        F.col("k0"), F.col("k1"), F.coalesce("class_id", "first_doc").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # only texts that have a copy or a link need the join back
    busy = of_key.filter("n_links > 0")
    own = F.col("doc_id").isNotNull()
    return signed.select("doc_id", "k0", "k1").join(busy, ["k0", "k1"], "left").select(
        "doc_id", F.when(own, F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` without near copies: of each class the row with the least doc_id stays, once. Rows without a doc_id stay."""
    from pyspark.sql import Window

    leave = jaccard_classes(docs, similarity).filter("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(leave, F.col("doc_id") == F.col("_gone"), "left_anti")
    repeated = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL")
    if repeated.isEmpty():
        return kept
    again = F.when(F.col("doc_id").isNotNull(), F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text"))))
    names = docs.columns
    return kept.withColumn("_again", again).filter("_again IS NULL OR _again = 1").select(*names)
