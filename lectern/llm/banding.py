"""From MinHash bands of distinct sets to verified classes, with no pair of rows ever emitted.

Sets that meet in a band bucket are tied to the bucket's first set, so a bucket of any size costs one
row a member. Components of these ties hold every candidate pair. A component is cut into
blocks of bounded size; each pair of blocks is one small task that verifies its pairs on the full sets and
returns one row a set: the weight of its links and the first set it hangs together with.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .components import components
from .shingles import SIMILARITY, linked

BLOCK_SETS = 1024
BLOCK_MEMBERS = 1 << 19


def candidate_components(distinct: DataFrame) -> DataFrame:
    """(node, root) of the sets in ``distinct`` (node long, bands array of long) that share a bucket with another."""
    rows = distinct.select("node", F.explode("bands").alias("hash"))     # a hash holds its band
    # written, so that the join knows how few buckets are shared and need not move what is alone
    buckets = materialize(rows.groupBy("hash").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub < top").drop("top"), "buckets")
    ties = materialize(rows.join(buckets, "hash").filter("node <> hub").select(
        F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "ties")
    discard(buckets)
    found = components(ties)
    discard(ties)
    return found


def in_blocks(found: DataFrame, sized: DataFrame) -> DataFrame:
    """``found`` (node, root) joined with ``sized`` (node, members_n, ...), and the number of blocks of its component
    (``blocks``) and its block, by hash."""
    held = found.join(sized, "node")
    sizes = held.groupBy("root").agg(F.count("*").alias("_sets"), F.sum("members_n").alias("_members"))
    blocks = F.greatest(F.ceil(F.col("_sets") / BLOCK_SETS), F.ceil(F.col("_members") / BLOCK_MEMBERS)).cast("int")
    return held.join(sizes.select("root", blocks.alias("blocks")), "root").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def verify(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, links, first) from ``sets`` (node, weight, root, blocks, block, members: sorted distinct
    hashes as bytes). A set may come more than once and counts once."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other")
    pairs = sets.select("node", "weight", "root", "block", "members", other).select(
        "node", "weight", "root", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"),
        "block", "members")
    grouped = pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "block", "node")

    def run(batches):
        key, nodes, weights, blocks, held = None, [], [], [], []

        def close():
            split = None if key[1] == key[2] else int(np.searchsorted(np.array(blocks), key[2]))
            links, first = linked(held, np.array(weights, np.int64), similarity, split)
            alone = np.array(nodes)
            return pa.RecordBatch.from_arrays(
                [pa.array(alone), pa.array(links), pa.array(alone[first])], names=["node", "links", "first"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("root", "i", "j", "node", "weight", "block")]
            members = batch.column("members")
            for n, (root, i, j, node, weight, block) in enumerate(zip(*cols)):
                if (root, i, j) != key:
                    if len(nodes) > 1:
                        yield close()
                    key, nodes, weights, blocks, held = (root, i, j), [], [], [], []
                if nodes and nodes[-1] == node:
                    continue
                nodes.append(node)
                weights.append(weight)
                blocks.append(block)
                held.append(np.frombuffer(members[n].as_py(), np.uint64))
        if len(nodes) > 1:
            yield close()

    return materialize(grouped.mapInArrow(run, "node long, links long, first long"), "verified")


def classes(verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (node, root) of the sets that have a link."""
    links = verified.groupBy("node").agg(F.sum("links").alias("links")).filter("links > 0")
    return links, components(verified.select(F.col("node").alias("a"), F.col("first").alias("b")))
