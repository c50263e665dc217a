"""Connected components of an edge table, by rounds of random contraction."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def _settle(batches):
    """(from, to): every node of the edges (a, b) with the least node of its component."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["from", "to"])


def components(edges: DataFrame, rounds: int = 64, few: int = 0) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), columns of long.

    In each round every node moves to that neighbour, or itself, with the least hash under the
    round's seed; edges follow their ends, loops and doubles go. Most nodes vanish in each round,
    whatever the shape of the graph, so rounds grow with the logarithm of the largest component.
    Moves are kept as tables and applied in order. Only the number of edges left reaches the driver. A hub
    with any share of the edges costs one partly aggregated minimum and a join that may be split. Once at most ``few`` edges
    are left, one task settles them.
    """
    left = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = materialize(left.select(F.col("a").alias("node")).unionAll(left.select("b")).distinct().withColumn(
        "root", F.col("node")), "labels")
    for seed in range(rounds):
        if left.isEmpty():
            return labels
        if few and left.count() <= few:
            moves = left.repartition(1).mapInArrow(_settle, "from bigint, to bigint")
            done = materialize(labels.join(moves.toDF("root", "to"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")), "labels")
            discard(left, labels)
            return done
        order = F.struct(F.xxhash64(F.lit(seed), F.col("b")).alias("h"), F.col("b").alias("b"))
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(order).alias("best"))
        own = F.struct(F.xxhash64(F.lit(seed), F.col("a")).alias("h"), F.col("a").alias("b"))
        moves = materialize(nearest.select(F.col("a").alias("from"), F.least(F.col("best"), own)["b"].alias("to")).filter(
            "from <> to"), "moves")
        to_a, to_b = moves.toDF("a", "to_a"), moves.toDF("b", "to_b")
        old = left, labels, moves
        left = materialize(left.join(to_a, "a", "left").join(to_b, "b", "left").select(
            F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")).filter("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        labels = materialize(labels.join(moves.toDF("root", "to"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")), "labels")
        discard(*old)
    raise RuntimeError("components did not settle")
