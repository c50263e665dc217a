"""Centroid clustering against a plain loop."""
import hashlib
import math
import random

from lectern.llm.centroids import clusters, nearest, quantised, starts

SCHEMA = "vec_id long, embedding array<float>, cluster int, v string"


def brute(vectors, size, k=8, rounds=10, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        centres = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if n in groups else old for n, old in enumerate(centres)]
    near = [(i, *reversed(place(v))) for i, v in kept]
    own = {n: sum(d for _, c, d in near if c == n) for n in range(k)}
    return sorted((str(i), c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in near)


def run(spark, vectors, size, **more):
    df = spark.createDataFrame([(i, v, 5, "other") for i, v in vectors], SCHEMA).repartition(3)
    return sorted((str(r.vec_id), *tuple(r)[1:]) for r in clusters(df, size=size, **more).collect())


def rounded(v):
    return [x if x is None or not math.isfinite(x) else round(x * 256) / 256 for x in v]


def test_clusters_match_a_plain_loop(spark):
    rng = random.Random(3)
    vectors = [(i, rounded([rng.gauss(i % 5, 1) for _ in range(6)])) for i in range(400)]
    assert run(spark, vectors, 6) == brute(vectors, 6)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (None, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]),
               (6, [inf, 0.0]), (7, [-0.0004, 3.0]), (8, [1.0, 1.0]), (9, [-1.0, 1.0]), (1, [0.25, 0.25]), (10, [1.0, 1.0, 1.0]), (11, [])]
    vectors += [(20 + i, [0.125, 0.125]) for i in range(9)]
    assert run(spark, vectors, 2) == brute([(i, v and [float.fromhex("-0x1.a36e2e0000000p-12") if x == -0.0004 else x for x in v]) for i, v in vectors], 2)


def test_ties_and_few_vectors(spark):
    vectors = [(i, [float(i % 2), 0.0]) for i in range(5)]     # equal starts: the smaller number takes all
    assert run(spark, vectors, 2) == brute(vectors, 2)
    assert run(spark, vectors[:1], 2) == brute(vectors[:1], 2)
    assert run(spark, [], 2) == []
    assert run(spark, [(1, None)], 2) == []


def test_rounds_are_one_scan_without_python(spark):
    rows = quantised(spark.createDataFrame([(i, [float(i)] * 4) for i in range(9)], "vec_id long, embedding array<float>"), 4)
    centres = starts(rows)
    plan = rows.select(nearest(rows.v, centres).alias("n"))._jdf.queryExecution().toString()
    assert len(centres) == 8 and "Exchange" not in plan and "ython" not in plan
