"""Retrieval, similarity joins and matching against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import diff, retrieval as rt, simjoin


def frame(spark, m, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(m)], "idx bigint, v array<double>")


def unit(m):
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1.0)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(5, 8))
    m = np.repeat(centers, 12, axis=0) + 0.15 * rng.normal(size=(60, 8))
    m[7] = m[3]                 # exact copies, one of them large
    m[40:52] = m[40]
    return m


def test_topk_is_prefix_of_full_sort(spark, cloud):
    q = cloud[5].tolist()
    got = [r["idx"] for r in rt.best(rt.vx and frame(spark, cloud).select("idx", rt.vx.cosine("v", q).alias("score")), 9).collect()]
    scores = unit(cloud) @ unit(cloud[[5]])[0]
    assert got == sorted(range(60), key=lambda i: (-round(scores[i], 9), i))[:9]


def test_query_of_other_size_raises(spark, cloud):
    with pytest.raises(Exception, match="dimensions"):
        rt.hamming_topk(frame(spark, cloud), [1.0, 2.0], 3).collect()


@pytest.mark.parametrize("budget", [1 << 20, 8 * 8 * 7])
def test_batch_topk_both_plans(spark, cloud, budget):
    df = frame(spark, cloud).repartition(3)
    got = rt.batch_topk(df, df.select(F.col("idx").alias("qid"), F.col("v").alias("q")), 4, True, budget).collect()
    s = np.round(unit(cloud) @ unit(cloud).T, 7)
    np.fill_diagonal(s, -9)
    for qid in range(60):
        rows = sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])
        assert np.allclose([r["score"] for r in rows], sorted(s[qid], reverse=True)[:4], atol=1e-6)


@pytest.mark.parametrize("threshold,cell", [(0.3, 4), (0.8, 4096), (0.97, 5)])
def test_similar_pairs_complete(spark, cloud, threshold, cell, monkeypatch):
    monkeypatch.setattr(simjoin, "CELL_ROWS", cell)
    monkeypatch.setattr(simjoin, "PIVOTS", 6)
    left, right = simjoin.vector_groups(frame(spark, cloud[:40])), simjoin.vector_groups(frame(spark, cloud[20:], 20))
    got = {(r["left_rep"], r["right_rep"]) for r in simjoin.similar_pairs(left, right, threshold).collect()}

    def reps(m, start):
        first = {}
        for i, v in enumerate(m):
            first.setdefault(tuple(v), start + i)
        return first
    want = {(i, j) for a, i in reps(cloud[:40], 0).items() for b, j in reps(cloud[20:], 20).items()
            if np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) > threshold}
    assert got == want


@pytest.mark.parametrize(("bits", "cell"), [(None, 4096), (3, 20), (10, 4096)])
def test_near_pairs_reach_their_recall(spark, bits, cell, monkeypatch):
    monkeypatch.setattr(simjoin, "CELL_ROWS", cell)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    left, right = (np.repeat(centres, 6, axis=0) + 0.55 * rng.normal(size=(360, 16)) for _ in range(2))
    left[5], right[7] = right[3], 0.0
    threshold = 0.75
    sims = np.round(unit(left) @ unit(right).T, 12)
    want = {(i, j) for i, j in zip(*np.nonzero(sims > threshold))}
    rows = simjoin.near_pairs(simjoin.vector_groups(frame(spark, left)), simjoin.vector_groups(frame(spark, right)), threshold, 0.95, bits).collect()
    got = [(r["left_rep"], r["right_rep"]) for r in rows]
    assert len(got) == len(set(got)) and set(got) <= want          # each once, and verified
    assert all(abs(r["similarity"] - sims[r["left_rep"], r["right_rep"]]) < 1e-9 for r in rows)
    assert len(want) > 500 and len(got) >= 0.95 * len(want)
    assert simjoin.plane_bands(0.8, 0.95, 8) == 18 and simjoin.plane_bands(1.0, 0.95, 8) == 1


def test_near_pairs_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "idx bigint, v array<double>")
    got = simjoin.similarity_left_join(rows, rows, 0.9, recall=0.99).collect()
    assert sorted((r["left_idx"], r["left_copies"], r["right_idx"], r["right_copies"]) for r in got if r["right_idx"]) == [(2, 2, 2, 2)]
    assert sorted(r["left_idx"] for r in got) == [1, 2, 4]
    assert simjoin.similarity_left_join(rows, rows.limit(0), 0.9, recall=0.99).filter("right_idx IS NOT NULL").isEmpty()


def test_low_thresholds_are_joined_exactly(spark, cloud, monkeypatch):
    """A row would go to hundreds of bands otherwise; the exact join is as whole with few similarities held at once."""
    monkeypatch.setattr(simjoin, "SCORES", 64)
    monkeypatch.setattr(simjoin, "CELL_ROWS", 16)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(150, 12))
    sims = np.round(unit(m) @ unit(m).T, 12)
    rows = simjoin.near_pairs(*[simjoin.vector_groups(frame(spark, m))] * 2, 0.4, 0.95).collect()
    got = sorted((r["left_rep"], r["right_rep"]) for r in rows)
    assert got == sorted(zip(*(x.tolist() for x in np.nonzero(sims > 0.4))))


def greedy(old, new, threshold):
    sims = unit(new) @ unit(old).T
    free, out = set(range(len(old))), {}
    for i in range(len(new)):
        best = max(sorted(free), key=lambda j: round(sims[i, j], 9), default=None)
        if best is not None and round(sims[i, best], 9) >= threshold:
            out[i] = best
            free.discard(best)
    return out


@pytest.mark.parametrize("cap", [2, 16])
def test_greedy_match_equals_serial(spark, cloud, cap):
    rng = np.random.default_rng(5)
    old = cloud[:50]
    new = np.concatenate([cloud[:45], cloud[:20] + 0.05 * rng.normal(size=(20, 8)), cloud[40:46]])
    got = {r["new_idx"]: r["old_idx"] for r in simjoin.greedy_match(frame(spark, old), frame(spark, new), 0.9, cap).collect()}
    assert got == greedy(old, new, 0.9)


@pytest.mark.parametrize(("cap", "seed"), [(1, 0), (2, 1), (16, 2), (3, 3)])
def test_greedy_match_breaks_ties_by_idx(spark, cap, seed):
    """Few directions, mirrored and of several lengths: most similarities are equal, and copies of the groups interleave."""
    rng = np.random.default_rng(seed)
    base = np.array([[1, 0, 0], [1, .2, 0], [1, -.2, 0], [1, 0, .2], [1, 0, -.2], [0, 1, 0], [1, .2, .2], [0, 0, 0]])
    old = base[rng.integers(0, 8, 45)] * rng.choice([.5, 1, 2], (45, 1))
    new = base[rng.integers(0, 8, 50)] * rng.choice([.5, 1, 4], (50, 1))
    got = {r["new_idx"]: r["old_idx"] for r in simjoin.greedy_match(frame(spark, old), frame(spark, new), 0.9, cap).collect()}
    assert got == greedy(old, new, 0.9)


def snap(spark, m, texts):
    rows = [(i, t, "s", [float(x) for x in v]) for i, (v, t) in enumerate(zip(m, texts))]
    return spark.createDataFrame(rows, "idx bigint, text string, source string, v array<double>")


def test_diff_identities(spark, cloud):
    a = snap(spark, cloud[:20], [f"t{i % 6}" for i in range(20)])
    b = snap(spark, cloud[8:30], [f"t{i % 7}" for i in range(22)])
    for run in (diff.diff_exact, diff.diff_semantic):
        n = {r["status"]: r["n"] for r in run(a, b).groupBy("status").agg(F.count("*").alias("n")).collect()}
        same = n.get("unchanged", 0) + n.get("modified", 0)
        assert same + n.get("added", 0) == 22 and same + n.get("removed", 0) == 20
        assert {r["status"] for r in run(a, a).select("status").distinct().collect()} == {"unchanged"}


def test_diff_exact_pairs_copies_and_leaves_nulls_alone(spark):
    texts = ["a", "b", None, "a", "c", "a", None, "d", "b"]
    old = spark.createDataFrame([(i, t, "o") for i, t in enumerate(texts)], "idx bigint, text string, source string")
    new = spark.createDataFrame([(i, t, "n") for i, t in enumerate(["a", None, "b", "a", "e", "d", "d"])], "idx bigint, text string, source string")
    got = sorted((r["status"], r["new_idx"], r["old_idx"], r["source"]) for r in diff.diff_exact(old, new).na.fill(-1, ["new_idx", "old_idx"]).collect())
    assert got == [("added", 1, -1, "n"), ("added", 4, -1, "n"), ("added", 6, -1, "n"), ("removed", -1, 0, "o"), ("removed", -1, 1, "o"),
                   ("removed", -1, 2, "o"), ("removed", -1, 4, "o"), ("removed", -1, 6, "o"), ("unchanged", 0, 5, "n"), ("unchanged", 2, 8, "n"),
                   ("unchanged", 3, 3, "n"), ("unchanged", 5, 7, "n")]


@pytest.mark.parametrize("rows", [0, 30])
def test_greedy_match_in_rounds_equals_serial(spark, cloud, rows, monkeypatch):
    """Components that no task holds are matched in rounds, the others beside them."""
    monkeypatch.setattr(simjoin, "MATCH_ROWS", rows)
    rng = np.random.default_rng(5)
    old = cloud[:50]
    new = np.concatenate([cloud[:45], cloud[:20] + 0.05 * rng.normal(size=(20, 8)), cloud[40:46]])
    got = {r["new_idx"]: r["old_idx"] for r in simjoin.greedy_match(frame(spark, old), frame(spark, new), 0.9, 2).collect()}
    assert got == greedy(old, new, 0.9)


def test_greedy_match_joins_once(spark, monkeypatch):
    """Rows that compete within a cluster were refused, and their lists lengthened, in a round of jobs each."""
    joined, real = [], simjoin.similar_pairs
    monkeypatch.setattr(simjoin, "similar_pairs", lambda *a, **k: joined.append(1) or real(*a, **k))
    monkeypatch.setattr(simjoin, "CELL_ROWS", 8)
    monkeypatch.setattr(simjoin.ranking, "in_order", lambda *a, **k: pytest.fail("a round"))
    rng = np.random.default_rng(6)
    m = np.repeat(rng.normal(size=(4, 40)), 30, axis=0) + 0.05 * rng.normal(size=(120, 40))
    order = rng.permutation(120)
    old, new = m[order[:70]], m[order[40:]] + 0.01 * rng.normal(size=(80, 40))
    got = {r["new_idx"]: r["old_idx"] for r in simjoin.greedy_match(frame(spark, old), frame(spark, new), 0.9, 2).collect()}
    assert got == greedy(old, new, 0.9) and len(got) > 60 and joined == [1]


def test_greedy_match_odd_rows(spark):
    """Copies of an idx, negative ones and null vectors; an old row is taken once."""
    kind = "idx bigint, v array<double>"
    old = spark.createDataFrame([(-1, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 2.0]), (5, None), (6, [0.0, 0.0])], kind)
    new = spark.createDataFrame([(-1, [3.0, 0.0]), (0, [2.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 4.0]), (7, None)], kind)
    got = sorted((r["new_idx"], r["old_idx"], r["similarity"]) for r in simjoin.greedy_match(old, new, 0.9).collect())
    assert got == [(-1, -1, 1.0), (1, 0, 1.0), (1, 0, 1.0)]
    assert simjoin.greedy_match(old.limit(0), new, 0.9).isEmpty() and simjoin.greedy_match(old, new.limit(0), 0.9).isEmpty()


@pytest.mark.parametrize(("dense", "threshold"), [(64, 0.7), (10**9, 0.7), (64, 0.1), (1, 0.1)])
def test_first_dimensions_rule_out_no_partner(spark, dense, threshold, monkeypatch):
    monkeypatch.setattr(simjoin, "DENSE", dense)
    monkeypatch.setattr(simjoin, "SCORES", 1 << 12)
    rng = np.random.default_rng(9)
    left = rng.normal(size=(200, 48))
    right = np.concatenate([left[:90] + rng.normal(size=(90, 48)) * rng.uniform(0.2, 1.4, (90, 1)), rng.normal(size=(110, 48))])
    want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(np.round(unit(left) @ unit(right).T, 12) > threshold)))}
    groups = [simjoin.vector_groups(frame(spark, m)) for m in (left, right)]
    rows = simjoin.similar_pairs(*groups, threshold).collect()
    assert {(r["left_rep"], r["right_rep"]) for r in rows} == want and len(rows) == len(want) > 30
    assert all(abs(r["similarity"] - unit(left)[r["left_rep"]] @ unit(right)[r["right_rep"]]) < 1e-11 for r in rows)
    # links tie together the same rows, with as few pairs as a tree has where one task sees all
    links = [(r["left_rep"], r["right_rep"]) for r in simjoin.similar_pairs(*groups, threshold, links=True).collect()]

    def parts(pairs):
        root = {}
        def at(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x
        for i, j in pairs:
            root[at(("l", i))] = at(("r", j))
        held = {}
        for x in list(root):
            held.setdefault(at(x), set()).add(x)
        return {frozenset(x) for x in held.values()}
    assert set(links) <= want and parts(links) == parts(want)
    assert len(links) <= sum(len(x) - 1 for x in parts(want)) + 200


def test_pivots_that_keep_nothing_away_are_left_out(spark, monkeypatch):
    """Each vector was sent to nearly every cell where vectors have no structure."""
    monkeypatch.setattr(simjoin, "CELL_ROWS", 40)
    rng = np.random.default_rng(4)
    loose = rng.normal(size=(400, 64))
    tight = np.repeat(rng.normal(size=(10, 64)), 40, axis=0) + 0.05 * rng.normal(size=(400, 64))
    visits = []
    for m in (loose, tight):
        groups = simjoin.vector_groups(frame(spark, m))
        pivots = simjoin._pivots(groups, 0.4)
        visits.append((len(pivots), simjoin._place(groups, pivots, 0.4).count()))
    assert visits[0] == (1, 400) and visits[1][0] == 10 and visits[1][1] < 4000


def test_few_edges_are_settled_by_one_task(spark):
    from lectern.operators.components import components
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(1900, 1990)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")

    def parts(few):
        held = {}
        for r in components(df, few=few).collect():
            held.setdefault(r["root"], set()).add(r["node"])
        return {frozenset(x) for x in held.values()}
    assert parts(0) == parts(1000) == parts(50)


def test_semantic_diff_takes_few_jobs(spark):
    """Competing rows took some ten jobs a round; the matches are those of the serial rule."""
    rng = np.random.default_rng(7)
    m = np.repeat(rng.normal(size=(3, 40)), 40, axis=0) + 0.05 * rng.normal(size=(120, 40))
    order = rng.permutation(120)
    old, new = m[order[:80]], m[order[30:]]
    texts = [f"t{i % 4}" for i in range(90)]
    sc = spark.sparkContext
    sc.setJobGroup("semantic", "diff_semantic")
    try:
        got = diff.diff_semantic(snap(spark, old, texts[:80]), snap(spark, new, texts)).collect()
    finally:
        sc._jsc.clearJobGroup()
    pairs = greedy(old, new, diff.SEMANTIC_THRESHOLD)
    want = {("unchanged" if texts[i] == texts[j] else "modified", i, j) for i, j in pairs.items()}
    want |= {("added", i, None) for i in range(90) if i not in pairs} | {("removed", None, j) for j in set(range(80)) - set(pairs.values())}
    assert {(r["status"], r["new_idx"], r["old_idx"]) for r in got} == want and len(got) == len(want)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("semantic")) < 100, len(sc.statusTracker().getJobIdsForGroup("semantic"))
