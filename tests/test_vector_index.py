"""The stored vector index against exact search."""
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import retrieval as rt
from lectern.operators import vector_index as ix
from lectern.session import scratch_path


def frame(spark, m, name="idx", v="v"):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], f"{name} bigint, {v} array<double>")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(2)
    return np.repeat(rng.normal(size=(40, 12)), 30, axis=0) + 0.4 * rng.normal(size=(1200, 12))


@pytest.fixture(scope="module")
def index(spark, cloud):
    path = scratch_path(spark, "index")
    ix.build_index(frame(spark, cloud), path, 40)
    return path


def top(df):
    return {(r["qid"], r["rank"]): (r["idx"], round(r["score"], 9)) for r in df.collect()}


@pytest.mark.parametrize("block", [4096, 25])
def test_all_lists_are_exact(spark, cloud, index, block, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", block)
    queries = frame(spark, cloud[::60], "qid", "q")
    assert top(ix.search_index(spark, index, queries, 7, probes=40)) == top(rt.batch_topk(frame(spark, cloud), queries, 7))


def test_few_lists_keep_recall(spark, cloud, index):
    queries = frame(spark, cloud[::12], "qid", "q")
    want = {(q, i) for (q, _), (i, _) in top(rt.batch_topk(frame(spark, cloud), queries, 10)).items()}
    got = {(q, i) for (q, _), (i, _) in top(ix.search_index(spark, index, queries, 10, probes=6)).items()}
    assert len(got & want) >= 0.9 * len(want)
    assert {r["n"] for r in spark.read.parquet(f"{index}/sizes").agg(F.sum("n").alias("n")).collect()} == {1200}


def test_unprobed_lists_are_not_read(spark, cloud):
    path = scratch_path(spark, "index")
    ix.build_index(frame(spark, cloud), path, 40)
    queries = frame(spark, cloud[:1], "qid", "q")
    probed = {r["list"] for r in ix.probed_lists(spark, path, queries, 2).collect()}
    for folder in glob.glob(f"{path}/lists/list=*"):
        if int(folder.rsplit("=")[-1]) not in probed:
            for file in glob.glob(f"{folder}/*.parquet"):
                open(file, "wb").write(b"not a table")
    assert ix.search_index(spark, path, queries, 5, probes=2).count() == 5
    with pytest.raises(Exception):
        ix.search_index(spark, path, queries, 5, probes=40).count()


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0])], "idx bigint, v array<double>")
    for lists in (None, 3, 50):
        path = scratch_path(spark, "index")
        ix.build_index(rows, path, lists)
        found = ix.search_index(spark, path, rows.filter("idx > 2").select(F.col("idx").alias("qid"), F.col("v").alias("q")), 9, probes=50)
        assert {r["idx"] for r in found.collect()} == {2, 3, 4}
    path = scratch_path(spark, "index")
    ix.build_index(rows.limit(0), path)
    assert ix.search_index(spark, path, frame(spark, [[1, 0]], "qid", "q")).collect() == []
