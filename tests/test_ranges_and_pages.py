"""Overlapping id ranges by a boundary sweep, and pages of a stored corpus through its index."""
import glob
import os
import random

import pytest

from lectern.operators import mutate
from lectern.session import scratch_path
from lectern.sources import corpus_io

RANGES = "lo bigint, hi bigint, mask int, seq bigint"


@pytest.mark.parametrize("block", [1_000_000, 16])
def test_overlapping_ranges_take_the_last_mask(spark, block, monkeypatch):
    monkeypatch.setattr(mutate, "IDX_BLOCK", block)
    rng = random.Random(block)
    ids = sorted(rng.sample(range(300), 200)) + [299, 299]
    ranges = []
    for seq in range(120):
        lo = rng.randrange(300)
        ranges.append((None if seq % 31 == 0 else lo, None if seq % 29 == 0 else rng.randrange(lo, 301), rng.randrange(8), seq))
    got = mutate.set_perms(spark.createDataFrame([(i, 99, f"t{i}") for i in ids], "idx bigint, perms int, text string"),
                           spark.createDataFrame(ranges, RANGES))
    assert got.columns == ["idx", "perms", "text"]

    def mask(i):
        hits = [m for lo, hi, m, _ in ranges if (lo or 0) <= i < (300 if hi is None else hi)]
        return hits[-1] if hits else 99
    assert sorted((r.idx, r.perms, r.text) for r in got.collect()) == sorted((i, mask(i), f"t{i}") for i in ids)


def test_no_ranges_and_empty_ranges(spark):
    rows = spark.createDataFrame([(0, 1), (5, 2)], "idx bigint, perms int")
    for ranges in ([], [(3, 3, 7, 1)]):
        assert sorted(mutate.set_perms(rows, spark.createDataFrame(ranges, RANGES)).collect()) == sorted(rows.collect())


def test_many_ranges_in_one_block(spark):
    """A hundred thousand ranges over the ids of one block: pieces stay disjoint, and work is far from ranges times rows."""
    rng = random.Random(1)
    ranges = [(lo, lo + rng.randrange(1, 400_000), seq % 7, seq) for seq, lo in enumerate(rng.choices(range(500_000), k=100_000))]
    pieces = mutate.disjoint_ranges(spark.createDataFrame(ranges, RANGES)).orderBy("lo").collect()
    assert all(a.hi == b.lo for a, b in zip(pieces, pieces[1:])) and len(pieces) <= 200_000
    for p in rng.sample(pieces, 40):
        assert p.mask == next(m for lo, hi, m, _ in reversed(ranges) if lo <= p.lo < hi)


def test_range_lists():
    assert mutate.id_ranges("5, 12-15,42,100:,:3, 7:9,") == [(5, 6), (12, 15), (42, 43), (100, None), (None, 3), (7, 9)]
    with pytest.raises(ValueError):
        mutate.id_ranges("5,x")


def test_deep_pages_open_one_block(spark, monkeypatch):
    monkeypatch.setattr(corpus_io, "IDX_BLOCK", 50)
    path, rng = scratch_path(spark, "corpus"), random.Random(4)
    ids = sorted(rng.sample(range(1000), 700))
    rows = spark.createDataFrame([(i, f"t{i}", c) for c in ("a", "b") for i in ids], "idx bigint, text string, corpus_id string")
    corpus_io.write_corpus(rows, path)
    corpus_io.write_page_index(spark, path)
    for offset in (0, 33, 49, 50, 312, 630, 690, 699, 700, 5000):
        got = corpus_io.stored_page(spark, path, "a", offset, 20).collect()
        assert [(r.idx, r.text, r.total) for r in got] == [(i, f"t{i}", 700) for i in ids[offset:offset + 20]]
    keep = f"{path}/corpus_id=a/idx_block={ids[630] // 50}"
    for file in glob.glob(f"{path}/**/*.parquet", recursive=True):
        if os.path.dirname(file) != keep:
            open(file, "wb").write(b"gone")
    at = next(n for n, i in enumerate(ids) if i // 50 == ids[630] // 50)
    assert [r.idx for r in corpus_io.stored_page(spark, path, "a", at, 5).collect()] == ids[at:at + 5]
    with pytest.raises(ValueError):
        corpus_io.stored_page(spark, path, "a", -1)
