"""Nothing is cut in silence, and requests that cannot be met are errors."""
import pytest
from pyspark.sql import functions as F

from lectern.operators import corpus, mutate, retrieval
from lectern.operators.lexical_search import token_retrieve
from lectern.sources import corpus_io


def test_sources_beyond_the_stored_number(spark):
    many = spark.range(70_000).select("id", F.concat(F.lit("s"), "id").alias("source")).withColumnRenamed("id", "idx")
    assert corpus_io.normalize_sources(many, None).agg(F.sum("n"), F.max("source_idx")).first()[:] == (70_000, 70_000)
    for read in (lambda d: d.count(), lambda d: d.select("n").collect()):
        with pytest.raises(Exception, match="more than 65535 sources"):
            read(corpus_io.normalize_sources(many))


def test_page_and_rare_themes(spark):
    rows = spark.range(500).select(F.col("id").alias("idx"), F.concat(F.lit("alpha bravo item"), F.col("id") % 100).alias("text"))
    assert corpus.page(rows, 0, 400).count() == 400
    with pytest.raises(ValueError):
        corpus.page(rows, 0, 0)
    rare = corpus.theme_coverage(rows, minimum=6, shown=3).collect()
    assert len(rare) == 3 and {r["total"] for r in rare} == {100}


def test_tombstones_leave_before_the_cut(spark):
    vectors = spark.createDataFrame([(i, [1.0, i / 200]) for i in range(200)], "idx bigint, v array<double>")
    passages = vectors.select("idx", F.lit("text").alias("text"), F.lit("s").alias("source"), (F.col("idx") < 50).alias("tombstone"))
    query = F.array(F.lit(1.0), F.lit(0.0))
    assert [r["idx"] for r in retrieval.cosine_topk(vectors, query, 10, passages).collect()] == list(range(50, 60))
    assert retrieval.hamming_blend_topk(vectors, query, passages, 10).count() == 10


def test_walk_passes_over_deleted_neighbours(spark):
    vectors = spark.createDataFrame([(i, [1.0, i / 200]) for i in range(200)], "idx bigint, v array<double>")
    primary = spark.createDataFrame([(0, 1.0), (1, 0.9)], "idx bigint, score double")
    deleted = vectors.filter("idx BETWEEN 2 AND 51").select("idx")
    got = retrieval.walk_expand(vectors, primary, deleted, show=20).filter("from_walk").collect()
    assert {r["idx"]: r["walk_count"] for r in got} == {i: 2 for i in range(52, 61)}


def test_retrieval_modes(spark):
    rows = spark.createDataFrame([(0, "s", "harbour ledger", True), (1, "s", "harbour ledger", False)], "idx bigint, source string, text string, tombstone boolean")
    assert [r["idx"] for r in token_retrieve(rows, "harbour ledger", 5).collect()] == [1]
    assert token_retrieve(rows, "harbour ledger", 5, mode="all").count() == 2
    with pytest.raises(ValueError):
        token_retrieve(rows, "harbour", 5, mode="some")


@pytest.mark.parametrize("idx,text,problem", [(9, "new", "unknown"), (1, " ", "blank"), (1, " one\n", "unchanged"), (1, None, "blank")])
def test_edits_that_are_refused(spark, idx, text, problem):
    rows = spark.createDataFrame([(1, "one", "s"), (2, "two", "s")], "idx bigint, text string, source string")
    edits = spark.createDataFrame([(idx, text)], "idx bigint, new_text string")
    for part in ("appended", "log"):
        with pytest.raises(Exception, match=problem):
            mutate.edit(rows, edits, F.current_timestamp())[part].select("*").collect()


@pytest.mark.parametrize("lo,hi", [(50, 10), (-1, 3), (0, 999)])
def test_ranges_that_are_refused(spark, lo, hi):
    rows = spark.range(100).select(F.col("id").alias("idx"), F.lit(3).alias("perms"))
    changes = spark.createDataFrame([(lo, hi, 1, 1)], "lo bigint, hi bigint, mask int, seq int")
    with pytest.raises(Exception, match="range outside"):
        mutate.set_perms(rows, changes).collect()


def test_null_vectors_take_no_part(spark):
    from lectern.operators.simjoin import similarity_left_join
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 1.0])], "idx bigint, v array<double>")
    found = retrieval.batch_topk(rows, rows.select(F.col("idx").alias("qid"), F.col("v").alias("q")), 2).collect()
    assert {r["qid"] for r in found} == {0, 1, 3} and 2 not in {r["idx"] for r in found}
    joined = {(r["left_idx"], r["right_idx"]) for r in similarity_left_join(rows, rows, 0.9).collect()}
    assert (2, None) in joined and (0, 1) in joined and not any(right == 2 for _, right in joined)
