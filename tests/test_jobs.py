"""Sources, access grid, changes, plans and streams."""
import io
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import access, mutate
from lectern.operators import retrieval as rt
from lectern.plans import registry
from lectern.sources import archives, corpus_io, documents
from lectern.functions import flags as fl
from conftest import SMALL


def archive(**arrays):
    buf = io.BytesIO()
    np.savez(buf, **arrays)
    return buf.getvalue()


def test_archives_text_fallbacks(spark):
    import zlib
    v = np.ones((2, 3), dtype=np.float32)
    blob = np.array([zlib.compress(b"hello"), zlib.compress(b"you")], dtype=object)
    packed = np.array([np.frombuffer(b, dtype=np.uint8) for b in (b"ab",)])
    files = [("a", archive(embeddings=v, passages=np.array(["p", "q"]))), ("b", archive(embeddings=v))]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {(r["path"], r["idx"]): r["text"] for r in archives.ingest(df).collect()}
    assert got == {("a", 0): "p", ("a", 1): "q", ("b", 0): "", ("b", 1): ""}
    for bad in (archive(passages=np.array(["x"])), archive(embeddings=v, passages=blob)):
        with pytest.raises(Exception):
            archives.ingest(spark.createDataFrame([("c", bad)], "path string, content binary")).collect()
    assert packed.shape == (1, 2)


def test_archives_are_read_a_few_rows_at_a_time(spark, monkeypatch):
    """One long text makes every row of the text array that wide."""
    text = np.array(["x" * 40_000] + [f"t{i}" for i in range(199)])
    v = np.arange(400, dtype=np.float64).reshape(200, 2)
    content = archive(embeddings=np.asfortranarray(v), passages=text, source_paths=np.array(["s"] * 150), hippocampus=np.full((200, 64), 3, np.uint8))
    z = zipfile.ZipFile(io.BytesIO(content))
    read = archives._Rows(z, "passages")
    assert read.row_bytes == 160_000 and len(read.take(3)) == 3 and read.take(200)[-1] == "t198"
    monkeypatch.setattr(archives, "BYTES_PER_BATCH", 1 << 20)
    got = archives.ingest(spark.createDataFrame([("a", content)], "path string, content binary")).orderBy("idx").collect()
    assert [r["text"] for r in got] == text.tolist() and [list(r["v"]) for r in got] == v.tolist()
    assert [r["source"] for r in got] == ["s"] * 150 + [""] * 50 and {bytes(r["block"]) for r in got} == {b"\3" * 64}


def test_a_large_block_is_written_by_several_tasks(spark):
    from lectern.session import scratch_path
    path = scratch_path(spark, "ranges")
    rows = spark.range(4000).select("id", F.lit("c").alias("corpus_id"), F.col("id").alias("idx"), F.lit(False).alias("tombstone"))
    with_files = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in with_files.items():
        spark.conf.set(k, v)
    try:
        corpus_io.write_corpus(rows, path)
    finally:
        for k in with_files:
            spark.conf.unset(k)
    spans = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).orderBy("lo").collect()
    assert len(spans) > 1 and all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]))


def test_a_built_corpus_numbers_rows_without_their_texts(spark, monkeypatch):
    from lectern.operators import build, ranking
    numbered, real = [], ranking.in_order
    monkeypatch.setattr(ranking, "in_order", lambda df, *a, **k: numbered.append(df.columns) or real(df, *a, **k))
    docs = spark.createDataFrame([(2, "s", "b\nc"), (1, "s", "a"), (3, "r", " "), (4, "r", "d")], "doc_id bigint, source string, text string")
    got = build.build_corpus(docs, "doc_id", 1, 0)["passages"].orderBy("idx").collect()
    assert [(r["text"], r["label"], r["prev_idx"], r["next_idx"]) for r in got] == [
        ("a", "s (part 1/3)", None, 1), ("b", "s (part 2/3)", 0, 2), ("c", "s (part 3/3)", 1, None), ("d", "r", None, None)]
    assert numbered and not any("text" in columns for columns in numbered)


@pytest.mark.parametrize("version", [1, 2, 3])
def test_unpack_block_versions(spark, version):
    import struct
    fmt = "<IBBIIIHHHIBBB33s" if version == 3 else "<IBBIIIIHIBBB33s"
    source = (513, 0) if version == 3 else (4_000_000_000,)
    raw = struct.pack(fmt, 9, version, 1, 8, 0, 0, *source, 5, 1_700_000_000, 33, 2, 17, b"")
    r = spark.createDataFrame([(raw,)], "b binary").select(archives.unpack_block(F.col("b")).alias("r")).first()["r"]
    assert (r["pattern_id"], r["prev_idx"], r["next_idx"], r["sequence"], r["ts_unix"]) == (9, 7, None, 5, 1_700_000_000)
    assert (r["flags"], r["perms"], r["lifecycle"]) == (33, 2, 17)
    assert (r["source_hash"], r["source_idx"]) == ((None, 513) if version == 3 else (4_000_000_000, None))


@pytest.mark.parametrize("level,exposure,read", [
    ("viewer", "viewer", True), ("viewer", "editor", False), ("editor", "commenter", True), ("owner", "editor", True),
    (None, "viewer", False), ("editor", "nonsense", False)])
def test_exposure_grid(spark, level, exposure, read):
    row = spark.createDataFrame([(level, True, exposure, None, None, level == "owner")],
                                "corpus_level string, inherit boolean, exposure string, exception string, perms int, is_owner boolean")
    assert access.resolve_object(row).first()["may_read"] is read


def test_deny_beats_owner_and_bits_bind_everyone(spark):
    rows = [("owner", True, None, "deny", 3, True), ("owner", True, None, None, 2, True), (None, True, None, None, None, False),
            (None, False, None, None, None, False)]
    df = spark.createDataFrame(rows, "corpus_level string, inherit boolean, exposure string, exception string, perms int, is_owner boolean")
    got = [(r["may_read"], r["may_write"], r["origin"]) for r in access.resolve_object(df.coalesce(1)).collect()]
    assert got == [(False, False, "exception"), (False, True, "owner"), (True, True, "inherited"), (False, False, "withheld")]


def test_rejections(spark, tables):
    bad = spark.createDataFrame([(9,)], "s int")
    with pytest.raises(Exception, match="0..7"):
        bad.select(fl.encode_lifecycle(F.col("s"), F.lit(False), F.lit(False), F.lit(False))).collect()
    with pytest.raises(Exception, match="blank"):
        mutate.append(tables.passages, spark.createDataFrame([(1, "  ")], "o bigint, text string"), "o").collect()
    ranges = spark.createDataFrame([(0, 10**9, 1, 0)], "lo bigint, hi bigint, mask int, seq int")
    with pytest.raises(Exception, match="outside"):
        mutate.set_perms(tables.block.select("idx", "perms"), ranges).collect()


def test_succession_chain_and_cycle(spark):
    links = spark.createDataFrame([(f"k{i}", f"k{i + 1}", i) for i in range(9)] + [("x", "y", 0), ("y", "x", 1), ("w", "x", 2)],
                                  "old_key string, new_key string, ts int")
    keys = spark.createDataFrame([(k,) for k in ("k0", "k5", "k9", "x", "w", "other")], "key string")
    got = {r["key"]: r["current"] for r in mutate.resolve_succession(keys, links).collect()}
    assert got == {"k0": "k9", "k5": "k9", "k9": "k9", "x": "x", "w": "w", "other": "other"}


def test_restore_wins_when_later(spark):
    p = spark.createDataFrame([(1, "s", False), (2, "s", True)], "idx bigint, source string, tombstone boolean")
    log = spark.createDataFrame([(1, "delete", 1), (1, "restore", 2), (2, "restore", 1), (2, "delete", 3)], "idx bigint, op string, ts int")
    assert {r["idx"]: r["tombstone"] for r in mutate.apply_log(p, log).collect()} == {1: False, 2: True}


def test_written_corpus_prunes_blocks(spark, tables, tmp_path):
    path = str(tmp_path / "c")
    corpus_io.write_corpus(tables.passages.withColumn("corpus_id", F.lit("c")), path)
    stored = corpus_io.scan_passages(spark, path)
    few = rt.best(tables.vectors.select("idx", rt.vx.cosine("v", tables.query_vec).alias("score")), 5)
    joined = rt.with_passages(few, stored)
    plan = joined._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() and joined.count() > 0


def test_json_inputs(spark):
    lines = spark.createDataFrame([('{"text": "a"}',), ('{"content": "b"}',), ("oops {",), ("  ",), ('{"x": 1}',)], "value string")
    assert [r["text"] for r in documents.read_jsonl(lines.coalesce(1)).collect()] == ["a", "b", "oops {", '{"x": 1}']


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    q = registry.all_queries()
    top = explained(q["t1_topk"](spark, SMALL))
    assert "TakeOrderedAndProject" in top and "CartesianProduct" not in top
    flagship = explained(q["v3_hamming_blend_topk"](spark, SMALL))
    assert "BroadcastHashJoin" in flagship and "CartesianProduct" not in flagship and "NestedLoop" not in flagship
    live = explained(q["p17_indexed_paths"](spark, SMALL))
    assert "n_chars" not in live


def test_no_cross_products(spark):
    q = registry.all_queries()
    for name in ("v10_walk_from", "u4_diff_exact", "k9_retrieve_with_fallback", "t3_page", "g5_resolve_object", "m6_set_perms"):
        plan = explained(q[name](spark, SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_stream_ingest_cuts_long_texts(spark, tmp_path):
    """Texts beyond 300 words are stored in chunks, each content once; a chunk may come from several turns."""
    from lectern.operators import build
    lines = [" ".join(f"w{i}-{j}" for j in range(40)) for i in range(20)]
    texts = {"long": "\n".join(lines), "tail": "\n".join(lines[5:]), "one": " ".join(lines), "short": "a b\nc"}
    rows = [(0, 0, "user", texts["long"]), (0, 1, "agent", texts["long"]), (1, 0, "user", texts["tail"]), (1, 1, "user", texts["one"]),
            (2, 0, "user", texts["short"]), (2, 1, "agent", " ")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r["content_key"], r["source"], r["text"]) for r in registry.all_queries()["z9_stream_ingest"](spark, str(tmp_path)).collect())
    want = {}
    for _, _, role, text in rows[:-1]:
        for part in build.line_chunks(text, 300, 50):
            want[part] = min(role, want.get(part, role))
    assert {text: source for _, source, text in got} == want and len(got) == len(want) == 6
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    sql = con.execute(registry.all_sql()["z9_stream_ingest"])
    at = [[d[0] for d in sql.description].index(c) for c in ("content_key", "source", "text")]
    assert sorted(tuple(r[i] for i in at) for r in sql.fetchall()) == got


def test_a_fingerprint_writes_out_two_vectors(spark):
    """Every vector was written as text before the first and last were picked."""
    import hashlib
    rows = spark.createDataFrame([(3, [0.25, -1.5]), (1, [0.1234567, 2.0]), (2, None)], "idx bigint, v array<double>")
    df = corpus_io.fingerprint(rows)
    got = df.first()
    assert (got["count"], got["fingerprint"]) == (3, hashlib.sha256(b"123457,2000000|250000,-1500000|3").hexdigest()[:16])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by(v" in plan and plan.index("array_join") < plan.index("min_by(v")
