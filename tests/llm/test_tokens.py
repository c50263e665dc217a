import bisect
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm.bpe import WordBpe, decode_documents, encode_documents, round_trip
from lectern.llm.chunk_encoder import ChunkEncoder
from lectern.llm.common import tokenizer_path
from lectern.llm.packing import best_fit, configurations, group_lengths, pack, pack_documents, plan, token_pieces
from lectern.llm.token_codec import (canonical_codes, code_lengths, decode_ids, decoding_table, encode_ids, in_ranges, lane_starts,
                                     read_token_ids, store_and_read, write_token_ids)
from lectern.llm.token_counts import SPACE, Counter, token_counts, vocabulary
from lectern.session import scratch_path

tokenizers = pytest.importorskip("tokenizers")
BYTES, WORDS, PIECES = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "  ", "a  b", " x ", "a\n b", "don't 'tis 's ''s", "x<|endoftext|> y <|startoftext|>", "tab\t x", "é Ü  z",
       "a\u0085 b", "1 2  33 ' ll", "İ ΑΣ 中文。", "é Å", "😀😀 ''' aaaa aaaaaaa", "▁x ▁", "<0x0A> <s>"]


def texts(spark, n=60):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(n).collect()
    rng = random.Random(3)
    made = ["".join(rng.choices(a, k=rng.randint(1, 18))) for a in (" 'srevlltmd.1 é\n", " \n\tab'AÉ1.!é中😀́Σ") for _ in range(400)]
    return [r["text"] for r in rows] + ODD + made


def test_byte_ids_equal_the_library(spark):
    library = tokenizers.Tokenizer.from_file(BYTES)
    many = texts(spark)
    for t, ids in zip(many, ChunkEncoder(BYTES).encode(many)):
        assert library.encode(t, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist(), t[:80]


def test_byte_ids_survive_a_full_memory(spark):
    many, small = texts(spark, 20), ChunkEncoder(BYTES, most=50)
    assert [x for t in many for x in small.encode([t])] == ChunkEncoder(BYTES).encode(many)


def test_word_bpe_equals_the_library(spark):
    library = tokenizers.Tokenizer.from_file(WORDS)
    many = texts(spark)
    for t, n, ids, decoded in zip(many, *WordBpe(WORDS).digest(many)):
        want = library.encode(t, add_special_tokens=False).ids
        assert n == len(want) and ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), t[:80]
        assert decoded == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_word_bpe_equals_the_library_on_every_code_point():
    """Letters, marks and signs in both cases, alone, within words and beside others."""
    library = tokenizers.Tokenizer.from_file(WORDS)
    library.no_truncation()
    library.no_padding()
    points = [chr(c) for c in [*range(0x3100), *range(0xF900, 0x10000), *range(0x1F300, 0x1F700)] if not 0xD800 <= c < 0xE000]
    texts = points + [f"ab{c}cd {c}1" for c in points]
    got = WordBpe(WORDS).encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_bpe_jobs(spark, odd, none):
    got = round_trip(odd, WORDS).collect()
    assert len(got) == odd.count() and round_trip(none, WORDS).count() == 0
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    library = tokenizers.Tokenizer.from_file(WORDS)
    decoded = {r["doc_id"]: r["text"] for r in decode_documents(encode_documents(odd, WORDS), WORDS).collect()}
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert decoded[r["doc_id"]] == library.decode(ids, skip_special_tokens=False)


def test_counts_equal_the_unigram_tokenizer(spark, odd, none):
    pieces, unknown = vocabulary(PIECES)
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=unknown, byte_fallback=True))
    library.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement=SPACE, prepend_scheme="always", split=False)
    rng = random.Random(6)
    many = texts(spark, 30) + ["a" + " " * 8 + "b", " " * 16, " ", "  x", "x  ", "def f():\n        return  [1,   2]\n" * 40]
    many += ["".join(rng.choice(["  ", " ", "word", "é", "\n    ", "▁", " " * rng.randrange(40), "x"]) for _ in range(60)) for _ in range(60)]
    for t, n in zip(many, Counter(pieces).totals(many)):
        assert n == len(library.encode(t, add_special_tokens=False).ids), t[:80]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(odd, PIECES).collect()}
    assert got[1] == got[2] == 0 and got[4] == got[5] > 0 and token_counts(none, PIECES).count() == 0


def test_counts_with_ties_and_without_bytes():
    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("ba", -1.5), (SPACE, -1.0)]
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=False))
    rng, count = random.Random(0), Counter(pieces)
    for _ in range(500):
        t = "".join(rng.choices("abxy", k=rng.randint(1, 9)))
        assert count.count(t) == len(library.encode(t).ids), t


@pytest.mark.parametrize("n,most", [(1, 18), (2, 18), (5, 3), (300, 9), (50_000, 18)])
def test_codes(n, most):
    rng = np.random.default_rng(n)
    counts = (1e7 / np.arange(1, n + 1) ** 1.3).astype(int) + 1
    rng.shuffle(counts)
    lengths = code_lengths(counts, most)
    assert lengths.max() <= most and (n == 1 or abs((0.5 ** lengths).sum() - 1) < 1e-9)
    ids = rng.choice(n, 9000, p=counts / counts.sum())
    per_doc = np.array([1, 2000, 0, 6999])
    raw, offsets = encode_ids(ids, lengths, canonical_codes(lengths))
    at, sizes = lane_starts(per_doc)
    assert (decode_ids(raw, offsets[at], sizes, decoding_table(lengths)) == ids).all()
    if n == 300:   # no length-limited code does better than one found by exhausting a small case
        assert (lengths * counts).sum() <= 9 * counts.sum()


def test_token_files(spark, odd, none):
    library = tokenizers.Tokenizer.from_file(BYTES)
    rows = odd.union(spark.createDataFrame([(100 + i, f"text number {i}", "en", "s", 1, *[None] * 8) for i in range(40)], odd.schema))
    folder = scratch_path(spark, "ids")
    write_token_ids(rows, BYTES, folder)
    stored = read_token_ids(spark, folder).orderBy("part", "block", "place").collect()
    want = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in rows.collect()]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["ids"])) for r in stored)
    ids = [r["doc_id"] for r in stored]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    spans = store_and_read(rows.filter("doc_id <> 6"), BYTES).orderBy("doc_id").collect()
    start, by_id = 0, dict(want)
    for r in spans:
        assert (r["start"], r["n_tokens"]) == (start, len(by_id[r["doc_id"]]))
        assert r["ids_crc32"] == zlib.crc32(np.array(by_id[r["doc_id"]], "<u4").tobytes())
        start += r["n_tokens"]
    assert store_and_read(none, BYTES).count() == 0


def test_ranges_are_in_order_and_even(spark):
    rows = spark.range(900).selectExpr("id AS doc_id").unionAll(spark.range(100).selectExpr("id + 10000000000")).unionAll(
        spark.sql("SELECT CAST(NULL AS BIGINT)"))
    parts = in_ranges(rows.repartition(3), 100).withColumn("at", F.spark_partition_id()).collect()
    held = {}
    for r in parts:
        held.setdefault(r["_part"], []).append(r["doc_id"])
    flat = [i for k in sorted(held) for i in held[k]]
    assert flat[0] is None and flat[1:] == sorted(flat[1:]) and max(map(len, held.values())) <= 150


def placed(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("kind", ["uniform", "one length", "small", "large", "empty"])
def test_packing_counts(spark, kind):
    rng = np.random.default_rng(5)
    lengths = {"uniform": rng.integers(1, 1025, 3000), "one length": np.full(800, 341), "small": rng.integers(1, 60, 2000),
               "large": rng.integers(520, 1025, 700), "empty": np.empty(0, int)}[kind]
    pieces = spark.createDataFrame([(int(i // 2), 0, 0, int(n), 1) for i, n in enumerate(lengths)],
                                   "doc_id long, piece int, start long, length int, ids_crc32 long")
    got = pack(pieces).collect()
    assert sorted(r["length"] for r in got) == sorted(lengths.tolist())
    used, least = placed(got, 1024), -(-int(lengths.sum()) // 1024)
    if kind == "large":
        assert used == len(lengths)
    elif kind == "one length":
        assert used == -(-len(lengths) // 3)
    elif kind == "uniform":
        assert used <= plain_best_fit(lengths)
    else:
        assert used <= least * 1.001 + 2


def plain_best_fit(lengths, capacity=1024):
    rooms, used = [], 0
    for n in sorted(lengths.tolist(), reverse=True):
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            used += 1
            bisect.insort(rooms, capacity - n)
        else:
            bisect.insort(rooms, rooms.pop(at) - n)
    return used


def test_plans_count_what_they_open():
    """The number of sequences a plan foretells is what its rows take, on the lengths of real documents and on equal rows."""
    rng = np.random.default_rng(11)
    lengths = np.concatenate([rng.integers(1, 1025, 4000), np.minimum(rng.zipf(1.3, 4000), 1024), np.full(300, 1024)])
    counts = np.bincount(lengths, minlength=1025)
    for groups in (64, 0):
        assert plan(counts, 1024, groups, 0.125)[3] <= -(-int(lengths.sum()) // 1024) * 1.02 + 2
    assert min(plan(counts, 1024, g, 0.125)[3] for g in (64, 0)) <= -(-int(lengths.sum()) // 1024) * 1.001 + 2


def test_packing_of_real_lengths_and_equal_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    twins = spark.createDataFrame([(None, None)] * 6000, "doc_id long, text string")
    pieces = token_pieces(docs.select("doc_id", "text").union(twins), BYTES)
    got = pack(pieces).collect()
    used, tokens = placed(got, 1024), sum(r["length"] for r in got)
    assert used <= -(-tokens // 1024) * 1.001 + 2
    library = tokenizers.Tokenizer.from_file(BYTES)
    library.no_truncation()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.limit(150).collect()}
    mine = {d: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == d) for d in texts}
    for d, t in texts.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert [p for p, _, _, _ in mine[d]] == list(range(len(mine[d]))) and mine[d][-1][1] + mine[d][-1][2] == len(ids)
        for piece, start, length, crc in mine[d]:
            assert zlib.crc32(ids[start:start + length].tobytes()) == crc and (piece == 0 or length == 1024)


def test_packing_documents(spark, odd, none):
    library = tokenizers.Tokenizer.from_file(BYTES)
    got = pack_documents(odd, BYTES).collect()
    placed(got, 1024)
    for r in odd.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        mine = sorted(((g["start"], g["length"]) for g in got if g["doc_id"] == r["doc_id"]))
        assert sum(length for _, length in mine) == n * (2 if r["doc_id"] == 6 else 1)
        assert all(length == 1024 for start, length in mine if start > 0)
    assert pack_documents(none, BYTES).count() == 0


def test_packing_steps():
    counts = np.zeros(101, np.int64)
    counts[[30, 50, 70]] = 40, 40, 40
    runs = group_lengths(counts, 3)
    assert runs == [(30, 30), (50, 50), (70, 70)]
    found = configurations(np.array([30, 50, 70]), np.array([40.0, 40.0, 40.0]), 100)
    assert sum(x for _, x in found) == 60     # 40 of 70 + 30, 20 of 50 + 50
    rest, rooms = np.zeros(101, np.int64), np.zeros(101, np.int64)
    rest[20], rooms[20], rooms[45] = 4, 1, 1
    moves = best_fit(rest, rooms, 100)
    assert sum(m[2] for m in moves) == 4 and [m for m in moves if m[0] == -1] == [(-1, 0, 1, 20)]
