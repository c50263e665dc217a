"""Token ids on disk: canonical length-limited Huffman codes in independent blocks.

A file set is a folder with two Parquet tables. ``codebook`` (id, bits) gives each id's code length, which
determines the canonical codes. ``blocks`` has one row per block of whole documents, in ascending doc_id
order by (part, block): the documents' ids and token counts, the encoded bits, and the bit offset of
a checkpoint every ``STRIDE`` tokens and at each document, from which decoding can start. Blocks need
nothing from each other, so they are encoded and decoded wherever they lie.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.ranking import with_range
from ..session import scratch_path
from .chunk_encoder import encoder
from .common import slices

BLOCK_TOKENS = 1 << 18
STRIDE = 1024
TOGETHER = 5 * BLOCK_TOKENS
MAX_BITS = 18
END_ID = 2
RAW = "part int, block int, doc_ids array<long>, counts array<int>, payload binary"
BLOCKS = "part int, block int, doc_ids array<long>, counts array<int>, checkpoints array<long>, payload binary"


# -- codes --------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Optimal prefix code lengths of at most ``most`` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids do not fit codes of {most} bits")
    order = np.argsort(counts[used], kind="stable")
    weights = counts[used][order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(most):
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weights))
        merged = both[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take, depth = 2 * len(weights) - 2, np.zeros(len(weights), np.int64)
    for single in levels[::-1]:
        leaves = int(single[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used[order]] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[order]
    top = int(sizes[-1]) if len(sizes) else 0
    widths = np.left_shift(np.uint64(1), (top - sizes).astype(np.uint64)) if len(sizes) else np.empty(0, np.uint64)
    starts = np.cumsum(widths) - widths
    codes[order] = np.right_shift(starts, (top - sizes).astype(np.uint64))
    return codes


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of ``ids``, most significant first, and the bit offset of each id and of the end."""
    sizes = lengths[ids]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    words = np.zeros((int(offsets[-1]) >> 5) + 3, np.uint64)
    if len(ids):
        word = offsets[:-1] >> 5
        shift = (64 - (offsets[:-1] & 31) - sizes).astype(np.uint64)
        bits = codes[ids] << shift                      # within the 64 bits from its word on
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        joined = np.bitwise_or.reduceat(bits, first)
        words[word[first]] |= joined >> np.uint64(32)
        words[word[first] + 1] |= joined & np.uint64(0xFFFFFFFF)
    raw = words.astype(">u4").tobytes()
    return raw[:(int(offsets[-1]) + 7) // 8], offsets


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Id (times 256) and length for every window of the longest code's bits."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    top = int(lengths.max(initial=1)) or 1
    many = np.left_shift(1, top - lengths[order])
    ids, sizes = np.repeat(order, many), np.repeat(lengths[order], many)
    spare = (1 << top) - len(ids)
    return np.concatenate([ids << 8 | sizes, np.ones(spare, np.int64)]), top


def decode_ids(payload: bytes, starts: np.ndarray, counts: np.ndarray, table) -> np.ndarray:
    """Ids from checkpoints: lane i reads ``counts[i]`` ids from bit ``starts[i]``; all lanes step together."""
    both, top = table
    halves = np.frombuffer(payload + b"\0" * (12 - len(payload) % 4), ">u4").astype(np.int64)
    words = halves[:-1] << 32 | halves[1:]              # the 64 bits from each 32nd bit on
    out = np.empty(int(counts.sum()), np.uint32)
    order = np.argsort(-counts, kind="stable")
    at, place = starts[order].astype(np.int64), (np.cumsum(counts) - counts)[order]
    live_at = np.searchsorted(-counts[order], -np.arange(1, int(counts.max(initial=0)) + 1), side="right")
    spare, mask = 64 - top, (1 << top) - 1
    for live in live_at.tolist():
        bits, to = at[:live], place[:live]
        key = words[bits >> 5]
        key <<= bits & 31
        key >>= spare
        key &= mask
        found = both[key]
        out[to] = found >> 8
        to += 1
        found &= 255
        bits += found
    return out


# -- writing ------------------------------------------------------------------------------------


def _raw_blocks(docs: DataFrame, path: str, end_id: int, narrow: bool) -> DataFrame:
    """Blocks of unencoded ids per task, after a row of the task's counts (block -1)."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        coder = encoder(path)
        size = max(coder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        totals = np.zeros(size, np.int64)
        block, part, held, doc_ids, counts, tokens = 0, 0, [], [], [], 0

        def flush():
            ids = np.concatenate(held)
            np.add(totals, np.bincount(ids, minlength=size), out=totals)
            payload = (np.concatenate([ids.astype(np.uint8), (ids >> 8).astype(np.uint8)]).tobytes() if narrow  # low bytes, then high
                       else ids.astype("<u4").tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([counts], pa.list_(pa.int32())), pa.array([payload], pa.binary())], names=names)

        names = ["part", "block", "doc_ids", "counts", "payload"]
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                for doc, here, raw in zip(piece.column("doc_id").to_pylist(), piece.column("_part").to_pylist(),
                                          coder.encode(texts)):
                    if held and (here != part or tokens >= BLOCK_TOKENS):
                        yield flush()
                        block = block + 1 if here == part else 0
                        held, doc_ids, counts, tokens = [], [], [], 0
                    part = here
                    ids = np.frombuffer(raw + tail, "<u4")
                    held.append(ids)
                    doc_ids.append(doc)
                    counts.append(len(ids))
                    tokens += len(ids)
        if held:
            yield flush()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([-1], pa.int32()), pa.array([None], pa.list_(pa.int64())),
                 pa.array([None], pa.list_(pa.int32())), pa.array([totals.astype("<i8").tobytes()], pa.binary())],
                names=names)

    return docs.mapInArrow(run, RAW)


def in_ranges(docs: DataFrame, rows_per_range: int = 5000) -> DataFrame:
    """Rows dealt to ascending quantile ranges of doc_id (column _part), sorted within each; a range holds about
    ``rows_per_range`` rows, whatever the spread of the ids, and rows without an id come first."""
    steps = math.ceil(math.sqrt(max(1, docs.select("doc_id").count()) / rows_per_range))
    dealt = docs.withColumn("_range", F.lit(0)) if steps == 1 else with_range(docs, "doc_id", steps)
    return dealt.select(*docs.columns, F.col("_range").cast("int").alias("_part")).repartitionById(
        steps * steps, F.col("_part")).sortWithinPartitions("_part", F.asc_nulls_first("doc_id"))


def write_token_ids(docs: DataFrame, path: str, out: str, end_id: int = END_ID) -> None:
    """Encode every text and write the file set ``out`` in ascending doc_id order.

    A null or empty text is its end id alone. Rows with the same doc_id stay separate, next to each other;
    a null doc_id is kept and comes first. A document stays in one block, however long. An empty
    table gives an empty file set. Other columns are not read.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    vocab = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    narrow = vocab <= 1 << 16
    raw_path = scratch_path(spark, "ids")
    _raw_blocks(in_ranges(docs.select("doc_id", "text")), path, end_id, narrow).write.option(
        "compression", "zstd").parquet(raw_path)
    raw = spark.read.parquet(raw_path)

    def tally(batches):
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            for b in batch.column("payload"):
                total += np.frombuffer(b.as_buffer(), "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    counts = np.zeros(vocab, np.int64)
    for r in raw.filter("block = -1").select("payload").mapInArrow(tally, "id long, n long").groupBy("id").agg(
            F.sum("n").alias("n")).collect():          # one row per id of the vocabulary
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, max(MAX_BITS, int(vocab - 1).bit_length() + 2))
    book = [(i, int(lengths[i])) for i in np.flatnonzero(lengths).tolist()]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{out}/codebook")

    def encode(batches):
        codes = canonical_codes(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                packed = row["payload"]
                if narrow:
                    low, high = np.frombuffer(packed, np.uint8).reshape(2, -1).astype(np.int64)
                    ids = high << 8 | low
                else:
                    ids = np.frombuffer(packed, "<u4").astype(np.int64)
                bits, offsets = encode_ids(ids, lengths, codes)
                marks = offsets[lane_starts(np.array(row["counts"], np.int64))[0]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]], pa.int32()), pa.array([row["block"]], pa.int32()),
                     pa.array([row["doc_ids"]], pa.list_(pa.int64())), pa.array([row["counts"]], pa.list_(pa.int32())),
                     pa.array([marks], pa.list_(pa.int64())), pa.array([bits], pa.binary())],
                    names=["part", "block", "doc_ids", "counts", "checkpoints", "payload"])

    raw.filter("block >= 0").mapInArrow(encode, BLOCKS).write.option("compression", "zstd").parquet(f"{out}/blocks")


def lane_starts(counts: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Token positions of the checkpoints, at each document and each ``stride`` within it, and lane sizes."""
    lanes = -(-counts // stride)
    base = np.repeat(np.cumsum(counts) - counts, lanes)
    step = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    sizes = np.minimum(np.repeat(counts, lanes) - step * stride, stride)
    return base + step * stride, sizes


# -- reading ------------------------------------------------------------------------------------


def _lengths(spark: SparkSession, folder: str) -> np.ndarray:
    book = spark.read.parquet(f"{folder}/codebook").toArrow()   # one row per id of the vocabulary
    lengths = np.zeros(int(max(book.column("id").to_pylist(), default=0)) + 1, np.int64)
    lengths[book.column("id").to_numpy()] = book.column("bits").to_numpy()
    return lengths


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """part, block, place (within the block), doc_id, n_tokens, ids (array of int), decoded block by block."""
    return _decoded(spark, folder, lambda ids: ids.astype(np.int64).tolist(), "ids array<int>")


def decode_blocks(rows: Iterable[dict], table) -> Iterator[tuple[dict, np.ndarray]]:
    """Each block and its ids. Several are decoded at once, about ``TOGETHER`` ids: a step over the lanes of all costs
    little more than one over those of a single block."""
    for held in _runs(rows):
        bits = np.cumsum([0, *(8 * len(row["payload"]) for row in held)]).tolist()
        counts = [np.array(row["counts"], np.int64) for row in held]
        starts = [np.array(row["checkpoints"], np.int64) + at for row, at in zip(held, bits)]
        ids = decode_ids(b"".join(row["payload"] for row in held), np.concatenate(starts), lane_starts(np.concatenate(counts))[1], table)
        yield from zip(held, np.split(ids, np.cumsum([n.sum() for n in counts])[:-1]))


def _runs(rows: Iterable[dict]) -> Iterator[list[dict]]:
    held, tokens = [], 0
    for row in rows:
        n = sum(row["counts"])
        if held and tokens + n > TOGETHER:
            yield held
            held, tokens = [], 0
        held.append(row)
        tokens += n
    if held:
        yield held


def _decoded(spark: SparkSession, folder: str, of_ids, column: str) -> DataFrame:
    lengths = _lengths(spark, folder)
    name, columns = column.split()[0], f"part int, block int, place int, doc_id long, n_tokens long, {column}"
    schema = to_arrow_schema(StructType.fromDDL(columns))

    def decode(batches):
        table = decoding_table(lengths)
        for batch in batches:
            for row, ids in decode_blocks(batch.to_pylist(), table):
                counts = row["counts"]
                ends = np.cumsum(counts).tolist()
                cols = {"part": [row["part"]] * len(counts), "block": [row["block"]] * len(counts),
                        "place": list(range(len(counts))), "doc_id": row["doc_ids"], "n_tokens": counts,
                        name: [of_ids(ids[e - n:e]) for e, n in zip(ends, counts)]}
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)

    return spark.read.parquet(f"{folder}/blocks").mapInArrow(
        decode, columns)


def token_spans(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    docs = _decoded(spark, folder, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32 long")
    blocks = spark.read.parquet(f"{folder}/blocks").select(
        "part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    parts = blocks.groupBy("part").agg(F.sum("n").alias("_n"))      # one row per range of documents
    parts = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_part_from"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_from", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part").select(
        "part", "block", (F.col("_from") + F.col("_part_from")).alias("_start"))
    inside = Window.partitionBy("part", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("_before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(
        starts, ["part", "block"]).select(
        "doc_id", (F.col("_start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write a file set below the shared folder and describe its documents from it. Jobs run at once, since
    codes need the global counts before anything can be encoded."""
    folder = scratch_path(docs.sparkSession, "token-ids")
    write_token_ids(docs, path, folder, end_id)
    return token_spans(docs.sparkSession, folder)
