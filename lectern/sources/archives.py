"""Array archives (.npz) and their 64-byte passage blocks."""
from __future__ import annotations

import io
import math
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_SCHEMA = ("path string, idx bigint, text string, source string, v array<float>, block binary")
# Names of the arrays in an archive.
EMBEDDINGS, PASSAGES, COMPRESSED, SOURCES, BLOCKS = (
    "embeddings", "passages", "compressed_texts", "source_paths", "hippocampus")
ROWS_PER_BATCH = 1024
BYTES_PER_BATCH = 16 << 20


class _Rows:
    """The rows of one array of an archive, read a few at a time. A text array has the width of its longest text in
    every row, so that a whole one may take far more memory than its archive."""

    def __init__(self, z: zipfile.ZipFile, name: str):
        with z.open(f"{name}.npy") as f:
            self.n, self.by_rows = self._header(f)
        if self.by_rows:
            self.file = z.open(f"{name}.npy")
            self._header(self.file)
        else:       # stored by columns, or without rows: the array itself
            with z.open(f"{name}.npy") as f:
                self.whole = np.lib.format.read_array(f, allow_pickle=False)
        self.at = 0

    def _header(self, f) -> tuple[int, bool]:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_columns, self.kind = read(f)
        if self.kind.hasobject:
            raise ValueError("Object arrays cannot be loaded when allow_pickle=False")
        if not shape:
            raise TypeError("an array of an archive has no rows")
        self.shape = shape[1:]
        self.row_bytes = max(1, math.prod(self.shape) * self.kind.itemsize)
        return shape[0], not by_columns or len(shape) == 1

    def take(self, n: int) -> np.ndarray:
        n = min(n, self.n - self.at)
        self.at += n
        if not self.by_rows:
            return self.whole[self.at - n:self.at]
        count = n * math.prod(self.shape)
        if not count or not self.kind.itemsize:
            return np.zeros((n, *self.shape), self.kind)
        raw = self.file.read(count * self.kind.itemsize)
        return np.frombuffer(raw, self.kind, count).reshape(n, *self.shape)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return ingest(spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content"))


def ingest(files: DataFrame) -> DataFrame:
    """(path, content) -> one row per passage; an archive without embeddings, or with pickled
    arrays, is an error. Text comes from ``passages``, else the inflated texts, else is empty. A few rows of an archive's
    arrays are held at once, however many it has and however long its longest text is."""

    def rows(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    stored = {name[:-4] for name in z.namelist() if name.endswith(".npy")}
                    if EMBEDDINGS not in stored:
                        raise ValueError(f"{path}: no embeddings")
                    text = PASSAGES if PASSAGES in stored else COMPRESSED
                    others = {name: _Rows(z, name) for name in (text, SOURCES, BLOCKS) if name in stored}
                    vectors, at = _Rows(z, EMBEDDINGS), 0
                    # the widest array says how many rows are held at once
                    step = max(1, min(ROWS_PER_BATCH, BYTES_PER_BATCH // max(x.row_bytes for x in (vectors, *others.values()))))
                    while at < vectors.n:
                        part = np.asarray(vectors.take(step), dtype=np.float32)
                        size = len(part)
                        held = {name: (list(x.take(size)) + [None] * size)[:size] for name, x in others.items()}
                        read = (lambda t: zlib.decompress(bytes(t)).decode("utf-8", "replace")) if text == COMPRESSED else str
                        none = [None] * size
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * size), pa.array(np.arange(at, at + size)),
                             pa.array(["" if t is None else read(t) for t in held.get(text, none)]),
                             pa.array(["" if s is None else str(s) for s in held.get(SOURCES, none)]),
                             pa.array(list(part), pa.list_(pa.float32())),
                             pa.array([None if b is None else bytes(b) for b in held.get(BLOCKS, none)], pa.binary())],
                            names=["path", "idx", "text", "source", "v", "block"])
                        at += size

    return files.select("path", "content").mapInArrow(rows, ROW_SCHEMA)


def _uint(block: Column, offset: int, size: int) -> Column:
    """Little-endian unsigned integer at a byte offset."""
    digits = F.concat(*[F.hex(F.substring(block, offset + i + 1, 1)) for i in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("bigint")


def unpack_block(block: Column) -> Column:
    """Typed fields of a 64-byte block; byte 4 tells whether offset 18 holds a source hash
    (formats 1 and 2) or a source index (format 3). Links are 1-based, 0 means none."""
    version = _uint(block, 4, 1)
    third = version == 3

    def link(offset):
        raw = _uint(block, offset, 4)
        return F.when(raw > 0, raw - 1)

    return F.struct(
        _uint(block, 0, 4).alias("pattern_id"), version.cast("int").alias("format_version"),
        _uint(block, 5, 1).cast("int").alias("corpus_type"), link(6).alias("prev_idx"), link(10).alias("next_idx"),
        F.when(~third, _uint(block, 18, 4)).alias("source_hash"), F.when(third, _uint(block, 18, 2)).alias("source_idx"),
        _uint(block, 22, 2).alias("sequence"), _uint(block, 24, 4).alias("ts_unix"),
        _uint(block, 28, 1).cast("int").alias("flags"), _uint(block, 29, 1).cast("int").alias("perms"),
        _uint(block, 30, 1).cast("int").alias("lifecycle"))
