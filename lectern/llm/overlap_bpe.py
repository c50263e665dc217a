"""Byte-level BPE by ranks over overlapping chunks of a text, and decoding by laying raw bytes end to end.

A text beyond ``chunk`` characters becomes overlapping chunks, which Spark deals out as rows of their own. Each chunk is
pre-tokenised from its own first character, wherever that falls, and so is the overlap from the next chunk's first
character. The pattern looks at nothing before a match, so both agree from the first boundary they share: there the
pieces are cut, and each piece is encoded as a text of its own. Chunks without such a place between them (one
run of letters, say, longer than the overlap) stay one piece, so memory follows the longest pre-token.
"""
from __future__ import annotations

import base64
import hashlib
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .chunk_encoder import SPACES
from .common import per_batch, slices

CHUNK, OVERLAP = 32_768, 1024
_KEPT: dict[str, tuple] = {}


def _loaded(path: str) -> tuple:
    """The worker's encoding, pattern and raw bytes by id of the rank file ``path``."""
    if path not in _KEPT:
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _KEPT[path] = encoding, regex.compile(public_tokenizers.PATTERN), {i: raw for raw, i in ranks.items()}
    return _KEPT[path]


def _kind(c: str) -> str:
    """L, N or o for characters that every Unicode version since 3.2 puts there; empty for space and others."""
    code = unicodedata.ucd_3_2_0.category(c)
    return "" if c in SPACES or code in ("Cn", "Co", "Cs") else code[0] if code[0] in "LN" else "o"


def meeting_place(pattern, text: str, at: int, least: int = 0) -> int | None:
    """First boundary at or behind ``at + least`` that pre-tokenising from 0 and from ``at`` share, with characters of
    different kinds and no space before it, so that neither piece's look-ahead crosses it."""
    def starts(begin: int) -> list[int]:
        # the last two matches may be cut short by the end of the text
        return [m.start() for m in pattern.finditer(text, begin)][:-2]

    both = set(starts(at))
    for p in starts(0):
        if p >= max(at + least, 1) and p in both and text[p - 1] != "'":
            before, here = _kind(text[p - 1]), _kind(text[p]) or " "
            if before and before != here and (here != " " or text[p] in " \n\t"):
                return p
    return None


def _chunks(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id, row, chunk, text, meets: overlapping chunks, and where in each the next one's piece starts."""
    def cut(batch):
        for part in slices(batch, "text", 1_000_000):
            out = [(doc, row, n, text[a:a + chunk + overlap])
                   for doc, row, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row", "text")))
                   for n, a in enumerate(range(0, len(text), chunk))]
            yield dict(zip(("doc_id", "row", "chunk", "text"), zip(*out)))

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    # rows are numbered within a task, so they are fixed before they are dealt out
    dealt = materialize(per_batch(numbered, "doc_id long, row long, chunk int, text string", cut), "chunks")

    def meet(batch):
        _, pattern, _ = _loaded(path)
        for part in slices(batch, "text", 1_000_000):
            found = [meeting_place(pattern, t, chunk) if len(t) > chunk else None for t in part.column("text").to_pylist()]
            yield {**{c: part.column(c) for c in ("doc_id", "row", "chunk", "text")}, "meets": found}

    return per_batch(dealt.repartition("row", "chunk"), "doc_id long, row long, chunk int, text string, meets int", meet)


def _pieces(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id, row, piece, text: texts cut where neighbouring chunks agree."""
    marked = materialize(_chunks(docs, path, chunk, overlap), "marked-chunks")
    order = Window.partitionBy("row").orderBy("chunk")
    places = marked.select("row", "chunk", "meets").withColumn("from", F.lag("meets").over(order) - chunk) \
        .withColumn("piece", F.count("from").over(order).cast("int")).withColumn("more", F.lead("chunk").over(order).isNotNull())
    parts = marked.drop("meets").join(places, ["row", "chunk"]).withColumn("text", F.expr(
        f"substring(text, coalesce(from, 0) + 1, CASE WHEN meets IS NOT NULL THEN meets WHEN more THEN {chunk} "
        "ELSE 2147483647 END - coalesce(from, 0))"))
    return parts.groupBy("row", "piece").agg(
        F.min("doc_id").alias("doc_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))),
                                                                  lambda x: x["text"]), "").alias("text"))


def _halves(docs: DataFrame, path: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, row, piece, text: short texts, with a null row, and the pieces of long ones."""
    if not 0 < overlap < chunk:
        raise ValueError("an overlap is shorter than a chunk")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = docs.filter(F.length("text") <= chunk).select(
        "doc_id", F.lit(None).cast("long").alias("row"), F.lit(0).alias("piece"), "text")
    return short, _pieces(docs.filter(F.length("text") > chunk), path, chunk, overlap).select(*short.columns)


def _ids(path: str, texts: list[str]) -> list[bytes]:
    encoding, _, _ = _loaded(path)
    return [np.array(encoding.encode_ordinary(t), "<u4").tobytes() for t in texts]


def _raw(path: str, ids: list[bytes]) -> list[bytes]:
    _, _, table = _loaded(path)
    return [b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, row, piece, ids: the ids of every piece as little-endian unsigned 32-bit integers.

    Pieces of a text share ``row`` and follow each other by ``piece``. A text of at most ``chunk`` characters is one piece
    with a null ``row`` and goes through no shuffle. A null text counts as empty; an empty text has one piece without ids.
    Rows that repeat, or lack, a doc_id are rows of their own. Columns besides doc_id and text are not read. Chunks of
    long texts are written below ``spark.checkpoint.dir`` when this is called.
    """
    def work(batch):
        for part in slices(batch, "text", 4_000_000):
            yield {**{c: part.column(c) for c in ("doc_id", "row", "piece")}, "ids": _ids(path, part.column("text").to_pylist())}

    short, long = _halves(docs, path, chunk, overlap)
    return per_batch(short.unionByName(long), "doc_id long, row long, piece int, ids binary", work)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with ``raw``, the bytes that the ids stand for; a piece may end within a character."""
    def work(batch):
        for part in slices(batch, "ids", 4_000_000):
            yield {**{c: part.column(c) for c in ("doc_id", "row", "piece", "ids")}, "raw": _raw(path, part.column("ids").to_pylist())}

    return per_batch(encoded, "doc_id long, row long, piece int, ids binary, raw binary", work)


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``: encoded, then decoded from the ids.

    Short texts are digested where they are encoded. Pieces of a long one meet in the order of the text and are hashed as
    they stream by, so no text is held whole. Nulls, empty texts and repeated rows as in ``encode``.
    """
    def whole(batch):
        for part in slices(batch, "text", 4_000_000):
            ids = _ids(path, part.column("text").to_pylist())
            yield {"doc_id": part.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids],
                   "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                   "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in _raw(path, ids)]}

    def pieces(batch):
        for part in slices(batch, "text", 4_000_000):
            ids = _ids(path, part.column("text").to_pylist())
            yield {**{c: part.column(c) for c in ("doc_id", "row", "piece")}, "ids": ids, "raw": _raw(path, ids)}

    def streamed(batches):
        import pyarrow as pa

        fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        row, state = None, None

        def closed():
            return {"doc_id": state[0], "n_tokens": state[1], "ids_sha256": state[2].hexdigest(), "decoded_sha256": state[3].hexdigest()}

        for batch in batches:
            out = []
            for r, doc, ids, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "ids", "raw"))):
                if state is None or r != row:
                    if state:
                        out.append(closed())
                    row, state = r, [doc, 0, hashlib.sha256(), hashlib.sha256()]
                state[1] += len(ids) // 4
                state[2].update(ids)
                state[3].update(raw)
            yield pa.RecordBatch.from_pylist(out, fields)
        if state:
            yield pa.RecordBatch.from_pylist([closed()], fields)

    short, long = _halves(docs, path, chunk, overlap)
    coded = per_batch(long, "doc_id long, row long, piece int, ids binary, raw binary", pieces)
    return per_batch(short, _DIGESTS, whole).unionByName(
        coded.repartition("row").sortWithinPartitions("row", "piece").mapInArrow(streamed, _DIGESTS))
