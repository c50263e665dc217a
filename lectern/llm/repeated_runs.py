"""Runs of words that occur elsewhere word for word, wherever lines begin and end: winnowed fingerprints, then all runs near them.

Any two equal runs of ``run_words`` words pick the same fingerprint (the least hash of ``PRINT`` words within them), so texts
without a repeated fingerprint hold no repeated run. Only around repeated fingerprints is every run looked up by its hash.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .common import per_batch, slices
from .shingles import _powers, mix, word_hashes

_WORDS = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")   # as in shingles, before lower case


def _print_words(run_words: int) -> int:
    return run_words // 2 + 1


def _rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    power, back = _powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:len(words)])])
    return mix((sums[n:] - sums[:-n]) * back[:len(sums) - n])


def _slide(op, x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while n * 2 <= w:
        x, n = op(x[:-n], x[n:]), n * 2
    return op(x[:len(x) - (w - n)], x[w - n:]) if n < w else x


def _fingerprints(words: np.ndarray, run_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of a text of at least ``run_words`` words."""
    n = _print_words(run_words)
    hashes, w = _rolling(words, n), run_words - n + 1
    least = _slide(np.minimum, hashes, w)
    at = np.flatnonzero(_slide(np.maximum, np.pad(least, w - 1), w) == hashes)
    return at, hashes[at]


def _texts(part: pa.RecordBatch, run_words: int):
    words, at = word_hashes(part.column("text"))
    for i in np.flatnonzero(np.diff(at) >= run_words).tolist():
        yield i, words[at[i]:at[i + 1]]


def repeated_runs(docs: DataFrame, run_words: int) -> DataFrame:
    """doc_id, row, starts, first_docs: the rows (by doc_id and ``row_hash`` of the text) with runs of ``run_words`` words that
    occur earlier by (doc_id, row, place), the words at which these runs start, and the documents of their first occurrences.

    A run that overlaps its first occurrence in the same text is not listed. Words are compared in lower case.
    """
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", row_hash().alias("row"), "text")

    def prints(batch):
        for part in slices(batch, "text", 1_000_000):
            of, found, counts = [], [], []
            for i, words in _texts(part, run_words):
                one, n = np.unique(_fingerprints(words, run_words)[1], return_counts=True)
                of.append(np.full(len(one), i))
                found.append(one)
                counts.append(n)
            if of:
                at = pa.array(np.concatenate(of))
                yield {"doc_id": part.column("doc_id").take(at), "row": part.column("row").take(at),
                       "print": pa.array(np.concatenate(found).view(np.int64)), "n": pa.array(np.concatenate(counts), pa.int32())}

    seen = materialize(per_batch(rows, "doc_id long, row long, print long, n int", prints), "prints")
    # written, so that the joins know how few they are: what is alone need not move
    again = materialize(seen.groupBy("print").agg(F.sum("n").alias("n")).filter("n > 1").select("print"), "again")
    wanted = materialize(seen.select("doc_id", "row", "print").join(again, "print").groupBy("doc_id", "row").agg(
        F.collect_set("print").alias("wanted")), "wanted")
    discard(seen, again)
    marks = wanted.toDF("_rid", "_row", "wanted")
    asked_for = rows.join(marks.drop("wanted"), of_row("row"), "left_semi").join(marks.hint("merge"), of_row("row")).select(
        "doc_id", "row", "text", "wanted")

    def runs(batch):
        for part in slices(batch, "text", 1_000_000):
            asked, n = part.column("wanted"), _print_words(run_words)
            of, found, places = [], [], []
            for i, words in _texts(part, run_words):
                at, hashes = _fingerprints(words, run_words)
                at = at[np.isin(hashes, asked[i].values.to_numpy().view(np.uint64))]
                near = np.zeros(len(words) + 1, np.int64)
                np.add.at(near, np.maximum(at - (run_words - n), 0), 1)
                np.add.at(near, at + 1, -1)
                start = np.flatnonzero(np.cumsum(near)[:len(words) - run_words + 1])
                of.append(np.full(len(start), i))
                found.append(_rolling(words, run_words)[start])
                places.append(start)
            if of:
                at = pa.array(np.concatenate(of))
                yield {"doc_id": part.column("doc_id").take(at), "row": part.column("row").take(at),
                       "run": pa.array(np.concatenate(found).view(np.int64)), "place": pa.array(np.concatenate(places), pa.int32())}

    near = materialize(per_batch(asked_for, "doc_id long, row long, run long, place int", runs), "runs")
    first = materialize(near.groupBy("run").agg(F.min(F.struct("doc_id", "row", "place")).alias("_f"), F.count("*").alias("_n")).filter(
        "_n > 1").drop("_n"), "first-runs")
    later = near.join(first, "run").filter(
        "doc_id <> _f.doc_id OR row <> _f.row OR place >= _f.place + " + str(int(run_words)))
    out = materialize(later.groupBy("doc_id", "row").agg(
        F.collect_set("place").alias("starts"), F.collect_set("_f.doc_id").alias("first_docs")), "repeated-runs")
    discard(wanted, near, first)
    return out


def row_hash() -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64("text")


def of_row(own: str) -> Column:
    """Joins texts (doc_id, ``own``) with what is known of them (_rid, _row). The only key is the id, by which texts have been dealt
    already; with the row as another they would be shuffled again."""
    return (F.col("doc_id") == F.col("_rid")) & (F.col(own).bitwiseXOR(F.col("_row")) == 0)


def cut_text(text: str, gone: set[int], starts: np.ndarray, run_words: int) -> tuple[str, int]:
    """``text`` without the lines ``gone`` and the runs at ``starts``, and the number of runs cut outside these lines.

    What stands between a cut word and the next word of its line goes with it. A line goes if all its words do, or if
    it has none and lies within a run.
    """
    words = list(_WORDS.finditer(text))
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + run_words, -1)
    cut = np.cumsum(step)[:-1] > 0
    # a new run begins where no run that has begun reaches
    fresh = cut & ~np.concatenate([[False], cut[:-1]])
    name = np.cumsum(fresh)
    out, counted, begin, w = [], set(), 0, 0
    for k, line in enumerate(text.split("\n")):
        end, a = begin + len(line), w
        while w < len(words) and words[w].start() < end:
            w += 1
        if k in gone:
            pass
        elif a == w:
            within = 0 < a < len(words) and cut[a - 1] and cut[a] and not fresh[a]
            if not within:
                out.append(line)
        elif not cut[a:w].any():
            out.append(line)
        else:
            counted |= set(name[a:w][cut[a:w]].tolist())
            if not cut[a:w].all():
                kept, at = [], begin
                for i in range(a, w):
                    if cut[i] and (i == a or not cut[i - 1]):
                        kept.append(text[at:words[i].start()])
                    elif not cut[i] and i > a and cut[i - 1]:
                        at = words[i].start()
                if not cut[w - 1]:
                    kept.append(text[at:end])
                out.append("".join(kept))
        begin = end + 1
    return "\n".join(out), len(counted)


def cutter(run_words: int):
    """``cut_text`` as a column function of text, gone and starts; a null text gives null."""
    kind = pa.struct([("text", pa.string()), ("runs", pa.int64())])

    @F.arrow_udf("text string, runs long")
    def cut(text: pa.Array, gone: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for t, g, s in zip(text, gone, starts):
            if t.is_valid:
                new, n = cut_text(t.as_py(), set(g.as_py() or ()), s.values.to_numpy().astype(np.int64), run_words)
                out.append({"text": new, "runs": n})
            else:
                out.append(None)
        return pa.array(out, kind)

    return cut
