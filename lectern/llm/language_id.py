"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased and cut into words. Every run of 3 and of 4 bytes within a word and its
edges is hashed to a row of an embedding table. The mean of a text's rows goes through
a linear softmax. Table and softmax are trained together by stochastic gradient descent in numpy, on a bounded
sample of labelled rows. On rows kept back from training, a temperature makes the scores
probabilities, and the score is found below which a prediction is rejected.

The softmax is linear and the mean is too, so scoring adds up precomputed rows (embedding times
weights): the same numbers with one look-up a subword.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BITS = 16
DIM = 16
SAMPLE = 3000          # most labelled rows used for fitting, all languages together
EPOCHS = 6
RATE = 0.5
MAX_LOSS = 0.002       # most right predictions that rejection may cost, as a share
MAX_ERROR = 0.005      # share of wrong predictions that rejection aims for
FLOOR = 0.5            # a prediction less likely than not is rejected
UNKNOWN = "und"

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords of all texts in a row, and the offsets of each text among them."""
    lower = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    blank, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    padded = pc.binary_join_element_wise(blank, lower, blank, nothing).cast(pa.large_binary())
    ends = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset:padded.offset + len(padded) + 1]
    data = np.frombuffer(padded.buffers()[2], np.uint8)[ends[0]:ends[-1]] if len(padded) else np.empty(0, np.uint8)
    ends = ends - ends[0] if len(ends) else np.zeros(1, np.int64)
    word = _WORD[data]
    b = np.where(word, data, 32).astype(np.uint32)
    hashes, places = [], []
    for n in (3, 4):
        if len(b) < n:
            continue
        m = len(b) - n + 1
        inner = word[1:m + 1].copy()
        for i in range(2, n - 1):
            inner &= word[i:m + i]
        at = np.flatnonzero(inner)           # edges of one text and the next meet in two blanks
        key = b[at]
        for i in range(1, n):
            key = key | (b[at + i] << np.uint32(8 * i))
        key = (key ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        key ^= key >> np.uint32(15)
        hashes.append((key * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
        places.append(at)
    if not hashes:
        return np.empty(0, np.uint32), np.zeros(len(padded) + 1, np.int64)
    counts = [np.searchsorted(p, ends) for p in places]
    if len(hashes) == 1:
        return hashes[0], counts[0]
    offsets = counts[0] + counts[1]
    out = np.empty(offsets[-1], np.uint32)
    for h, p, c, shift in ((hashes[0], places[0], counts[0], counts[1][:-1]),
                           (hashes[1], places[1], counts[1], counts[0][1:])):
        sizes = np.diff(c)
        out[np.arange(len(h)) + np.repeat(shift, sizes)] = h
    return out, offsets


@dataclass
class Model:
    langs: list[str]
    rows: np.ndarray          # logits that one subword of each bucket adds
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = FLOOR

    def logits(self, texts: pa.Array) -> np.ndarray:
        hashed, offsets = subwords(texts)
        sizes = np.diff(offsets)
        out = np.zeros((len(sizes), len(self.langs)))
        full = np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(self.rows[hashed], offsets[:-1][full], axis=0) / sizes[full, None]
        return out + self.bias

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its calibrated probability."""
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1) if len(p) else np.empty(0, np.int64)
        return best, p[np.arange(len(p)), best]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return e / e.sum(axis=1, keepdims=True) if len(x) else x


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Train on four fifths of the rows and calibrate on the rest (on all, if there are fewer than 50)."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    target = np.array([langs.index(x) for x in labels])
    held = np.arange(len(texts)) % 5 == 4 if len(texts) >= 50 else np.zeros(len(texts), bool)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    bags = []
    for i in np.flatnonzero(~held).tolist():
        hashed, _ = subwords(pa.array([texts[i]]))
        if len(hashed):
            rows, many = np.unique(hashed, return_counts=True)
            bags.append((rows, (many / len(hashed)).astype(np.float32), target[i]))
    steps, at = max(1, EPOCHS * len(bags)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rows, share, y = bags[i]
            rate = RATE * (1 - at / steps)
            mean = share @ table[rows]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= rate * p
            # a text moves its own rows, each by its share; scaled so that long texts still move them
            table[rows] -= rate * np.outer(np.minimum(share * 20, 1), back)
            at += 1
    model = Model(langs, (table @ weights).astype(np.float32), bias.astype(np.float64))
    kept = np.flatnonzero(held if held.any() else ~held)
    logits, truth = model.logits(pa.array([texts[i] for i in kept], pa.string())), target[kept]
    doubt = 1 / (len(kept) + 2)      # one unseen error, so that a faultless sample gives no certainty

    def loss(t: float) -> float:
        p = _softmax(logits / t)
        return -float(((1 - doubt) * np.log(p[np.arange(len(kept)), truth] + 1e-300)
                       + doubt * np.log(p.min(axis=1) + 1e-300)).sum())

    model.temperature = min(np.geomspace(0.05, 20, 80), key=loss)
    p = _softmax(logits / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    good = np.sort(score[right])
    most = good[int(MAX_LOSS * len(good))] if len(good) else FLOOR   # beyond this, too many right ones go
    model.reject_below = FLOOR
    for t in np.unique(score[~right]):
        over = score >= model.reject_below
        if (~right & over).sum() <= MAX_ERROR * max(1, over.sum()):
            break
        model.reject_below = max(FLOOR, min(float(np.nextafter(t, 2)), float(most)))
    return model


def sample_labelled(docs: DataFrame, most: int = SAMPLE) -> tuple[list[str], list[str]]:
    """At most ``most`` labelled rows with a letter, spread over languages, chosen by hash; the driver
    holds these texts for training."""
    known = docs.filter(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "lang").limit(most // 10).collect()}
    if not sizes:
        return [], []
    each = most // len(sizes)
    cut = None
    for lang, n in sizes.items():
        share = int(min(1.0, 0.9 * each / n) * (1 << 20))
        test = (F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20)) < share)
        cut = test if cut is None else cut | test
    rows = known.filter(cut).filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang").limit(
        most).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    return rows.column("text").to_pylist(), rows.column("lang").to_pylist()


def train(docs: DataFrame, most: int = SAMPLE) -> Model:
    """Fit on rows of ``docs`` (doc_id, text, lang) whose lang is not null. doc_id only chooses the sample."""
    return fit(*sample_labelled(docs, most))


def _predictions(model: Model, text: pa.Array, letter: np.ndarray) -> tuple[list[str], list[float], list[bool]]:
    if not model.langs:
        return [UNKNOWN] * len(text), [0.0] * len(text), [True] * len(text)
    best, score = model.predict(text)
    langs = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter.tolist())]
    score = np.where(letter, np.clip(score, 0, 1), 0.0)
    return langs, score.tolist(), (~letter | (score < model.reject_below)).tolist()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and rejected appended; only ``text`` is looked at.

    A text that is null, empty or without a letter is ``und`` with score 0 and rejected, as is every
    text under a model that has seen no language. Whole texts are read, of any length; equal texts get
    equal answers. Columns of ``docs`` named like the appended ones are replaced.
    """
    new = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c not in new]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                letter = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                langs, score, gone = _predictions(held.value, part.column("text"), letter)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(kept))], pa.array(langs, pa.string()),
                     pa.array(score, pa.float64()), pa.array(gone, pa.bool_())], names=[*kept, *new])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    schema = StructType([docs.schema[c] for c in kept]).add("lang_pred", StringType()).add(
        "score", DoubleType()).add("rejected", BooleanType())
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_has_letter")
    return docs.select(*kept, has).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` whose language is not rejected, with their columns as they were. Under a model that has seen no
    language only texts without a letter go."""
    mark = "_letter"
    while mark in docs.columns:
        mark += "_"
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                letter = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                gone = _predictions(held.value, part.column("text"), letter)[2] if held.value.langs else ~letter
                rows = pa.RecordBatch.from_arrays(part.columns[:-1], names=part.schema.names[:-1])
                yield rows.filter(pa.array(~np.array(gone, bool)))

    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(mark)
    return docs.select("*", has).mapInArrow(run, docs.schema)


def held_out():
    """Rows that must not be learnt from: crc32 of the id's text leaves 1 on division by 3."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; learns from the other two thirds. A row
    without an id is not held out."""
    model = train(docs.filter(F.coalesce(~held_out(), F.lit(False))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
