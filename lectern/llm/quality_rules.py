"""Quality verdicts by learned decision lists, in built-in expressions only.

``statistics`` counts words, symbols, repeated lines and repeated word windows of whole texts. ``learn`` grows
rules for low quality by sequential covering: a rule starts empty and takes the threshold
condition with the best information gain on two thirds of the rows left, until it covers no good row; then
its last conditions are pruned while that helps on the other third; the rows it covers are
removed and the next rule is grown. The result is an ordered list of conjunctions, emitted as one
Spark conditional expression.
"""
from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 6000          # most labelled rows the driver learns from
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
WINDOW = 8
MAX_RULES = 8
MAX_CONDITIONS = 4
CUTS = 24              # thresholds tried for a statistic
MIN_PRECISION = 0.95   # of a rule, on rows it was not grown on
MIN_COVER = 3
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` with a struct ``_q`` of counts appended; only ``text`` is read, once, without a shuffle.

    A null text has no words and all counts 0; so has an empty one. ``n_repeat_words`` compares
    windows by a 64-bit hash of their words within one text. Time is linear in a text's length,
    n log n where windows repeat.
    """
    text, own = F.coalesce(F.col("text"), F.lit("")), docs.columns
    # each step carries on only what the next one needs
    cut = docs.select(
        *own, F.array_remove(F.split(text, _SPACE, -1), "").alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WORD)).alias("_lines"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("_symbols"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("_upper"),
        F.length(F.regexp_replace(text, "[^!]+", "")).cast("long").alias("_bangs"))
    hashed = cut.select(
        *own, "_symbols", "_upper", "_bangs", F.size("_words").cast("long").alias("_n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("_chars"), F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_dups"),
        F.when(F.size("_words") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("_hashes"))
    plain = [*own, "_symbols", "_upper", "_bangs", "_n_words", "_chars", "_n_lines", "_dups"]
    # where every window is new there is nothing to sort
    in_order = hashed.select(*plain, F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")).alias("_sorted"))
    # windows with a twin beside them in sorted order, back in text order
    twins = in_order.select(*plain, F.sort_array(F.transform(F.filter("_sorted", lambda s, k: F.coalesce(
        s["h"] == F.get("_sorted", k - 1)["h"], F.lit(False)) | F.coalesce(
        s["h"] == F.get("_sorted", k + 1)["h"], F.lit(False))), lambda s: s["i"])).alias("_twins"))
    repeated = F.aggregate(F.transform("_twins", lambda p, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get("_twins", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, n: a + n)
    # `row` is not deterministic, which keeps a filter on the counts from being computed below them once more
    counts = F.struct(
        F.monotonically_increasing_id().alias("row"), F.col("_n_words").alias("n_words"), F.col("_chars").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"), F.col("_dups").alias("n_dup_lines"), repeated.cast("long").alias("n_repeat_words"),
        F.col("_n_lines").alias("n_lines"), F.col("_upper").alias("n_upper"), F.col("_bangs").alias("n_bangs"))
    return twins.select(*own, counts.alias("_q"))


def _share(above: str, below: str) -> Column:
    return F.col(f"_q.{above}") / F.greatest(F.col(f"_q.{below}"), F.lit(1))


def shares() -> dict[str, Column]:
    """What rules may test."""
    return {"symbols_per_word": _share("n_symbols", "n_words"), "repeat_share": _share("n_repeat_words", "n_words"),
            "dup_line_share": _share("n_dup_lines", "n_lines"), "upper_share": _share("n_upper", "word_chars"),
            "bangs_per_word": _share("n_bangs", "n_words"), "chars_per_word": _share("word_chars", "n_words")}


def base_failed() -> Column:
    return (F.col("_q.n_words") < MIN_WORDS) | (
        100 * F.col("_q.n_repeat_words") > MAX_REPEAT_PCT * F.col("_q.n_words"))


# -- learning -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    share: str
    at_least: bool
    value: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        x = columns[self.share]
        return x >= self.value if self.at_least else x <= self.value

    def expression(self) -> Column:
        x = shares()[self.share]
        return x >= F.lit(self.value) if self.at_least else x <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.share} {'>=' if self.at_least else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, columns: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    return reduce(lambda a, c: a & c.holds(columns), rule, rows)


def _grow(columns: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS and (rows & ~bad).any():
        p0, n0 = int((rows & bad).sum()), int((rows & ~bad).sum())
        best, gain = None, 1e-9
        for name, x in columns.items():
            values = np.unique(np.concatenate([np.quantile(x[rows & bad], np.linspace(0, 1, CUTS)),
                                               np.quantile(x[rows], np.linspace(0, 1, CUTS))]))
            for value in values.tolist():
                for at_least in (True, False):
                    hit = rows & ((x >= value) if at_least else (x <= value))
                    p = int((hit & bad).sum())
                    if not p:
                        continue
                    n = int(hit.sum()) - p
                    found = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if found > gain:
                        best, gain = Condition(name, at_least, value), found
        if best is None:
            break
        rule.append(best)
        rows = _covers((best,), columns, rows)
    return tuple(rule)


def _prune(rule: Rule, columns: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        hit = _covers(r, columns, rows)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(columns: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules for low quality. No labelled row of one of the two kinds: no rules."""
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and (left & bad & ~third).sum() >= MIN_COVER and (left & ~bad).any():
        rule = _prune(_grow(columns, bad, left & ~third), columns, bad, left & third)
        hit = _covers(rule, columns, left) if rule else np.zeros(len(bad), bool)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < MIN_COVER or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        left = left & ~hit
    return rules


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[Rule]:
    """Rules from a sample of at most ``most`` labelled rows, chosen by hash; the driver holds their statistics.
    Rows that fail the base test are not learnt from; labels without an id or a quality are left out."""
    known = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    n = known.count()
    share = int(min(1.0, 0.9 * most / max(1, n)) * (1 << 20))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).limit(most).withColumnsRenamed(
        {"doc_id": "_id", "quality": "_quality"})
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    found = with_statistics(texts).select("doc_id", "_quality", base_failed().alias("failed"), *[
        x.alias(k) for k, x in shares().items()]).limit(most).collect()
    found = sorted((r for r in found if not r["failed"]), key=tuple)
    columns = {k: np.array([r[k] for r in found], float) for k in shares()}
    return learn(columns, np.array([r["_quality"] == 0 for r in found], bool))


def fired(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    tests = [reduce(lambda a, b: a & b, [c.expression() for c in rule]) for rule in rules]
    out = None
    for k, test in enumerate(tests, 1):
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the rule that fired, for every row of ``docs``. Rows without a text fail
    the base test; a null doc_id stays; repeated rows are judged alike."""
    rules = train(docs, labels)
    judged = with_statistics(docs.select("doc_id", "text")).select("doc_id", "_q", base_failed().alias("base_failed"),
                                                                  fired(rules).alias("rule"))
    return judged.select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in BASE], "base_failed",
                         (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass the base test and fire no rule, with their columns as they were."""
    rules = train(docs, labels)
    return with_statistics(docs).filter(
        ~base_failed() & (fired(rules) == 0) & (F.col("_q.row") >= 0)).select(*docs.columns)
