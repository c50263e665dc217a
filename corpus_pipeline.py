"""A training corpus from raw documents, as a run of stages: identify languages, drop low quality, drop near
copies, cut repeated passages, and pack what is left into sequences.

Every stage takes the rows that the one before has kept. All but the last return the columns of ``documents``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import jaccard_join, language_id, packing, quality_rules, substring_dedup
from lectern.llm.common import table, tokenizer_path
from lectern.session import materialize


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on a bounded sample of them, does not reject.

    A null or empty text, or one without a letter, has no language and goes. Repeated rows share their fate; a null doc_id
    stays null. Without a labelled language only texts without a letter go, and an empty table gives an empty result.
    """
    return language_id.keep_identified(docs, language_id.train(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the rules learnt from ``labels``.

    A null or empty text fails the base test. Without labelled rows the base test alone decides. Repeated rows share their fate, and
    an empty table gives an empty result.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near copies.

    Texts without a word have no near copies and stay, as do rows without a doc_id. Of rows that repeat a doc_id one stays. An
    empty table gives an empty result.
    """
    return jaccard_join.keep_one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one already holds; none goes as a whole.

    A text may become empty. A null or empty text, one without passages and a row without doc_id stay as they are. An empty
    table gives an empty result.
    """
    return substring_dedup.cut_repeats(docs, run_words=substring_dedup.RUN_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens.

    A null or empty text is a piece of one end id; repeated rows are pieces of their own; a text of any length is cut. An
    empty table gives an empty result.
    """
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identified),
    ("quality rules", good),
    ("n-gram Jaccard join", distinct),
    ("substring dedup", without_repeats),
    ("best-fit packing", packed),
]
#: Learnt models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
