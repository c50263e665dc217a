"""Scoring and extraction under SQL names."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract as ex

SCALAR = {
    "dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        "dot(a, b) / (sqrt(dot(b, b)) + 1e-9D) / (sqrt(dot(a, a)) + 1e-9D)",
    "hamming(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        "1D - aggregate(zip_with(a, b, (x, y) -> CASE WHEN (x > 0) <> (y > 0) THEN 1 ELSE 0 END), 0, (s, x) -> s + x) / size(a)",
    "source_hash(name STRING) RETURNS BIGINT":
        "CAST(conv(substring(md5(CAST(name AS BINARY)), 1, 8), 16, 10) AS BIGINT)",
}


#: Table functions over one text: arguments, the rows they return, and the array column behind them.
TABLES = {
    "extract_dates": ("passage STRING", "date DATE, raw_span STRING, start INT, end INT, confidence DOUBLE, source_format STRING",
                      ex.extract_dates),
    "extract_currency": ("passage STRING", f"value {ex.MONEY}, currency STRING, raw_span STRING, start INT, end INT, is_negative BOOLEAN, "
                         "confidence DOUBLE, context_hint STRING", ex.extract_currency),
    "discover_entities": ("passage STRING", "entity STRING", ex.discover_entities),
}

_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'")
_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|!=|[=<>+*/%!-]|and|or|not|in|isnull|isnotnull)\(")


def as_sql(column: Column) -> str:
    """SQL text of a column of built-in functions; an operator is called by its name, which SQL wants quoted."""
    text = re.sub(r"^Column<'|'>$", "", str(column))
    at, out = 0, []
    for quoted in _QUOTED.finditer(text):
        out += [_OPERATOR.sub(r"`\1`(", text[at:quoted.start()]), quoted.group()]
        at = quoted.end()
    return "".join([*out, _OPERATOR.sub(r"`\1`(", text[at:])])


def register(spark: SparkSession) -> None:
    """Temporary functions with SQL bodies, so the optimizer sees through them: scalar ones, and table functions for
    ``FROM passages, LATERAL extract_dates(text)`` that give a row per span."""
    for head, body in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, (takes, rows, spans) in TABLES.items():
        one = len(rows.split(",")) == 1
        picked = "s" if one else ", ".join(f"s.{r.split()[0]}" for r in re.split(r", (?=\w+ [A-Za-z])", rows))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE({rows}) "
                  f"RETURN SELECT {picked} FROM (SELECT explode({as_sql(spans(F.col('passage')))}) AS s)")


def register_mentions(spark: SparkSession, function: str, entity: str, aliases=()) -> None:
    """A table function ``function(text)`` of the places that name one entity."""
    spans = as_sql(ex.entity_mentions(F.col("passage"), entity, aliases))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(passage STRING) RETURNS TABLE(entity_name STRING, matched_text STRING, start INT, "
              f"end INT, context STRING) RETURN SELECT s.* FROM (SELECT explode({spans}) AS s)")


def extraction_views(passages: DataFrame, prefix: str, entity: str | None = None, aliases=()) -> None:
    """Views ``{prefix}_dates``, ``{prefix}_money``, ``{prefix}_entities`` and, for a given entity,
    ``{prefix}_mentions``: one row per extracted span, ready for joins and aggregates in SQL."""
    text = F.col("text")
    parts = {"dates": ex.extract_dates(text), "money": ex.extract_currency(text)}
    if entity:
        parts["mentions"] = ex.entity_mentions(text, entity, aliases)
    for name, spans in parts.items():
        passages.select("idx", F.explode(spans).alias("s")).select("idx", "s.*").createOrReplaceTempView(f"{prefix}_{name}")
    passages.select("idx", F.explode(ex.discover_entities(text)).alias("entity")).createOrReplaceTempView(f"{prefix}_entities")
