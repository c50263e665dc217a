"""Reading, writing and checking stored corpora."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..operators import ranking

IDX_BLOCK = 1_000_000
SOURCE_LIMIT = 65_535


def scan_passages(spark: SparkSession, path: str, live_only: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(~F.col("tombstone")) if live_only else df


def write_corpus(df: DataFrame, path: str, compact: bool = False, mode: str = "errorifexists") -> None:
    """Parquet by corpus and idx block, sorted by idx, so that an id lookup prunes files.

    ``compact`` drops tombstones and renumbers each corpus from 0. Rows are dealt into sorted ranges of corpus and idx, so
    that a large block lies in several files, each of its own idx range, and no task writes all of it.
    """
    if compact:
        live = df.filter(~F.col("tombstone"))
        df = ranking.row_number(live, ["corpus_id"], "idx", "_n").withColumn("idx", F.col("_n") - 1).drop("_n")
    blocked = df.withColumn("idx_block", F.floor(F.col("idx") / IDX_BLOCK).cast("int"))
    (blocked.repartitionByRange("corpus_id", "idx_block", "idx").sortWithinPartitions("corpus_id", "idx_block", "idx")
     .write.partitionBy("corpus_id", "idx_block").mode(mode).parquet(path))


def write_page_index(spark: SparkSession, path: str) -> None:
    """(corpus_id, idx_block, n, before, layout) next to a stored corpus: rows of each block and of the blocks before it, and
    the schema, so that a page need not look for it. Only partition values are read for it, and it has one row a block."""
    stored = spark.read.parquet(path)
    blocks = stored.groupBy("corpus_id", "idx_block").agg(F.count("*").alias("n")).withColumn("layout", F.lit(stored.schema.json()))
    upto = Window.partitionBy("corpus_id").orderBy("idx_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}-pages")


def stored_page(spark: SparkSession, path: str, corpus_id, offset: int = 0, limit: int = 25) -> DataFrame:
    """Rows ``offset`` .. of a stored corpus by idx, with the total, from the blocks that hold them alone.

    The page index names these blocks and the total, so neither the rows before a page nor those behind it are read, however deep
    it lies.
    """
    if limit < 1 or offset < 0:
        raise ValueError("a page begins at 0 or later and holds at least one row")
    index = spark.read.parquet(f"{path.rstrip('/')}-pages").filter(F.col("corpus_id") == corpus_id)
    found = index.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy("idx_block").collect()
    about = index.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.first("layout").alias("layout")).first()
    read = spark.read.schema(StructType.fromJson(json.loads(about["layout"]))) if about["layout"] else spark.read
    rows = read.parquet(path).filter((F.col("corpus_id") == corpus_id) & F.col("idx_block").isin([r["idx_block"] for r in found]))
    skipped = found[0]["before"] if found else 0
    return rows.orderBy("idx").offset(offset - skipped if found else 0).limit(limit).drop("corpus_id", "idx_block").withColumn(
        "total", F.lit(about["n"]).cast("bigint"))


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def normalize_sources(df: DataFrame, most: int | None = SOURCE_LIMIT) -> DataFrame:
    """(source_idx, source, n): 0 is "no source", then by first appearance. More than ``most`` sources, which the stored
    16-bit number cannot hold, are an error on any read; None numbers them all."""
    groups = df.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.min("idx").alias("first_idx"), F.count("*").alias("n"))
    named = groups.filter("source <> ''")
    placed = ranking.row_number(named, [], "first_idx", "source_idx")
    if most is not None:
        total = named.agg(F.count("*")).scalar()
        placed = placed.withColumn("_total", total).filter(
            F.assert_true(F.col("_total") <= most, F.lit(f"more than {most} sources")).isNull()).drop("_total")
    blank = df.filter(F.coalesce("source", F.lit("")) == "").agg(
        F.lit(0).cast("bigint").alias("source_idx"), F.lit("").alias("source"), F.count("*").alias("n"))
    return placed.select("source_idx", "source", "n").unionByName(blank)


def recover_source(table: Column, sidecar: Column, meta: Column, text: Column) -> Column:
    """Source table, else sidecar, else per-passage metadata, else label line."""
    filled = [F.nullif(c, F.lit("")) for c in (table, sidecar, meta)]
    return F.coalesce(*filled, tx.label_line(text), F.lit(""))


def fingerprint(vectors: DataFrame) -> DataFrame:
    """SHA-256 over first vector, last vector and count, 16 hex digits.

    A vector is written as comma-separated millionths of its components.
    """
    def written(v: str):
        return F.array_join(F.transform(v, lambda x: F.bround(x.cast("double") * 1_000_000, 0).cast("bigint").cast("string")), ",")

    ends = vectors.select("idx", "v").agg(F.min_by("v", "idx").alias("first"), F.max_by("v", "idx").alias("last"), F.count("*").alias("n"))
    text = F.concat_ws("|", written("first"), written("last"), F.col("n").cast("string"))
    return ends.select(F.col("n").alias("count"), F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def validate_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Compare manifests (corpus_id, count, fingerprint)."""
    o = old.select("corpus_id", F.lit(True).alias("has_old"), F.col("count").alias("old_count"), F.col("fingerprint").alias("old_fp"))
    n = new.select("corpus_id", F.lit(True).alias("has_new"), F.col("count").alias("new_count"), F.col("fingerprint").alias("new_fp"))
    status = (F.when(F.col("has_old").isNull(), "legacy").when(F.col("has_new").isNull(), "missing")
              .when(F.col("old_count") != F.col("new_count"), "count mismatch")
              .when(F.col("old_fp") != F.col("new_fp"), "fingerprint mismatch").otherwise("ok"))
    return o.join(n, "corpus_id", "full").select("corpus_id", status.alias("status"))


def fetch_full_text(ids: DataFrame, passages: DataFrame) -> DataFrame:
    """Texts of an id list; the measured size of the list decides whether it is broadcast."""
    return passages.select("idx", "text").join(ids.select("idx"), "idx", "left_semi")
