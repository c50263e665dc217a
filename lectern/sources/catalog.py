"""Listing and resolving stored corpora from a file listing (stem, suffix, location, size, mtime)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 1024       # fixed values of the listing
PLACES = ("canonical", "sandbox", "legacy")
SANDBOX_STEM = r"^[0-9a-f]{12}_(.+)$"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Metadata columns of the binary source; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    place = F.when(F.contains("path", F.lit("/sandbox/")), "sandbox").otherwise("canonical")
    return files.select(stem.alias("stem"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("suffix"),
                        place.alias("location"), F.col("length").alias("size"),
                        F.unix_timestamp("modificationTime").alias("mtime"))


def _place():
    return F.array_position(F.array(*[F.lit(p) for p in PLACES]), F.col("location"))


def catalog(files: DataFrame) -> DataFrame:
    """One entry per stem: an array archive beats the old form, then place, then time. Stubs fall
    out. Canonical by name, then sandbox by display name, then legacy."""
    whole = files.filter(F.col("size") >= MIN_BYTES)
    row = F.struct("suffix", "location", "size", "mtime")
    order = F.struct((F.col("suffix") != ".npz").alias("a"), _place().alias("b"), (-F.col("mtime")).alias("c"), "size")
    best = whole.groupBy("stem").agg(F.min_by(row, order).alias("f")).select("stem", "f.*")
    shown = F.coalesce(F.nullif(F.regexp_extract("stem", SANDBOX_STEM, 1), F.lit("")), F.col("stem"))
    return best.withColumn("display", shown).orderBy(_place(), "display", "stem")


def resolve(names: DataFrame, files: DataFrame) -> DataFrame:
    """File of each wanted name: canonical, else the exact sandbox stem, else the newest sandbox
    file whose stem without its prefix is the name."""
    archives = files.filter(F.col("suffix") == ".npz")
    bare = F.nullif(F.regexp_extract("stem", SANDBOX_STEM, 1), F.lit(""))
    direct = archives.select(F.col("stem").alias("name"), "stem", "location", "mtime",
                             F.when(F.col("location") == "sandbox", 2).otherwise(1).alias("rung"))
    stripped = archives.filter(F.col("location") == "sandbox").select(
        bare.alias("name"), "stem", "location", "mtime", F.lit(3).alias("rung")).filter("name IS NOT NULL")
    hits = names.join(direct.unionByName(stripped), "name")
    best = hits.groupBy("name").agg(F.min_by(F.struct("stem", "location", "mtime"), F.struct(
        "rung", (-F.col("mtime")).alias("age"), "stem")).alias("f"))
    return names.join(best.select("name", "f.*"), "name", "left")
