"""Row filters and the projection of a search result."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flags as fl
from ..functions import text as tx


def live(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("tombstone"))


def by_lifecycle(df: DataFrame, mode: str = "active_only") -> DataFrame:
    """Live and readable rows; ``include_superseded`` and ``all`` widen the status, any other
    mode means active only."""
    seen = ~fl.is_tombstoned(F.col("flags")) & fl.can_read_bits(F.col("perms"))
    if mode == "all":
        return df.filter(seen)
    allowed = (0, 1) if mode == "include_superseded" else (0,)
    return df.filter(seen & fl.status_code(F.col("lifecycle")).isin(*allowed))


def readable(df: DataFrame) -> DataFrame:
    return df.filter(fl.can_read_bits(F.col("perms")))


def writable(df: DataFrame) -> DataFrame:
    return df.filter(fl.can_write_bits(F.col("perms")))


def holds(text: Column, needle: str) -> Column:
    """Case-insensitive substring, without wildcards."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def text_contains(df: DataFrame, needle: str) -> DataFrame:
    return df.filter(holds(F.col("text"), needle))


def exact_phrase(df: DataFrame, phrase: str) -> DataFrame:
    return df.filter(holds(F.col("text"), phrase.strip())) if phrase.strip() else df


def any_keyword(df: DataFrame, keywords) -> DataFrame:
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(F.lower(F.col("text")), F.lit(k))
    return df.filter(hit)


def from_source(df: DataFrame, name: str) -> DataFrame:
    """Explicit path, else resolved path, else label line or name hash; a path settles the answer."""
    wanted = F.lit(name)
    by_label = F.coalesce(tx.label_line(F.col("text")) == wanted, F.lit(False))
    by_hash = F.coalesce(F.col("source_hash") == tx.source_hash(wanted), F.lit(False))
    return df.filter(
        F.when(F.col("explicit_path").isNotNull(), F.col("explicit_path") == wanted)
        .when(F.coalesce(F.col("resolved_path"), F.lit("")) != "", F.col("resolved_path") == wanted)
        .otherwise(by_label | by_hash))


def toc_filter(toc: DataFrame, needle: str) -> DataFrame:
    return toc.filter(holds(F.col("name"), needle) | holds(F.coalesce("description", F.lit("")), needle))


def like_and_relevance(scored: DataFrame, pattern: str, floor: float) -> DataFrame:
    return scored.filter(F.col("source").like(pattern) & (F.col("relevance") > floor))


def pinned(df: DataFrame) -> DataFrame:
    return df.filter(fl.has_bit(F.col("flags"), fl.PINNED))


def perishing(df: DataFrame, cls: int) -> DataFrame:
    return df.filter(fl.perish_class(F.col("flags")) == cls)


def recent(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("ts_unix"), "idx").limit(n)


def content_key(text: Column) -> Column:
    """Key of a passage body: 16 hex digits of SHA-256 over the whole text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def hide_for_seat(df: DataFrame, hidden: DataFrame, seat: str) -> DataFrame:
    """Drop what this seat hid; other seats are unaffected."""
    mine = hidden.filter(F.col("seat") == seat).select("content_key")
    return df.withColumn("content_key", content_key(F.col("text"))).join(mine, "content_key", "left_anti")


def result_fields(df: DataFrame, title_width: int = 100, preview_width: int = 200) -> DataFrame:
    text = F.col("text")
    return df.select("idx", tx.title(text, title_width).alias("title"), tx.preview(text, preview_width).alias("preview"),
                     F.coalesce(text, F.lit("")).alias("full_text"), tx.word_count(text).alias("words"))


def ingested_at(ts_unix: Column) -> Column:
    """ISO UTC time; 0 or less is unknown."""
    seconds = F.when(ts_unix > 0, ts_unix)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.date_format(F.timestamp_add("SECOND", seconds, epoch), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
