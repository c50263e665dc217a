"""Counts, tables of contents, themes, windows and pages over a passage table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions import lexical as lx
from ..functions import text as tx
from . import ranking

NO_SOURCE = "(no source)"
SIZE_LIMIT = 10 * 1024 * 1024


def count_live(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(~F.col("tombstone")).alias("live"), F.count_if("tombstone").alias("tombstoned"),
                  F.count("*").alias("total"))


def source_status(df: DataFrame, minimum: int = 5) -> DataFrame:
    name = F.when(F.coalesce("source", F.lit("")) == "", F.lit(NO_SOURCE)).otherwise(F.col("source"))
    counts = df.groupBy(name.alias("source")).agg(F.count("*").alias("n"))
    return counts.withColumn("status", F.when(F.col("n") < minimum, "under-utilized").otherwise("ok")).orderBy(
        F.desc("n"), "source")


def source_table(df: DataFrame) -> DataFrame:
    """Passages, first and last date seen, per named source."""
    dated = df.filter(F.col("source") != "").select("source", ex.dates_of(F.col("text")).alias("dates"))
    return dated.groupBy("source").agg(
        F.count("*").alias("n"), F.min(F.array_min("dates")).alias("first_seen"),
        F.max(F.array_max("dates")).alias("last_seen"))


def list_sources(df: DataFrame) -> DataFrame:
    named = df.filter(F.trim("source") != "")
    return named.groupBy("source").agg(F.count("*").alias("n"), F.count_if(~F.col("tombstone")).alias("active"))


def toc_from_hash(df: DataFrame) -> DataFrame:
    """Sources known only by hash, in order of first appearance; 0 is no source."""
    groups = df.filter("source_hash <> 0").groupBy("source_hash").agg(
        F.min("idx").alias("first_idx"), F.count("*").alias("n"))
    placed = ranking.row_number(groups, [], "first_idx", "position")
    code = F.lower(F.lpad(F.hex("source_hash"), 8, "0"))
    label = F.concat(F.lit("source #"), F.col("position"), F.lit(" (hash "), code, F.lit(")"))
    return placed.select("position", label.alias("name"), "n")


def distinct_sources(df: DataFrame) -> DataFrame:
    """Distinct sources by first appearance."""
    return df.filter(F.col("source") != "").groupBy("source").agg(F.min("idx").alias("first_idx")).orderBy("first_idx")


# -- themes and entities ------------------------------------------------------------------------

def _head(text: Column, head_chars: int | None) -> Column:
    return text if head_chars is None else F.substring(text, 1, head_chars)


def top_themes(df: DataFrame, n: int = 5, head_chars: int | None = None) -> DataFrame:
    """Most frequent bigrams. ``head_chars`` reads a passage's head only; default the whole."""
    grams = df.select(F.explode(lx.bigrams(lx.content_tokens(_head(F.col("text"), head_chars)))).alias("theme"))
    return grams.groupBy("theme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme").limit(n)


def themes_or_words(df: DataFrame, description: str, n: int = 5, head_chars: int | None = None) -> DataFrame:
    """Fewer than three themes: distinct words of the description instead, weight 1."""
    themes = top_themes(df, n, head_chars)
    tokens = F.array_distinct(F.filter(lx.content_tokens(F.lit(description)), lambda t: F.length(t) > 3))
    words = df.sparkSession.range(1).select(F.explode(F.slice(tokens, 1, n)).alias("theme")).withColumn(
        "n", F.lit(1).cast("bigint"))
    few = themes.agg((F.count("*") < 3).alias("few")).scalar()
    return themes.withColumn("_few", few).filter(~F.col("_few")).drop("_few").unionByName(
        words.withColumn("_few", few).filter("_few").drop("_few"))


def theme_items(df: DataFrame, head_chars: int | None = None) -> DataFrame:
    """Items per bigram; repeats inside one passage count once."""
    grams = F.array_distinct(lx.bigrams(lx.content_tokens(_head(F.col("text"), head_chars))))
    return df.select("idx", F.explode(grams).alias("theme")).groupBy("theme").agg(
        F.count("*").alias("items"), F.min("idx").alias("sample_idx"))


def theme_coverage(df: DataFrame, minimum: int = 3, head_chars: int | None = None, pool: int | None = None,
                   shown: int | None = None) -> DataFrame:
    """Themes in fewer than ``minimum`` items, with their number in ``total``. ``pool`` looks only at that many
    leading themes, and ``shown`` is the length of the report; by default neither limits anything."""
    themes = theme_items(df, head_chars)
    if pool is not None:
        themes = themes.orderBy(F.desc("items"), "theme").limit(pool)
    rare = themes.filter(F.col("items") < minimum)
    total = rare.agg(F.count("sample_idx")).scalar()     # every column is read, so that both share one shuffle
    few = rare.orderBy(F.desc("items"), "theme")
    return (few if shown is None else few.limit(shown)).withColumn("total", total)


def extracted(df: DataFrame, money: bool = True, entities: bool = True) -> DataFrame:
    """One pass over the text: dates, amounts, entity candidates and a snippet per passage."""
    text = F.col("text")
    found = [ex.dates_of(text).alias("dates")]
    if money:
        found.append(ex.extract_currency(text).alias("money"))
    if entities:
        found.append(ex.entity_candidates(text, 3).alias("entities"))
    return df.select("idx", "source", tx.snippet(text, 100).alias("snippet"), *found)


def entity_items(items: DataFrame) -> DataFrame:
    """(key, entity, first_idx, last_idx): case-folded entities with their first surface form."""
    found = items.select("idx", F.posexplode("entities").alias("pos", "entity"))
    return found.groupBy(F.lower("entity").alias("key")).agg(
        F.min_by("entity", F.struct("idx", "pos")).alias("entity"), F.min("idx").alias("first_idx"),
        F.max("idx").alias("last_idx"))


def orphan_entities(items: DataFrame, shown: int = 20) -> DataFrame:
    """Entities of exactly one item, alphabetical, with the full count."""
    orphans = entity_items(items).filter("first_idx = last_idx")
    total = orphans.agg(F.count("entity")).scalar()      # as for themes
    few = orphans.orderBy("key").limit(shown).select("entity", F.col("first_idx").alias("idx"))
    return few.withColumn("total", total)


def extraction_density(items: DataFrame) -> DataFrame:
    total = F.count("*")
    return items.agg(
        total.alias("items"), F.count_distinct(F.nullif("source", F.lit(""))).alias("sources"),
        tx.percent(F.count_if(F.size("dates") > 0), total).alias("with_dates"),
        tx.percent(F.count_if(F.size("entities") > 0), total).alias("with_entities"),
        tx.percent(F.count_if(F.size("money") > 0), total).alias("with_currency"))


def context_poor(items: DataFrame, sample: int = 10) -> DataFrame:
    """Items with no date, amount or entity: a sample and the full count. The cheapest test comes first."""
    poor = items.filter((F.size("entities") == 0) & (F.size("dates") == 0) & (F.size("money") == 0))
    total = poor.agg(F.count("*")).scalar()
    return poor.select("idx", "snippet").orderBy("idx").limit(sample).withColumn("total", total)


def _dates_in(items: DataFrame) -> DataFrame:
    """A row per date. Of an inner explode Spark infers a test of the array, for which every text would be searched again."""
    return items.select(F.explode_outer("dates").alias("date")).filter("date IS NOT NULL")


def date_range(items: DataFrame) -> DataFrame:
    days = _dates_in(items)
    return days.agg(F.count_distinct("date").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"))


def time_gaps(items: DataFrame, threshold: int = 30) -> DataFrame:
    """Consecutive distinct dates more than ``threshold`` days apart. Four-digit years bound the
    distinct dates to under four million, so the one ordered window stays small."""
    days = _dates_in(items).distinct()
    step = days.select(F.lag("date").over(Window.orderBy("date")).alias("from"), F.col("date").alias("to"))
    return step.withColumn("days", F.date_diff("to", "from")).filter(F.col("days") > threshold)


def money_of(df: DataFrame, presets=(), three_digits_first: bool = False) -> DataFrame:
    return df.select("idx", "source", F.explode(
        ex.extract_currency(F.col("text"), presets, three_digits_first)).alias("m")).select("idx", "source", "m.*")


def _subset_facts(df: DataFrame, keep: list[Column]) -> DataFrame:
    text = F.col("text")
    combined = F.when(F.coalesce("source", F.lit("")) != "", F.concat(text, F.lit("\n"), F.col("source"))).otherwise(text)
    usd = F.filter(ex.extract_currency(text), lambda m: m["currency"] == "USD")
    zero = F.lit(0).cast("decimal(38,4)")
    net = F.aggregate(usd, zero, lambda s, m: (s + F.when(m["is_negative"], -m["value"]).otherwise(m["value"])).cast("decimal(38,4)"))
    return df.select(*keep, "source", ex.dates_of(combined).alias("dates"), net.alias("usd"))


def _metric_columns() -> list[Column]:
    zero = F.lit(0).cast("decimal(38,4)")
    return [F.count("*").alias("count"), F.count_distinct(F.nullif("source", F.lit(""))).alias("sources"),
            F.min(F.array_min("dates")).alias("date_min"), F.max(F.array_max("dates")).alias("date_max"),
            F.coalesce(F.sum("usd"), zero).cast("decimal(38,4)").alias("usd_total")]


def subset_metrics(df: DataFrame) -> DataFrame:
    """Count, sources, date range over text and source name, and the USD total (refunds negative)."""
    return _subset_facts(df, []).agg(*_metric_columns())


def side_facts(overlap: DataFrame) -> DataFrame:
    """(idx, side, line, source, dates, usd) of a ``subset_overlap``: all a comparison needs of the
    text, read once even where a passage is in both subsets."""
    return _subset_facts(overlap, [F.col("idx"), F.col("side"), tx.first_content_line(F.col("text")).alias("line")])


def side_metrics(facts: DataFrame) -> DataFrame:
    """``subset_metrics`` of both sides from their facts."""
    sides = F.when(F.col("side") == "only_a", F.array(F.lit("a"))).when(F.col("side") == "only_b", F.array(F.lit("b"))).otherwise(
        F.array(F.lit("a"), F.lit("b")))
    return facts.withColumn("side", F.explode(sides)).groupBy("side").agg(*_metric_columns())


def by_source_and_month(df: DataFrame) -> DataFrame:
    """GROUP BY source, month of the passage's date."""
    dated = df.select("source", F.month(ex.first_date(F.col("text"), F.col("source"))).alias("month"))
    return dated.groupBy("source", "month").agg(F.count("*").alias("n"))


# -- corpus-level tables --------------------------------------------------------------------------

def corpus_header(meta: DataFrame) -> DataFrame:
    """(source, kind) rows -> one header row; the files are ``corpus_files``, not a list."""
    return meta.agg(F.count_distinct("source").alias("file_count"), F.count("*").alias("total_chunks"),
                    F.count_if(F.col("kind") == "graphic").alias("graphic_count"),
                    F.count_if(F.col("kind") == "table").alias("table_count"))


def corpus_files(meta: DataFrame) -> DataFrame:
    return meta.groupBy("source").agg(F.count("*").alias("chunks"), F.min("idx").alias("first_idx"))


def governability(keyed: DataFrame) -> DataFrame:
    """Passages per document-key reason."""
    return keyed.groupBy("reason").agg(F.count("*").alias("n"), F.count("document_key").alias("keyed"))


def exception_map(exceptions: DataFrame) -> DataFrame:
    """(corpus, seat, document) -> level, as rows rather than one map per seat."""
    return exceptions.groupBy("corpus_id", "seat", "source_hash").agg(F.max("level").alias("level"))


def grant_counts(corpora: DataFrame, grants: DataFrame) -> DataFrame:
    counts = grants.groupBy("corpus_id").agg(F.count("*").alias("grants"))
    return corpora.select("corpus_id", "name").join(counts, "corpus_id", "left").withColumn(
        "grants", F.coalesce("grants", F.lit(0).cast("bigint")))


def constraint_violations(uploads: DataFrame) -> DataFrame:
    """Corpora beyond an owner's first, and corpora over 10 MiB."""
    placed = ranking.row_number(uploads, ["owner"], "corpus_id", "nth")
    flagged = placed.select("corpus_id", "owner", (F.col("nth") > 1).alias("second_corpus"),
                            (F.col("size_bytes") > SIZE_LIMIT).alias("too_large"))
    return flagged.filter(F.col("second_corpus") | F.col("too_large"))


def attention(activity: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """Touches against distinct seats."""
    seats = F.count_distinct("seat") if exact else F.approx_count_distinct("seat")
    return activity.filter("seat IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("touches"), seats.alias("seats"))


def apps_per_user(activity: DataFrame) -> DataFrame:
    """The set of applications is small and fixed, so a set per user is bounded."""
    return activity.groupBy("seat").agg(F.array_sort(F.collect_set("event_type")).alias("apps"))


def provision_status(log: DataFrame) -> DataFrame:
    """Latest outcome per user."""
    return log.groupBy("user").agg(F.max_by("outcome", F.struct("ts", "event_id")).alias("outcome"),
                                   F.max("ts").alias("at"))


# -- windows ---------------------------------------------------------------------------------------

def link_prev_next(df: DataFrame, linear: bool = False) -> DataFrame:
    """Neighbouring passages of the same source; ``linear`` links across sources."""
    return ranking.neighbours(df, [] if linear else ["source"], "idx", "prev_idx", "next_idx")


def chunk_labels(df: DataFrame) -> DataFrame:
    """``source (part i/N)`` when a source has more than one passage."""
    parts = ranking.row_number(df, ["source"], "idx", "part")
    totals = df.groupBy("source").agg(F.count("*").alias("total"))
    label = F.when(F.col("total") > 1, F.concat(F.col("source"), F.lit(" (part "), F.col("part"), F.lit("/"),
                                                F.col("total"), F.lit(")"))).otherwise(F.col("source"))
    return parts.join(totals, "source").withColumn("label", label)


def latest_per_name(files: DataFrame) -> DataFrame:
    """Newest file per stem; equal times by suffix."""
    row = F.struct("suffix", "location", "size", "mtime")
    newest = files.groupBy("stem").agg(F.max_by(row, F.struct("mtime", "suffix", "location", "size")).alias("f"))
    return newest.select("stem", "f.*")


def keep_last(df: DataFrame, n: int = 500, keys=("corpus_id",), order=("ts", "event_id")) -> DataFrame:
    """The newest n rows per key."""
    return ranking.top_per_key(df, list(keys), n, [F.desc(c) for c in order], order[-1], "_rank").drop("_rank")


# -- pages -----------------------------------------------------------------------------------------

def page(df: DataFrame, offset: int = 0, limit: int = 25) -> DataFrame:
    """Rows ``offset`` .. by idx, as many as asked for, with the total."""
    if limit < 1:
        raise ValueError("a page holds at least one row")
    total = df.agg(F.count("*")).scalar()
    return df.orderBy("idx").offset(offset).limit(limit).withColumn("total", total)


def page_after(df: DataFrame, last_idx: int, limit: int = 25) -> DataFrame:
    """Keyset page: the scan skips everything up to ``last_idx``."""
    return df.filter(F.col("idx") > last_idx).orderBy("idx").limit(limit)


def source_page(df: DataFrame, source: str, offset: int = 0, limit: int = 25) -> DataFrame:
    return page(df.filter(F.col("source") == source), offset, limit)


def chronological(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("date"), "idx")
