"""Composed reports: each returns named DataFrames, lazily, over one pass of extraction.

``facts`` (idx, source, snippet, dates, money, entities) is what ``operators.corpus.extracted``
returns. Pass it through ``session.materialize`` first when several sections will be read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions import text as tx
from ..operators import corpus as cp
from ..operators import diff, filters
from ..session import materialize

GENERIC_MENTIONS = 100       # fixed values of the reports
DISTINCTIVE = 5
MIN_POINTS = 3
PERIODS = ("day", "week", "month")


def facts_of(passages: DataFrame, keep: bool = True, money: bool = True, entities: bool = True) -> DataFrame:
    """Facts of the live passages, written once unless ``keep`` is off. A summary needs dates only."""
    found = cp.extracted(filters.live(passages), money, entities)
    return materialize(found, "facts") if keep else found


def summary(passages: DataFrame, facts: DataFrame, themes: int = 5, description: str = "",
            first: str | None = None, last: str | None = None, head_chars: int | None = None) -> dict[str, DataFrame]:
    """Counts, covered dates, leading themes and the table of sources."""
    live = filters.live(passages)
    dated = facts.withColumn("dates", _within("dates", first, last))
    counts = cp.count_live(passages)
    coverage = dated.agg(F.count_distinct(F.nullif("source", F.lit(""))).alias("sources"),
                         F.min(F.array_min("dates")).alias("first"), F.max(F.array_max("dates")).alias("last"))
    table = dated.filter("source <> ''").groupBy("source").agg(
        F.count("*").alias("n"), F.min(F.array_min("dates")).alias("first_seen"), F.max(F.array_max("dates")).alias("last_seen"))
    return {"counts": counts, "coverage": coverage, "sources": table,
            "themes": cp.themes_or_words(live, description, themes, head_chars)}


def _within(dates: str, first: str | None, last: str | None) -> Column:
    """Dates inside an optional closed range."""
    return F.filter(dates, lambda d: (F.lit(True) if first is None else d >= F.lit(first).cast("date")) & (
        F.lit(True) if last is None else d <= F.lit(last).cast("date")))


def coverage(passages: DataFrame, facts: DataFrame, min_theme: int = 3, gap_days: int = 30, max_orphans: int = 20,
             source_min: int = 5, head_chars: int | None = None, themes: int = 15) -> dict[str, DataFrame]:
    live = filters.live(passages)
    return {"overview": _overview(facts),
            "themes": cp.theme_coverage(live, min_theme, head_chars, shown=themes), "orphans": cp.orphan_entities(facts, max_orphans),
            "sources": cp.source_status(facts, source_min), "gaps": cp.time_gaps(facts, gap_days),
            "context_poor": cp.context_poor(facts)}


def _overview(facts: DataFrame) -> DataFrame:
    ends = facts.select(F.explode("dates").alias("d")).agg(F.min("d").alias("first"), F.max("d").alias("last"))
    return cp.extraction_density(facts).withColumn("_e", ends.select(F.struct("first", "last")).scalar()).select(
        "items", "sources", "with_dates", "with_entities", "with_currency", F.col("_e.first").alias("first"), F.col("_e.last").alias("last"))


def comparison(passages: DataFrame, a: str, b: str) -> dict[str, DataFrame]:
    """Metrics of two subsets with their deltas, the overlap, and five distinctive passages of each.

    An empty subset gives an error row instead of a misleading comparison.
    """
    sides = materialize(cp.side_facts(diff.subset_overlap(filters.live(passages), a, b)), "sides")
    metrics = cp.side_metrics(sides).select("count", "sources", "date_min", "date_max", "usd_total", "side")
    pair = metrics.agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for s in "ab"
                         for c in ("count", "sources", "date_min", "date_max", "usd_total")])
    span = F.date_diff("date_max_b", "date_min_b") - F.date_diff("date_max_a", "date_min_a")
    sign = F.when(span >= 0, "+").otherwise("")
    deltas = pair.select(
        F.when(F.col("count_a").isNull() | F.col("count_b").isNull(), "no match").alias("error"),
        tx.delta_label(F.col("count_a"), F.col("count_b")).alias("count"),
        tx.delta_label(F.col("sources_a"), F.col("sources_b"), absolute=True).alias("sources"),
        F.coalesce(F.concat(sign, span.cast("string"), F.lit("d")), F.lit("—")).alias("date_span"),
        _money_delta(F.col("usd_total_a"), F.col("usd_total_b")).alias("usd_total"))
    overlap = sides.groupBy("side").agg(F.count("*").alias("n"))

    def only(side):
        few = sides.filter(F.col("side") == side).orderBy("idx").limit(DISTINCTIVE)
        return few.select("side", "idx", tx.source_link(F.col("source")).alias("source"), "line")

    return {"metrics": metrics, "deltas": deltas, "overlap": overlap, "distinctive": only("only_a").unionByName(only("only_b"))}


def _money_delta(a: Column, b: Column) -> Column:
    gap = (b - a).cast("decimal(38,4)")
    sign = F.when(gap >= 0, "+").otherwise("")
    shown = F.concat(sign, F.lit("$"), F.format_number(F.abs(gap), 2))
    return (F.when((a == 0) & (b == 0), "—").when((a > 0) & (b > 0), tx.signed_percent(
        gap.cast("double") / a.cast("double") * 100.0)).otherwise(shown))


def entity_rollup(passages: DataFrame, name: str, aliases=()) -> dict[str, DataFrame]:
    """Mentions in time order, undated last, with totals and a warning for a generic name."""
    live = filters.live(passages)
    text = F.col("text")
    found = live.select("idx", "source", ex.first_date(text, F.col("source")).alias("date"),
                        F.explode(ex.entity_mentions(text, name, aliases)).alias("m"))
    mentions = found.select("idx", "source", "date", "m.matched_text", "m.start", "m.context")
    totals = mentions.agg(
        F.count("*").alias("mentions"), F.count_distinct(F.nullif("source", F.lit(""))).alias("sources"),
        F.min("date").alias("first"), F.max("date").alias("last")).withColumn(
        "generic", F.col("mentions") > GENERIC_MENTIONS)
    return {"mentions": mentions.orderBy(F.asc_nulls_last("date"), "idx", "start"), "totals": totals}


def change_log(old: DataFrame, new: DataFrame, strategy: str = "exact") -> dict[str, DataFrame]:
    """Changes, totals with notes, and counts per source. ``semantic`` needs a column ``v`` of one
    dimension on both sides; otherwise the texts are compared."""
    from ..sources.corpus_io import fingerprint
    vectors = "v" in old.columns and "v" in new.columns
    if strategy == "semantic" and vectors and _same_dimension(old, new):
        changes = diff.diff_semantic(old, new)
    else:
        strategy = "exact"
        changes = diff.diff_exact(old, new)
    changes = materialize(changes, "changes")
    if vectors:
        marks = fingerprint(old).select(F.col("fingerprint")).scalar(), fingerprint(new).select(F.col("fingerprint")).scalar()
        totals = diff.diff_totals(changes).withColumn("old_fp", marks[0]).withColumn("new_fp", marks[1])
        notes = diff.diff_notes(totals, F.col("old_fp") == F.col("new_fp")).drop("old_fp", "new_fp")
    else:
        notes = diff.diff_notes(diff.diff_totals(changes), F.lit(True))
    return {"changes": changes, "notes": notes.withColumn("strategy", F.lit(strategy)), "by_source": diff.diff_counts(changes)}


def _same_dimension(old: DataFrame, new: DataFrame) -> bool:
    sizes = [df.select(F.size("v").alias("n")).limit(1).collect() for df in (old, new)]
    return all(sizes) and sizes[0][0]["n"] == sizes[1][0]["n"]


def timeline(passages: DataFrame, entity: str | None = None, granularity: str = "week") -> DataFrame:
    """Dated events per period, optionally only of passages naming an entity."""
    live = filters.live(passages)
    if entity:
        live = filters.text_contains(live, entity)
    events = live.select("idx", "source", F.explode(ex.dates_of(F.col("text"))).alias("date"))
    period = F.date_trunc(granularity, "date").cast("date")
    return events.groupBy(period.alias("period")).agg(
        F.count("*").alias("events"), F.count_distinct("idx").alias("items"), F.min("date").alias("first"), F.max("date").alias("last"))


def _dated_money(passages: DataFrame, presets) -> DataFrame:
    """A row per amount, with its passage's date. Both are made by the generator, so that a text is searched once, whatever
    is asked of its rows, and for a date only if it holds an amount."""
    text = F.col("text")

    def dated(found):
        with_date = ex.let(ex.first_date(text, F.col("source")), lambda d: F.transform(found, lambda m: ex.record(date=d, m=m)))
        return F.when(F.size(found) > 0, with_date)

    rows = filters.live(passages).select("idx", "source", F.explode(ex.let(ex.extract_currency(text, presets), dated)).alias("r"))
    return rows.select("idx", "source", "r.date", "r.m.*")


def trend(passages: DataFrame, metric: str = "fuel_surcharge", custom_regex: str | None = None, grouping: str = "month") -> DataFrame:
    """A numeric series by week, month or invoice; flagged when it has fewer than three points."""
    if metric == "custom":
        live = filters.live(passages)
        number = F.explode(F.regexp_extract_all("text", F.lit(custom_regex), F.lit(1))).alias("raw")
        points = live.select("idx", "source", ex.first_date(F.col("text"), F.col("source")).alias("date"), number).select(
            "idx", "source", "date", F.replace("raw", F.lit(","), F.lit("")).try_cast(ex.MONEY).alias("value")).filter("value IS NOT NULL")
    else:
        points = _dated_money(passages, (metric,))
    point = F.col("source") if grouping == "invoice" else F.date_trunc(grouping, "date").cast("date").cast("string")
    series = materialize(points.groupBy(point.alias("point")).agg(
        F.count("*").alias("n"), F.sum("value").cast("decimal(38,4)").alias("total"),
        F.min("value").alias("low"), F.max("value").alias("high")), "trend")      # read twice
    few = series.agg((F.count("*") < MIN_POINTS)).scalar()
    return series.withColumn("too_few_points", few)


def financial_rollup(passages: DataFrame, preset: str = "invoice_total", dimension: str = "period",
                     first: str | None = None, last: str | None = None) -> DataFrame:
    """Sums per dimension and currency; refunds stay apart and currencies are never merged."""
    rows = _dated_money(passages, (preset,)) if preset else _dated_money(passages, ())
    if first:
        rows = rows.filter(F.col("date") >= F.lit(first).cast("date"))
    if last:
        rows = rows.filter(F.col("date") <= F.lit(last).cast("date"))
    key = {"period": F.date_format("date", "yyyy-MM"), "vendor": F.col("source"), "category": F.col("context_hint"),
           "invoice": F.col("idx").cast("string")}[dimension]
    zero = F.lit(0).cast("decimal(18,4)")
    return rows.groupBy(key.alias("key"), "currency").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("is_negative"), zero).otherwise(F.col("value"))).cast("decimal(38,4)").alias("charged"),
        F.sum(F.when(F.col("is_negative"), F.col("value")).otherwise(zero)).cast("decimal(38,4)").alias("refunded"))
