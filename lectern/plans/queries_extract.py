"""Registered queries: extraction from text and the counts built on it."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as ex
from ..operators import corpus as cp
from ..operators import filters
from .queries_functions import TOKENS
from .registry import query


query("x5_extract_dates", "SELECT idx, date, raw_span, confidence, source_format FROM invoice_dates")(
    lambda t: t.invoices.select("idx", F.explode(ex.extract_dates(F.col("text"))).alias("d")).select(
        "idx", "d.date", "d.raw_span", "d.confidence", "d.source_format"))


@query("x5b_date_offsets", """
SELECT d.idx, d.raw_span, (instr(i.text, d.raw_span) - 1)::INT AS start FROM invoice_dates d JOIN invoices i ON d.idx = i.idx""")
def _(t):
    return t.invoices.select("idx", F.explode(ex.extract_dates(F.col("text"))).alias("d")).select("idx", "d.raw_span", "d.start")


query("x6_extract_currency", "SELECT idx, value, currency, raw_span, is_negative, hint AS context_hint FROM invoice_money")(
    lambda t: cp.money_of(t.invoices).select("idx", "value", "currency", "raw_span", "is_negative", "context_hint"))
query("x7_context_hint", "SELECT idx, hint, count(*) AS n FROM invoice_money GROUP BY 1, 2")(
    lambda t: cp.money_of(t.invoices).groupBy("idx", F.col("context_hint").alias("hint")).agg(F.count("*").alias("n")))
query("x8_currency_presets", "SELECT idx, value, hint AS context_hint FROM invoice_money WHERE hint IN ('surcharge')")(
    lambda t: cp.money_of(t.invoices, ("fuel_surcharge",)).select("idx", "value", "context_hint"))

MENTION = """WITH m AS (SELECT o_orderkey AS idx, text, 'Goods under' AS s FROM invoice_base JOIN invoices ON o_orderkey = idx)
SELECT idx, s AS matched_text, (instr(text, s) - 1)::INT AS start, (instr(text, s) - 1 + 11)::INT AS "end",
  substr(text, instr(text, 'Shipped')) AS context FROM m"""


@query("x9_entity_mentions", MENTION.replace("WITH m AS", "WITH g AS (SELECT o_orderkey AS idx, text, instr(text, 'damaged goods') + 7 AS p0 FROM invoice_base JOIN invoices ON o_orderkey = idx WHERE o_orderkey % 4 = 0), m AS") + """
UNION ALL SELECT idx, 'goods', p0::INT, (p0 + 5)::INT, '50) for damaged goods.' FROM g""")
def _(t):
    found = ex.entity_mentions(F.col("text"), "goods", ["GOODS UNDER", "goods u"])
    return t.invoices.select("idx", F.explode(found).alias("m")).select("idx", "m.matched_text", "m.start", "m.end", "m.context")


query("x10_discover_entities", "SELECT idx, entity FROM invoice_entities")(
    lambda t: t.invoices.select("idx", F.explode(ex.discover_entities(F.col("text"), 3)).alias("entity")))
query("x11_first_date", "SELECT o_orderkey AS idx, od AS a, od AS b FROM invoice_base")(
    lambda t: t.invoices.select("idx", ex.first_date(F.col("text"), F.col("source")).alias("a"), ex.first_date(F.lit(""), F.col("source")).alias("b")))


@query("u8_dedupe_mentions", """
SELECT idx, count(*) AS n, list_sum(list(len(word)))::BIGINT AS chars FROM (SELECT o_orderkey AS idx, unnest(CASE WHEN o_orderkey % 4 = 0 THEN ['Refund adjustment', 'Invoice', 'invoice'] ELSE ['Invoice', 'invoice'] END) AS word FROM invoice_base) GROUP BY 1""")
def _(t):
    found = ex.entity_mentions(F.col("text"), "Invoice", ["refund", "Refund adjustment", "adjustment"])
    return t.invoices.select("idx", F.explode(found).alias("m")).groupBy("idx").agg(
        F.count("*").alias("n"), F.sum(F.length("m.matched_text")).cast("bigint").alias("chars"))


# -- counts over extracted facts ------------------------------------------------------------------

query("a3_source_table", """
SELECT i.source, count(DISTINCT i.idx) AS n, min(date) AS first_seen, max(date) AS last_seen FROM invoices i JOIN invoice_dates d ON i.idx = d.idx GROUP BY 1""")(
    lambda t: cp.source_table(t.invoices))

BIGRAMS = f"""k AS (SELECT idx, {TOKENS} AS ts FROM {{v}}),
g AS (SELECT idx, unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) AS theme FROM k)"""
query("a6_top_themes", f"WITH {BIGRAMS.format(v='passages')} SELECT theme, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, theme LIMIT 20")(
    lambda t: cp.top_themes(t.dealt_passages, 20))


@query("a7_theme_fallback", """
WITH w AS (SELECT count(*) AS pairs FROM region WHERE contains(r_name, ' '))
SELECT 'few' AS kind, unnest(['harbour', 'ledgers', 'spring']) AS theme, 1::BIGINT AS n FROM w WHERE pairs < 3""")
def _(t):
    short = t.region.select(F.col("r_regionkey").alias("idx"), F.col("r_name").alias("text"))
    return cp.themes_or_words(short, "The harbour ledgers of the spring, ledgers and all", 5).withColumn("kind", F.lit("few"))


query("a8_theme_coverage", f"""WITH {BIGRAMS.format(v='conversations_idx')}, r AS (SELECT theme, count(DISTINCT idx) AS items, min(idx) AS sample_idx FROM g GROUP BY 1),
p AS (SELECT * FROM r WHERE items < 200) SELECT *, (SELECT count(*) FROM p) AS total FROM p""".replace(
    "conversations_idx", "(SELECT conv_id * 100 + turn AS idx, text FROM conversations)"))(
    lambda t: cp.theme_coverage(t.conversations.select(F.expr("conv_id * 100 + turn").alias("idx"), "text"), 200))
ORPHANS = """e AS (SELECT lower(entity) AS k, min(entity) AS entity, count(DISTINCT idx) AS n, min(idx) AS idx FROM {v} GROUP BY 1)
SELECT entity, idx, (SELECT count(*) FROM e WHERE n = 1) AS total FROM e WHERE n = 1 ORDER BY k LIMIT 20"""
DOC_ENTITIES = """(SELECT item_id AS idx, unnest(list_filter(regexp_extract_all(regexp_replace(text, '[À-ɏ]', '_', 'g'), '\\b[A-Z][a-zA-Z0-9]{2,}(?:\\s+[A-Z][a-zA-Z0-9]{2,}){0,2}\\b'),
  lambda c: NOT list_contains(STOP, lower(split_part(regexp_replace(c, '\\s+', ' '), ' ', 1))))) AS entity FROM benchmark)"""


def _stop():
    from ..functions.lexical import CALENDAR_WORDS, TOKEN_STOPWORDS
    from .queries_functions import sql_list
    return sql_list([*TOKEN_STOPWORDS, *CALENDAR_WORDS])


query("a9_orphan_entities", "WITH " + ORPHANS.format(v=DOC_ENTITIES.replace("STOP", _stop())))(
    lambda t: cp.orphan_entities(cp.extracted(t.benchmark.select(F.col("item_id").alias("idx"), F.lit("").alias("source"), "text"))))
query("a10_extraction_density", """
SELECT count(*) AS items, count(DISTINCT source) AS sources, '100%' AS with_dates, '100%' AS with_entities, '100%' AS with_currency FROM invoices""")(
    lambda t: cp.extraction_density(cp.extracted(t.invoices)))
query("a11_context_poor", """
WITH x AS (SELECT o_orderkey AS idx, o_orderkey % 3 = 0 AS poor FROM orders)
SELECT idx, 'nothing of note here' AS snippet, (SELECT count(*) FROM x WHERE poor) AS total FROM x WHERE poor ORDER BY idx LIMIT 10""")(
    lambda t: cp.context_poor(cp.extracted(t.invoices.withColumn("text", F.expr("CASE WHEN idx % 3 = 0 THEN 'nothing of note here' ELSE text END")))))
query("a12_date_range", "SELECT count(DISTINCT date) AS days, min(date) AS first, max(date) AS last FROM invoice_dates")(
    lambda t: cp.date_range(cp.extracted(t.invoices, False, False)))
METRICS = """SELECT count(*) AS count, count(DISTINCT source) AS sources, min(date_min) AS date_min, max(date_max) AS date_max, sum(usd)::DECIMAL(38,4) AS usd_total
FROM invoices i JOIN (SELECT idx, min(date) AS date_min, max(date) AS date_max FROM invoice_dates GROUP BY 1) d ON i.idx = d.idx
JOIN (SELECT idx, sum(CASE WHEN currency <> 'USD' THEN 0 WHEN is_negative THEN -value ELSE value END) AS usd FROM invoice_money GROUP BY 1) m ON i.idx = m.idx"""
query("a13_subset_metrics", METRICS + " WHERE contains(lower(text), 'household')")(
    lambda t: cp.subset_metrics(filters.text_contains(t.invoices, "Household")))
query("a16_group_by_source_month", "SELECT source, month(od)::INT AS month, count(*) AS n FROM invoices JOIN invoice_base ON o_orderkey = idx GROUP BY 1, 2")(
    lambda t: cp.by_source_and_month(t.invoices))
query("w3_time_gaps", """
WITH d AS (SELECT DISTINCT date FROM invoice_dates), g AS (SELECT lag(date) OVER (ORDER BY date) AS "from", date AS "to" FROM d)
SELECT "from", "to", ("to" - "from")::INT AS days FROM g WHERE "to" - "from" > 1""")(
    lambda t: cp.time_gaps(cp.extracted(t.invoices, False, False), 1))
query("t5_chronological", "SELECT idx, CASE WHEN idx % 6 <> 0 THEN od END AS date FROM invoices JOIN invoice_base ON o_orderkey = idx")(
    lambda t: cp.chronological(t.invoices.select("idx", F.expr("CASE WHEN idx % 6 = 0 THEN 'undated' ELSE text END").alias("text")).select(
        "idx", ex.first_date(F.col("text"), F.lit("")).alias("date"))))
