"""Registered queries: composed reports, one section per row group."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reports
from .queries_bookkeeping import EXACT, SEMANTIC
from .queries_extract import BIGRAMS, ORPHANS
from .registry import query


WIDTH = 9


def stacked(parts: dict[str, DataFrame]) -> DataFrame:
    """Sections of one report as strings, every column of every section."""
    out = []
    for name, df in parts.items():
        if len(df.columns) > WIDTH:
            raise ValueError(f"section {name} has {len(df.columns)} columns")
        cols = [F.col(f"`{c}`").cast("string") for c in df.columns]
        cols += [F.lit(None).cast("string")] * (WIDTH - len(cols))
        out.append(df.select(F.lit(name).alias("section"), *[c.alias(f"c{n}") for n, c in enumerate(cols)]))
    return reduce(lambda x, y: x.unionByName(y), out)


def section(name: str, columns: str, rest: str) -> str:
    """The SQL twin of one section; ``columns`` stand between single bars."""
    cols = [f"({c.strip()})::VARCHAR" for c in columns.split(" | ")]
    cols += ["NULL::VARCHAR"] * (WIDTH - len(cols))
    return f"SELECT '{name}' AS section, " + ", ".join(f"{c} AS c{n}" for n, c in enumerate(cols)) + " " + rest


LIVE = """li AS (SELECT * FROM invoices WHERE NOT tombstone),
ld AS (SELECT d.*, li.source FROM invoice_dates d JOIN li ON d.idx = li.idx),
lm AS (SELECT m.*, li.source, (SELECT min(date) FROM invoice_dates x WHERE x.idx = m.idx) AS date FROM invoice_money m JOIN li ON m.idx = li.idx)"""


@query("r1_summary", f"""
WITH {LIVE}, {BIGRAMS.format(v='li')}, th AS (SELECT theme, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, theme LIMIT 5)
""" + " UNION ALL ".join([
    section("counts", "count_if(NOT tombstone) | count_if(tombstone) | count(*)", "FROM invoices"),
    section("coverage", "count(DISTINCT source) | min(date) | max(date)", "FROM ld"),
    section("sources", "source | count(DISTINCT idx) | min(date) | max(date)", "FROM ld GROUP BY source"),
    section("themes", "theme | n", "FROM th")]))
def _(t):
    return stacked(reports.summary(t.invoices, reports.facts_of(t.invoices, money=False, entities=False), 5))


@query("r2_coverage", f"""
WITH {LIVE}, le AS (SELECT * FROM invoice_entities WHERE idx IN (SELECT idx FROM li)), dd AS (SELECT DISTINCT date FROM ld),
gp AS (SELECT lag(date) OVER (ORDER BY date) AS f, date AS t2 FROM dd),
{BIGRAMS.format(v='li')}, r AS (SELECT theme, count(DISTINCT idx) AS items, min(idx) AS sample_idx FROM g GROUP BY 1),
rt AS (SELECT * FROM r WHERE items < 3), ut AS (SELECT * FROM rt ORDER BY items DESC, theme LIMIT 15),
e AS (SELECT lower(entity) AS k, min(entity) AS entity, count(DISTINCT idx) AS n, min(idx) AS idx FROM le GROUP BY 1),
oe AS (SELECT entity, idx, (SELECT count(*) FROM e WHERE n = 1) AS total FROM e WHERE n = 1 ORDER BY k LIMIT 20)
""" + " UNION ALL ".join([
    section("overview", "count(*) | count(DISTINCT source) | (100 * (SELECT count(DISTINCT idx) FROM ld) // count(*)) || '%' | "
            "(100 * (SELECT count(DISTINCT idx) FROM le) // count(*)) || '%' | (100 * (SELECT count(DISTINCT idx) FROM lm) // count(*)) || '%' | "
            "(SELECT min(date) FROM ld) | (SELECT max(date) FROM ld)", "FROM li"),
    section("themes", "theme | items | sample_idx | (SELECT count(*) FROM rt)", "FROM ut"),
    section("orphans", "entity | idx | total", "FROM oe"),
    section("sources", "source | count(*) | CASE WHEN count(*) < 2 THEN 'under-utilized' ELSE 'ok' END", "FROM li GROUP BY source"),
    section("gaps", "f | t2 | t2 - f", "FROM gp WHERE t2 - f > 1")]))
def _(t):
    return stacked(reports.coverage(t.invoices, reports.facts_of(t.invoices), gap_days=1, source_min=2))


CMP = """SELECT count(*) AS n, count(DISTINCT source) AS s, min(d0) AS d0, max(d1) AS d1, sum(usd)::DECIMAL(38,4) AS u FROM li
JOIN (SELECT idx, min(date) AS d0, max(date) AS d1 FROM invoice_dates GROUP BY 1) d ON li.idx = d.idx
JOIN (SELECT idx, sum(CASE WHEN currency <> 'USD' THEN 0 WHEN is_negative THEN -value ELSE value END) AS usd FROM invoice_money GROUP BY 1) m ON li.idx = m.idx
WHERE contains(lower(text), '{q}')"""


@query("r3_comparison", f"""
WITH {LIVE}, ca AS ({CMP.format(q='household')}), cb AS ({CMP.format(q='urgent')}),
f AS (SELECT idx, text, source, contains(lower(text), 'household') AS a, contains(lower(text), 'urgent') AS b FROM li),
o AS (SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' ELSE 'only_b' END AS side, idx, source, text FROM f WHERE a OR b),
ds AS (SELECT side, idx, '[' || source || '](vps://source/' || regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g') || ')' AS link,
  CASE WHEN length(split_part(text, chr(10), 1)) > 120 THEN rtrim(substr(split_part(text, chr(10), 1), 1, 119)) || '…' ELSE split_part(text, chr(10), 1) END AS line FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY idx) AS rn FROM o WHERE side <> 'both') WHERE rn <= 5)
""" + " UNION ALL ".join([
    section("metrics", "n | s | d0 | d1 | u | 'a'", "FROM ca"), section("metrics", "n | s | d0 | d1 | u | 'b'", "FROM cb"),
    section("overlap", "side | count(*)", "FROM o GROUP BY side"),
    section("distinctive", "side | idx | link | line", "FROM ds")]))
def _(t):
    parts = reports.comparison(t.invoices, "household", "urgent")
    return stacked({k: parts[k] for k in ("metrics", "overlap", "distinctive")})   # r3b holds the deltas


@query("r3b_comparison_deltas", f"""
WITH {LIVE}, ca AS ({CMP.format(q='household')}), cb AS ({CMP.format(q='urgent')}), j AS (SELECT ca.n AS na, cb.n AS nb, ca.s AS sa, cb.s AS sb,
  (cb.d1 - cb.d0) - (ca.d1 - ca.d0) AS dd, ca.u AS ua, cb.u AS ub, (cb.n - ca.n) / ca.n * 100.0 AS pn, (cb.u - ca.u)::DOUBLE / ca.u::DOUBLE * 100.0 AS pu FROM ca, cb),
fmt AS (SELECT *, lambda_n.v AS fn, lambda_u.v AS fu FROM j,
  LATERAL (SELECT (CASE WHEN pn >= 0 THEN '+' ELSE '' END) || CASE WHEN abs(pn) >= 10 AND abs(pn - round_even(pn, 0)) < 0.05 THEN CAST(round_even(pn, 0) AS INT)::VARCHAR ELSE format('{{:.1f}}', pn) END || '%' AS v) lambda_n,
  LATERAL (SELECT (CASE WHEN pu >= 0 THEN '+' ELSE '' END) || CASE WHEN abs(pu) >= 10 AND abs(pu - round_even(pu, 0)) < 0.05 THEN CAST(round_even(pu, 0) AS INT)::VARCHAR ELSE format('{{:.1f}}', pu) END || '%' AS v) lambda_u)
SELECT NULL AS error, fn AS count, (CASE WHEN sb >= sa THEN '+' ELSE '' END) || (sb - sa) AS sources, (CASE WHEN dd >= 0 THEN '+' ELSE '' END) || dd || 'd' AS date_span, fu AS usd_total FROM fmt""")
def _(t):
    return reports.comparison(t.invoices, "household", "urgent")["deltas"]


@query("r4_entity_rollup", f"""
WITH {LIVE}, hh AS (SELECT *, (SELECT min(date) FROM ld WHERE ld.idx = li.idx) AS first FROM li WHERE contains(text, 'Household Goods'))
""" + " UNION ALL ".join([
    section("mentions", "idx | source | first | 'Household Goods' | instr(text, 'Household Goods') - 1 | substr(text, instr(text, 'Shipped'))", "FROM hh"),
    section("totals", "count(*) | count(DISTINCT source) | min(first) | max(first) | count(*) > 100", "FROM hh")]))
def _(t):
    return stacked(reports.entity_rollup(t.invoices, "Household Goods", ["household"]))


NOTES = ("ad | rm | md | un | un + md + rm | un + md + ad | abs(ad - rm) / greatest(un + md + rm, un + md + ad) > 0.5 | {rebuilt} | '{strategy}'")


@query("r5_change_log", f"""WITH {EXACT}, c AS (SELECT count_if(status = 'added') AS ad, count_if(status = 'removed') AS rm, 0 AS md,
  count_if(status = 'unchanged') AS un FROM x)
""" + " UNION ALL ".join([
    section("changes", "status | new_idx | old_idx | source", "FROM x"),
    section("notes", NOTES.format(rebuilt="false", strategy="exact"), "FROM c"),
    section("by_source", "source | status | count(*)", "FROM x GROUP BY source, status")]))
def _(t):
    return stacked(reports.change_log(t.old_snap, t.new_snap, "exact"))


@query("r5b_change_log_semantic", f"""WITH {SEMANTIC}, c AS (SELECT count_if(status = 'added') AS ad, count_if(status = 'removed') AS rm, count_if(status = 'modified') AS md,
  count_if(status = 'unchanged') AS un FROM sx)
""" + " UNION ALL ".join([
    section("changes", "status | new_idx | old_idx | source", "FROM sx"),
    section("notes", NOTES.format(rebuilt="(un + md) / greatest(un + md + rm, un + md + ad) >= 0.98 AND ad + rm + md > 0", strategy="semantic"), "FROM c"),
    section("by_source", "source | status | count(*)", "FROM sx GROUP BY source, status")]))
def _(t):
    return stacked(reports.change_log(t.old_vec, t.new_vec, "semantic"))


query("r6_timeline", f"""WITH {LIVE} SELECT date_trunc('week', ld.date)::DATE AS period, count(*) AS events, count(DISTINCT ld.idx) AS items, min(date) AS first, max(date) AS last
FROM ld JOIN li ON ld.idx = li.idx WHERE contains(lower(text), 'household') GROUP BY 1""")(
    lambda t: reports.timeline(t.invoices, "Household", "week"))
query("r7_trend", f"""WITH {LIVE}, s AS (SELECT date_trunc('month', date)::DATE::VARCHAR AS point, count(*) AS n, sum(value)::DECIMAL(38,4) AS total, min(value) AS low, max(value) AS high FROM lm
WHERE hint = 'surcharge' GROUP BY 1) SELECT *, (SELECT count(*) FROM s) < 3 AS too_few_points FROM s""")(
    lambda t: reports.trend(t.invoices, "fuel_surcharge", grouping="month"))
query("r7b_trend_custom", f"""WITH {LIVE}, s AS (SELECT source AS point, count(*) AS n, sum(value)::DECIMAL(38,4) AS total, min(value) AS low, max(value) AS high FROM lm
WHERE hint = 'paid' GROUP BY 1) SELECT *, (SELECT count(*) FROM s) < 3 AS too_few_points FROM s""")(
    lambda t: reports.trend(t.invoices, "custom", r"Paid (\d+\.\d{2})", "invoice"))
ROLLUP = """SELECT {key} AS key, currency, count(*) AS n, sum(CASE WHEN is_negative THEN 0 ELSE value END)::DECIMAL(38,4) AS charged,
sum(CASE WHEN is_negative THEN value ELSE 0 END)::DECIMAL(38,4) AS refunded FROM lm WHERE {where} GROUP BY 1, 2"""
query("r8_financial_rollup", f"WITH {LIVE} " + ROLLUP.format(key="strftime(date, '%Y-%m')", where="hint = 'invoice'"))(
    lambda t: reports.financial_rollup(t.invoices, "invoice_total", "period"))
query("r8b_financial_by_category", f"WITH {LIVE} " + ROLLUP.format(key="hint", where="date BETWEEN DATE '1995-01-01' AND DATE '1997-06-30'"))(
    lambda t: reports.financial_rollup(t.invoices, "", "category", "1995-01-01", "1997-06-30"))
