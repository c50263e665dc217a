"""Registered queries: predicates, projections and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flags as fl
from ..functions import lexical as lx
from ..functions import text as tx
from ..functions import sqlfuncs
from ..operators import filters
from .queries_retrieval import stem_sql
from .registry import query

# -- predicates and projections -----------------------------------------------------------------

query("p1_decode_flags", """
SELECT idx, (flags & 1) <> 0 AS tombstone, (flags & 2) <> 0 AS pinned, (flags & 4) <> 0 AS has_parent,
  (flags & 8) <> 0 AS has_child, (flags & 16) <> 0 AS has_sibling, ((flags >> 5) & 3)::INT AS perish_class FROM block""")(
    lambda t: t.block.select(
        "idx", fl.is_tombstoned(F.col("flags")).alias("tombstone"), fl.has_bit(F.col("flags"), fl.PINNED).alias("pinned"),
        fl.has_bit(F.col("flags"), fl.HAS_PARENT).alias("has_parent"), fl.has_bit(F.col("flags"), fl.HAS_CHILD).alias("has_child"),
        fl.has_bit(F.col("flags"), fl.HAS_SIBLING).alias("has_sibling"), fl.perish_class(F.col("flags")).alias("perish_class")))

query("p2_decode_perms", """
WITH e AS (SELECT idx, CASE WHEN perms = 0 THEN 3 ELSE perms END AS p FROM block)
SELECT idx, (p & 1) <> 0 AS r, (p & 2) <> 0 AS w, (p & 4) <> 0 AS x FROM e""")(
    lambda t: t.block.select("idx", fl.can_read_bits(F.col("perms")).alias("r"), fl.can_write_bits(F.col("perms")).alias("w"),
                             fl.has_bit(fl.effective_perms(F.col("perms")), fl.PERM_X).alias("x")))

query("p3_decode_lifecycle", """
SELECT idx, CASE lifecycle & 7 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'SUPERSEDED' WHEN 2 THEN 'INCORRECT' WHEN 3 THEN 'DEFERRED'
  WHEN 4 THEN 'ONGOING' ELSE 'UNKNOWN' END AS status, (lifecycle & 8) <> 0 AS urgent, (lifecycle & 16) <> 0 AS important,
  (lifecycle & 32) <> 0 AS to_consolidate FROM block""")(
    lambda t: t.block.select("idx", fl.status_name(F.col("lifecycle")).alias("status"),
                             fl.has_bit(F.col("lifecycle"), fl.URGENT).alias("urgent"),
                             fl.has_bit(F.col("lifecycle"), fl.IMPORTANT).alias("important"),
                             fl.has_bit(F.col("lifecycle"), fl.TO_CONSOLIDATE).alias("to_consolidate")))

query("p4_encode_lifecycle", """
SELECT idx, ((lifecycle & 7) + CASE WHEN idx % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN idx % 3 = 0 THEN 16 ELSE 0 END
  + CASE WHEN idx % 5 = 0 THEN 32 ELSE 0 END)::INT AS packed FROM block""")(
    lambda t: t.block.select("idx", fl.encode_lifecycle(
        fl.status_code(F.col("lifecycle")), F.expr("idx % 2 = 0"), F.expr("idx % 3 = 0"), F.expr("idx % 5 = 0")).alias("packed")))

query("p5_filter_live", "SELECT idx, source FROM passages WHERE NOT tombstone")(
    lambda t: filters.live(t.passages).select("idx", "source"))

MODE_SQL = """SELECT '{m}' AS mode, idx FROM block WHERE flags & 1 = 0
  AND (CASE WHEN perms = 0 THEN 3 ELSE perms END) & 1 <> 0 {w}"""


@query("p6_filter_by_lifecycle", " UNION ALL ".join([
    MODE_SQL.format(m="active_only", w="AND lifecycle & 7 = 0"), MODE_SQL.format(m="include_superseded", w="AND lifecycle & 7 IN (0, 1)"),
    MODE_SQL.format(m="all", w="")]))
def _(t):
    parts = [filters.by_lifecycle(t.block, m).select(F.lit(m).alias("mode"), "idx")
             for m in ("active_only", "include_superseded", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("p7_filter_readable_writable", """
WITH e AS (SELECT idx, CASE WHEN perms = 0 THEN 3 ELSE perms END AS p FROM block)
SELECT 'r' AS kind, idx FROM e WHERE p & 1 <> 0 UNION ALL SELECT 'w', idx FROM e WHERE p & 2 <> 0""")
def _(t):
    return filters.readable(t.block).select(F.lit("r").alias("kind"), "idx").unionByName(
        filters.writable(t.block).select(F.lit("w").alias("kind"), "idx"))


query("p8_filter_text", "SELECT idx, source FROM passages WHERE contains(lower(text), 'thention')")(
    lambda t: filters.text_contains(t.passages, "Thention").select("idx", "source"))


@query("p9_filter_source", """
SELECT idx FROM block WHERE CASE WHEN idx % 4 = 0 THEN source = 'src3' WHEN idx % 4 = 1 THEN source = 'src3'
  ELSE trim(regexp_replace(split_part(text, chr(10), 1), '^(.*) \\(part .*$', '\\1')) = 'src3'
    OR source_hash = ('0x' || substr(md5('src3'), 1, 8))::UBIGINT::BIGINT END""")
def _(t):
    rows = t.block.withColumn("explicit_path", F.expr("CASE WHEN idx % 4 = 0 THEN source END")).withColumn(
        "resolved_path", F.expr("CASE WHEN idx % 4 = 1 THEN source END"))
    return filters.from_source(rows, "src3").select("idx")


query("p10_filter_exact_phrase", "SELECT idx FROM passages WHERE contains(lower(text), 'the on')")(
    lambda t: filters.exact_phrase(t.passages, "  The on ").select("idx"))
query("p11_filter_any_keyword", "SELECT idx FROM passages WHERE contains(lower(text), 'tion') OR contains(lower(text), 'eaux')")(
    lambda t: filters.any_keyword(t.passages, ("tion", "eaux")).select("idx"))
query("p12_filter_toc", "SELECT url AS name FROM pages WHERE contains(lower(url), 'page=2') OR contains(lower(html), 'nicht')")(
    lambda t: filters.toc_filter(t.pages.select(F.col("url").alias("name"), F.col("html").alias("description")), "Nicht").unionByName(
        filters.toc_filter(t.pages.select(F.col("url").alias("name"), F.lit(None).cast("string").alias("description")), "page=2").join(
            filters.toc_filter(t.pages.select(F.col("url").alias("name"), F.col("html").alias("description")), "Nicht").select("name"),
            "name", "left_anti")).select("name"))


@query("p13_like_and_relevance", """
SELECT p.idx, p.source FROM passages p JOIN scored s ON p.idx = s.idx WHERE source LIKE 'src1%' AND cos > 0.05""")
def _(t):
    from ..functions import vectors as vx
    scored = t.vectors.select("idx", vx.cosine("v", t.query_vec).alias("relevance"))
    return filters.like_and_relevance(t.passages.join(scored, "idx"), "src1%", 0.05).select("idx", "source")


@query("p14_project_result", """
WITH l AS (SELECT idx, text, string_split(text, chr(10)) AS ls FROM passages)
SELECT idx, substr(ls[1], 1, 100) AS title, substr(array_to_string(ls[2:3], ' '), 1, 200) AS preview, text AS full_text,
  len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::INT AS words FROM l""")
def _(t):
    return filters.result_fields(t.passages)


query("p15_project_ingested_at", """
SELECT idx, CASE WHEN ts_unix > 0 THEN strftime(make_timestamp(ts_unix * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS ingested_at
FROM block""")(lambda t: t.block.select("idx", filters.ingested_at(F.col("ts_unix")).alias("ingested_at")))
query("p16_display_name", """
SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment WHEN 2 THEN 'u' || c_custkey ELSE 'Unknown' END AS name
FROM customer""")(
    lambda t: t.customer.select(F.col("c_custkey").alias("user_id"), tx.display_name(
        F.expr("CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE ' ' END"), F.expr("CASE WHEN c_custkey % 4 = 1 THEN c_mktsegment END"),
        F.lit(""), F.expr("CASE WHEN c_custkey % 4 = 2 THEN concat('u', c_custkey, '@mail.example') END")).alias("name")))


@query("p17_indexed_paths", """
(SELECT 'pinned' AS path, idx FROM block WHERE flags & 2 <> 0) UNION ALL
(SELECT 'archival', idx FROM block WHERE (flags >> 5) & 3 = 2) UNION ALL
(SELECT 'recent', idx FROM (SELECT idx FROM block ORDER BY ts_unix DESC, idx LIMIT 20))""")
def _(t):
    return (filters.pinned(t.block).select(F.lit("pinned").alias("path"), "idx")
            .unionByName(filters.perishing(t.block, 2).select(F.lit("archival").alias("path"), "idx"))
            .unionByName(filters.recent(t.block, 20).select(F.lit("recent").alias("path"), "idx")))


@query("p18_hide_for_seat", """
SELECT idx, source FROM passages WHERE md5(text) NOT IN (SELECT md5(text) FROM passages WHERE source = 'src4')""")
def _(t):
    hidden = t.passages.select(F.expr("CASE WHEN source = 'src4' THEN 'seat-1' ELSE 'seat-2' END").alias("seat"),
                               filters.content_key(F.col("text")).alias("content_key"))
    return filters.hide_for_seat(t.passages, hidden, "seat-1").select("idx", "source")


# -- lexical functions ----------------------------------------------------------------------------

WORDS_SQL = "SELECT DISTINCT unnest(string_split_regex(lower(text), '\\s+')) AS w FROM benchmark"


def _words(t):
    return t.benchmark.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).distinct()


query("x1_simple_stem", f"SELECT w, {stem_sql('w')} AS stem FROM ({WORDS_SQL})")(
    lambda t: _words(t).select("w", lx.simple_stem(F.col("w")).alias("stem")))


def sql_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


X2 = f"""WITH k AS (SELECT conv_id, turn, text, list_filter(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 2),
  lambda w: trim(lower(w), '?.,!')), lambda w: NOT list_contains({sql_list(lx.QUERY_STOPWORDS)}, w)) AS kw FROM conversations)
SELECT conv_id, turn, CASE WHEN len(kw) > 0 THEN array_to_string(kw, ' ') ELSE text END AS cleaned, len(kw)::INT AS n FROM k"""
query("x2_clean_query", X2)(lambda t: t.conversations.select(
    "conv_id", "turn", lx.clean_query(F.col("text")).alias("cleaned"), F.size(lx.query_keywords(F.col("text"))).alias("n")))

X3 = f"""WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '\\s+'),
  lambda w: regexp_replace(lower(w), '[^a-z0-9]', '', 'g')), lambda w: length(w) >= 2) AS ws FROM conversations),
k AS (SELECT *, list_filter(ws, lambda w: NOT list_contains({sql_list(lx.FILTER_STOPWORDS)}, w)) AS kw FROM p)
SELECT conv_id, turn, array_to_string(CASE WHEN len(kw) > 0 THEN kw ELSE ws END, ' ') AS keywords FROM k"""
query("x3_filter_keywords", X3)(lambda t: t.conversations.select(
    "conv_id", "turn", F.array_join(lx.filter_keywords(F.col("text")), " ").alias("keywords")))

TOKENS = (f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\\-]+'), lambda w: lower(w)), "
          f"lambda w: length(w) > 2 AND NOT list_contains({sql_list(lx.TOKEN_STOPWORDS)}, w))")
query("x4_tokens_bigrams", f"""WITH k AS (SELECT idx, {TOKENS} AS ts FROM passages)
SELECT idx, len(ts)::INT AS n_tokens, greatest(len(ts) - 1, 0)::INT AS n_bigrams, coalesce(ts[1] || ' ' || ts[2], '') AS first_bigram FROM k""")(
    lambda t: t.wide_passages.withColumn("ts", lx.content_tokens(F.col("text"))).select(
        "idx", F.size("ts").alias("n_tokens"), F.size(lx.bigrams(F.col("ts"))).alias("n_bigrams"),
        F.coalesce(F.get(lx.bigrams(F.col("ts")), F.lit(0)), F.lit("")).alias("first_bigram")))

# -- text functions ---------------------------------------------------------------------------------

query("x12_source_slug", """SELECT url, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages""")(
    lambda t: t.pages.select("url", tx.source_slug(F.col("url")).alias("slug")))
query("x13_source_link", """SELECT idx, '[' || source || '](vps://source/' || regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g') || ')' AS link FROM invoices""")(
    lambda t: t.invoices.select("idx", tx.source_link(F.col("source")).alias("link")))
query("x14_snippet", """
WITH f AS (SELECT idx, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM passages),
c AS (SELECT *, substr(flat, 1, 100) AS cut FROM f), h AS (SELECT *, regexp_extract(cut, '^(.*) ', 1) AS head FROM c)
SELECT idx, CASE WHEN flat = '' THEN '(empty passage)' WHEN length(flat) <= 100 THEN flat
  ELSE rtrim(CASE WHEN contains(cut, ' ') AND length(head) >= 50 THEN head ELSE cut END) || '…' END AS snippet FROM h""")(
    lambda t: t.passages.select("idx", tx.snippet(F.col("text"), 100).alias("snippet")))
query("x15_first_content_line", """
WITH r AS (SELECT idx, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM passages),
p AS (SELECT idx, ls, CASE WHEN len(ls) > 1 AND length(ls[1]) <= 120 AND (starts_with(ls[1], '[[[')
    OR regexp_matches(lower(ls[1]), '\\.(md|txt|pdf|docx|html|json|csv|log)$') OR (NOT contains(ls[1], ' ') AND contains(ls[1], '.')))
  THEN ls[2] ELSE ls[1] END AS s FROM r)
SELECT idx, CASE WHEN len(ls) = 0 THEN '(empty passage)' WHEN length(s) > 120 THEN rtrim(substr(s, 1, 119)) || '…' ELSE s END AS line FROM p""")(
    lambda t: t.passages.select("idx", tx.first_content_line(F.col("text")).alias("line")))


@query("x16_valid_utf8", "SELECT count(*) AS n, count(*) AS valid, sum(length(text))::BIGINT AS chars FROM documents")
def _(t):
    raw = t.documents.select(F.col("text").cast("binary").alias("b"), "text")
    return raw.agg(F.count("*").alias("n"), F.count_if(F.is_valid_utf8(F.col("b").cast("string"))).alias("valid"),
                   F.sum(F.length(F.make_valid_utf8(F.col("b").cast("string")))).alias("chars"))


query("x17_join_single_char_runs", """
SELECT c_custkey AS id, substr(c_name, 1, 1) || ' ' || substr(c_name, 2, 1) || ' ' || substr(c_name, 3, 1) || ' x' || chr(10) || 'y' AS t1 FROM customer
""".replace(" || ' x' || chr(10) || 'y'", " || chr(10) || 'tail row' || chr(10) || 'a' || chr(10) || 'b'"))(
    lambda t: t.customer.select(F.col("c_custkey").alias("id"), tx.join_single_char_runs(F.expr(
        "concat_ws('\n', substr(c_name, 1, 1), substr(c_name, 2, 1), substr(c_name, 3, 1), 'tail row', 'a', 'b')")).alias("t1")))
query("x18_truncate_words", """
WITH w AS (SELECT idx, text, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM passages)
SELECT idx, CASE WHEN len(ws) > 200 THEN array_to_string(ws[1:200], ' ') || '...' ELSE text END AS short FROM w""")(
    lambda t: t.passages.select("idx", tx.truncate_words(F.col("text"), 200).alias("short")))
query("x19_label_line", "SELECT idx, source AS label FROM passages")(
    lambda t: t.passages.select("idx", tx.label_line(F.concat("source", F.lit(" (part 3/9)\n"), "text")).alias("label")))
query("x20_strip_upload_prefix", "SELECT idx, source AS name FROM passages")(
    lambda t: t.passages.select("idx", tx.strip_upload_prefix(F.concat(F.substring(F.md5("source"), 1, 8), F.lit("_"), "source")).alias("name")))
query("x21_source_hash", "SELECT page_id, ('0x' || substr(md5(url), 1, 8))::UBIGINT::BIGINT AS h FROM pages")(
    lambda t: t.pages.select("page_id", tx.source_hash(F.col("url")).alias("h")))
query("x22_fnv1a32", """
SELECT page_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda c: unicode(c)::BIGINT)),
  lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM pages""")(
    lambda t: t.pages.select("page_id", tx.fnv1a32(F.col("url")).alias("h")))
query("x23_report_arithmetic", """
WITH n AS (SELECT n_nationkey AS k, n_nationkey + 3 AS a, (n_nationkey * 7) % 11 AS b FROM nation)
SELECT k, CASE WHEN a <= 0 THEN '0%' ELSE CAST(round_even(100.0 * b / a, 0) AS INT) || '%' END AS pct,
  CASE WHEN b > 0 THEN CASE WHEN abs((b - a) * 100.0 / a) >= 10 AND abs((b - a) * 100.0 / a - round_even((b - a) * 100.0 / a, 0)) < 0.05
      THEN (CASE WHEN b >= a THEN '+' ELSE '' END) || CAST(round_even((b - a) * 100.0 / a, 0) AS INT) || '%'
      ELSE (CASE WHEN b >= a THEN '+' ELSE '' END) || format('{:.1f}', (b - a) * 100.0 / a) || '%' END
    ELSE (CASE WHEN b >= a THEN '+' ELSE '' END) || (b - a) END AS delta FROM n""")(
    lambda t: t.nation.select(F.col("n_nationkey").alias("k"), F.expr("n_nationkey + 3").alias("a"), F.expr("n_nationkey * 7 % 11").alias("b")).select(
        "k", tx.percent(F.col("b"), F.col("a")).alias("pct"), tx.delta_label(F.col("a"), F.col("b")).alias("delta")))


def paged_quality(pages):
    """Quality class per document from (doc, page text): few characters, unreadable pages, or text."""
    text = F.trim("text")
    n, good = F.length(text), tx.readable_chars(text)
    bad_page = (n >= 50) & (good < 0.6 * n)
    sums = pages.groupBy("doc").agg(F.sum(n).alias("chars"), F.sum(good).alias("readable"), F.max(bad_page.cast("int")).alias("bad"))
    kind = (F.when(F.col("chars") <= 500, "scanned").when((F.col("bad") == 1) | (F.col("readable") < 0.6 * F.col("chars")), "corrupt")
            .otherwise("text"))
    return sums.select("doc", "chars", "readable", kind.alias("quality"))


query("x24_text_quality", """
WITH p AS (SELECT conv_id AS doc, length(trim(text)) AS n, length(regexp_replace(trim(text), '[^\\x20-\\x7E\\n\\r\\t\\x{A0}-\\x{24F}]', '', 'g')) AS good FROM conversations),
s AS (SELECT doc, sum(n)::BIGINT AS chars, sum(good)::BIGINT AS readable, max(CASE WHEN n >= 50 AND good < 0.6 * n THEN 1 ELSE 0 END) AS bad FROM p GROUP BY 1)
SELECT doc, chars, readable, CASE WHEN chars <= 500 THEN 'scanned' WHEN bad = 1 OR readable < 0.6 * chars THEN 'corrupt' ELSE 'text' END AS quality FROM s""")(
    lambda t: paged_quality(t.conversations.select(F.col("conv_id").alias("doc"), "text")))
query("x25_word_count", "SELECT idx, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::INT AS words FROM passages")(
    lambda t: t.passages.select("idx", tx.word_count(F.col("text")).alias("words")))
query("x26_numeric_dominant", """
SELECT table_id, row, col, trim(val) <> '' AND length(trim(val)) <= 24 AND length(regexp_replace(trim(val), '[^0-9]', '', 'g')) > 0
  AND length(regexp_replace(trim(val), '[^0-9]', '', 'g')) / greatest(length(trim(val)), 1)::DOUBLE >= 0.5 AS num FROM cells""")(
    lambda t: t.cells.select("table_id", "row", "col", tx.numeric_dominant(F.col("val")).alias("num")))
query("x27_collapse_spaced", "SELECT table_id, row, col, CASE WHEN val = 'P R I C E' THEN 'PRICE' ELSE val END AS val FROM cells")(
    lambda t: t.cells.select("table_id", "row", "col", tx.collapse_spaced(F.col("val")).alias("val")))


@query("x28_note_conventions", """
SELECT c_custkey AS id, 'title' AS k, c_name AS v, 'Topic ' || c_nationkey AS target, 'Part' AS heading, 'shown' AS shown, 'market/' || lower(c_mktsegment) AS tag,
  'People/My Page.md' AS path FROM customer""")
def _(t):
    note = F.expr("concat('---\ntitle: ', c_name, '\n---\nSee [[Topic ', c_nationkey, '#Part|shown]] #market/', lower(c_mktsegment), ' end')")
    path = F.concat(F.lit("People/My%20Page "), F.md5(F.col("c_name")), F.lit(".md"))
    n = t.customer.select(F.col("c_custkey").alias("id"), note.alias("note"), path.alias("path"))
    front, link = tx.frontmatter(F.col("note"))[0], tx.wikilinks(F.col("note"))[0]
    return n.select("id", front["key"].alias("k"), front["value"].alias("v"), link["target"].alias("target"),
                    link["heading"].alias("heading"), link["shown"].alias("shown"), tx.hashtags(F.col("note"))[0].alias("tag"),
                    tx.strip_export_hash(F.col("path")).alias("path"))


query("x29_access_rank", """
SELECT corpus_id, grantee, CASE level WHEN 'viewer' THEN 1 WHEN 'commenter' THEN 2 ELSE 3 END AS rank,
  level <> 'viewer' AS annotate, level = 'editor' AS write, false AS share FROM grants""")(
    lambda t: t.grants.select("corpus_id", "grantee", fl.access_rank(F.col("level")).alias("rank"),
                              fl.can(F.col("level"), "annotate").alias("annotate"), fl.can(F.col("level"), "write").alias("write"),
                              fl.can(F.col("level"), "share").alias("share")))


@query("f5_sql_functions", "SELECT idx, round(cos, 6) AS cosine, round(ham, 6) AS hamming, source_hash FROM scored JOIN block USING (idx)")
def _(t):
    sqlfuncs.register(t.spark)
    return t.spark.sql("SELECT idx, round(cosine(v, q), 6) AS cosine, round(hamming(v, q), 6) AS hamming, source_hash(source) AS source_hash "
                       "FROM (SELECT *, (SELECT v FROM {rows} WHERE idx = 7) AS q FROM {rows})",
                       rows=t.vectors.join(t.block.select("idx", "source"), "idx"))


PAID = """
SELECT d.idx, d.date, m.currency, count(*) AS n, sum(m.value)::DECIMAL(38,4) AS total FROM invoice_dates d
JOIN invoice_money m ON d.idx = m.idx WHERE d.source_format = 'long' GROUP BY ALL"""


@query("f4_extraction_views", PAID)
def _(t):
    sqlfuncs.extraction_views(t.invoices, "inv")
    return t.spark.sql("SELECT d.idx, d.date, m.currency, count(*) AS n, CAST(sum(m.value) AS DECIMAL(38,4)) AS total FROM inv_dates d "
                       "JOIN inv_money m ON d.idx = m.idx WHERE d.source_format = 'long' GROUP BY d.idx, d.date, m.currency")


@query("f4b_extraction_table_functions", PAID)
def _(t):
    sqlfuncs.register(t.spark)
    return t.spark.sql("SELECT p.idx, d.date, m.currency, count(*) AS n, CAST(sum(m.value) AS DECIMAL(38,4)) AS total "
                       "FROM {passages} p, LATERAL extract_dates(text) d, LATERAL extract_currency(text) m WHERE d.source_format = 'long' "
                       "GROUP BY p.idx, d.date, m.currency", passages=t.invoices)
