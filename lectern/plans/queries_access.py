"""Registered queries: access decisions and changes to a corpus."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flags as fl
from ..operators import access as acs
from ..operators import filters, mutate
from .registry import query

SEAT = "seat-3"
BEST = "bg AS (SELECT corpus_id, grantee AS seat, level FROM grants)"
EFFECTIVE = f"ef AS (SELECT c.corpus_id, c.name, c.inherit, CASE WHEN owner = '{SEAT}' THEN 'owner' ELSE level END AS access FROM corpora c LEFT JOIN grants g ON c.corpus_id = g.corpus_id AND grantee = '{SEAT}')"


def requests(t):
    """Every customer asks for the corpus of a nation; some ask anonymously, some for an unknown one."""
    return t.customer.select(
        F.col("c_custkey").alias("request_id"),
        F.expr("CASE WHEN c_custkey % 13 = 0 THEN 1000 + c_custkey ELSE CAST(c_nationkey AS BIGINT) END").alias("corpus_id"),
        F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('seat-', c_custkey % 25) END").alias("seat"))


query("g1_mount_decision", """
WITH r AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 13 = 0 THEN 1000 + c_custkey ELSE c_nationkey::BIGINT END AS corpus_id,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'seat-' || (c_custkey % 25) END AS seat FROM customer),
j AS (SELECT r.*, c.corpus_id IS NOT NULL AS reg, c.owner, g.level AS lv FROM r LEFT JOIN corpora c ON r.corpus_id = c.corpus_id LEFT JOIN grants g ON r.corpus_id = g.corpus_id AND r.seat = g.grantee)
SELECT request_id, corpus_id, seat, NOT reg OR coalesce(seat = owner, false) OR (seat IS NOT NULL AND lv IS NOT NULL) AS allowed,
  CASE WHEN NOT reg THEN 'unregistered' WHEN seat = owner THEN 'owner' WHEN seat IS NULL THEN 'anonymous' WHEN lv IS NOT NULL THEN 'granted' ELSE 'no grant' END AS reason,
  CASE WHEN NOT reg THEN NULL WHEN seat = owner THEN 'owner' WHEN seat IS NULL THEN NULL ELSE lv END AS level FROM j""")(
    lambda t: acs.mount_decision(t.corpora, t.grants, requests(t)))
query("g2_effective_access", f"WITH {EFFECTIVE} SELECT corpus_id, name, access FROM ef")(lambda t: acs.effective_access(t.corpora, t.grants, SEAT))
query("g3_access_for_name", f"WITH {EFFECTIVE} SELECT name, access FROM ef UNION ALL SELECT 'elsewhere-' || n_name, 'unregistered' FROM nation")(
    lambda t: acs.access_for_names(t.corpora.select("name").unionByName(t.nation.select(F.concat(F.lit("elsewhere-"), "n_name").alias("name"))),
                                   t.corpora, t.grants, SEAT))
query("g4_visible_corpora", f"""WITH {EFFECTIVE} SELECT corpus_id, name, access, true AS can_read, access <> 'viewer' AS can_annotate, access IN ('editor', 'owner') AS can_write,
  access = 'owner' AS can_share, access = 'owner' AS can_sign FROM ef WHERE access IS NOT NULL""")(lambda t: acs.visible_corpora(t.corpora, t.grants, SEAT))

RANK = "(CASE coalesce({c}, '') WHEN 'viewer' THEN 1 WHEN 'commenter' THEN 2 WHEN 'editor' THEN 3 WHEN 'owner' THEN 4 ELSE 0 END)"
RESOLVED = f"""{EFFECTIVE},
ro AS (SELECT b.idx, b.idx % 25 AS corpus_id, ef.access AS cl, ef.inherit, e.level AS ex, x.level AS xp, CASE WHEN b.perms = 0 THEN 3 ELSE b.perms END AS perms
  FROM block b LEFT JOIN ef ON ef.corpus_id = b.idx % 25 LEFT JOIN exceptions e ON e.corpus_id = b.idx % 25 AND e.source_hash = b.source_hash AND e.seat = '{SEAT}'
  LEFT JOIN exposures x ON x.corpus_id = b.idx % 25 AND x.source_hash = b.source_hash),
rs AS (SELECT *, CASE WHEN ex IS NOT NULL THEN 'exception' WHEN cl = 'owner' THEN 'owner' WHEN xp IS NOT NULL THEN 'explicit' WHEN inherit THEN 'inherited' ELSE 'withheld' END AS origin,
  CASE WHEN ex = 'deny' THEN false WHEN ex IS NOT NULL THEN true WHEN cl = 'owner' THEN true WHEN xp IS NOT NULL THEN {RANK.format(c='cl')} >= {RANK.format(c='xp')} WHEN inherit THEN true ELSE false END AS rd,
  CASE WHEN ex = 'deny' THEN false WHEN ex IS NOT NULL THEN ex IN ('editor', 'owner') WHEN cl = 'owner' THEN true
    WHEN xp IS NOT NULL THEN {RANK.format(c='cl')} >= {RANK.format(c='xp')} AND coalesce(cl IN ('editor', 'owner'), false)
    WHEN inherit THEN cl IS NULL OR cl IN ('editor', 'owner') ELSE false END AS wr FROM ro),
dec AS (SELECT idx, corpus_id, rd AND perms & 1 <> 0 AS may_read, wr AND perms & 2 <> 0 AS may_write, origin FROM rs)"""


def placed(t):
    return t.block.select("idx", "source_hash", "perms", F.expr("idx % 25").alias("corpus_id"))


def seen(t):
    legacy = placed(t).withColumn("perms", fl.effective_perms(F.col("perms")))
    return acs.seat_view(legacy, t.corpora, t.grants, t.exceptions, t.exposures, SEAT)


query("g5_resolve_object", f"WITH {RESOLVED} SELECT * FROM dec")(lambda t: seen(t).select("idx", "corpus_id", "may_read", "may_write", "origin"))


@query("g6_document_key", """
SELECT idx, CASE WHEN idx % 11 = 0 THEN 'malformed' WHEN idx % 5 <> 0 THEN 'hash' WHEN idx % 3 = 0 THEN 'from path' WHEN idx % 2 = 0 THEN 'malformed' ELSE 'no provenance' END AS reason,
  CASE WHEN idx % 11 <> 0 AND (idx % 5 <> 0 OR idx % 3 = 0) THEN source_hash END AS document_key FROM block""")
def _(t):
    rows = t.block.select("idx", F.expr("CASE WHEN idx % 5 <> 0 THEN source_hash END").alias("source_hash"),
                          F.expr("CASE WHEN idx % 3 = 0 THEN source END").alias("source_path"),
                          F.expr("CASE WHEN idx % 2 = 0 THEN 4 END").alias("source_idx"), F.expr("idx % 11 <> 0").alias("well_formed"))
    return acs.with_document_key(rows).select("idx", "reason", "document_key")


@query("g7_secure_search", f"""WITH {RESOLVED} SELECT row_number() OVER (ORDER BY cos DESC, s.idx)::INT AS rank, s.idx, round(cos, 6) AS score FROM scored s JOIN dec ON dec.idx = s.idx
WHERE may_read ORDER BY cos DESC, s.idx LIMIT 10""")
def _(t):
    readable = acs.readable_for(placed(t), t.corpora, t.grants, t.exceptions, t.exposures, SEAT)
    return acs.secure_search(t.vectors, t.query_vec, readable, 10).select("rank", "idx", F.round("score", 6).alias("score"))


query("g8_mark_grandfathered", f"WITH {RESOLVED} SELECT idx, corpus_id % 4 = 0 AND origin = 'inherited' AND may_read AS grandfathered FROM dec")(
    lambda t: acs.mark_grandfathered(seen(t).withColumn("explicit_now", F.expr("corpus_id % 4 = 0"))).select("idx", "grandfathered"))
query("g9_sidecar_level", """
SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'editor' WHEN 1 THEN 'commenter' WHEN 2 THEN 'viewer' WHEN 3 THEN 'editor' WHEN 4 THEN 'viewer' ELSE 'viewer' END AS level FROM customer""")(
    lambda t: t.customer.select(F.col("c_custkey").alias("id"), acs.sidecar_level(F.expr(
        "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '{\"access_level\": \" Commenter \"}' WHEN 2 THEN '{\"default\": \"r\"}' "
        "WHEN 3 THEN '{\"access_level\": \"boss\", \"default\": \"rwx\"}' WHEN 4 THEN '{\"role\": \"editor\"}' ELSE 'not json' END")).alias("level")))


def mirrored(t):
    """Corpora with a south- twin of each north- one, same owner."""
    return t.corpora.unionByName(t.corpora.select(
        (F.col("corpus_id") + 100).alias("corpus_id"), "owner", F.replace("name", F.lit("north-"), F.lit("south-")).alias("name"), "inherit"))


def grants_with_some_mirrored(t):
    return t.grants.unionByName(t.grants.filter("corpus_id < 5 AND level = 'editor'").withColumn("corpus_id", F.col("corpus_id") + 100))


MIRROR = "mg AS (SELECT * FROM grants UNION ALL SELECT corpus_id + 100, grantee, level FROM grants WHERE corpus_id < 5 AND level = 'editor')"
query("g10_mirror_grants", "SELECT corpus_id + 100 AS corpus_id, grantee, level FROM grants WHERE NOT (corpus_id < 5 AND level = 'editor')")(
    lambda t: acs.mirror_grants(mirrored(t), grants_with_some_mirrored(t), "north-", "south-"))
query("j7_grants_with_corpora", f"WITH {EFFECTIVE} SELECT name, access FROM ef WHERE access IS NOT NULL")(
    lambda t: acs.access_for_names(t.corpora.select("name"), t.corpora, t.grants, SEAT).filter("access IS NOT NULL"))
query("j8_mirrored_grants", "SELECT count(*) AS n, count(DISTINCT corpus_id) AS corpora FROM grants WHERE NOT (corpus_id < 5 AND level = 'editor')")(
    lambda t: acs.mirror_grants(mirrored(t), grants_with_some_mirrored(t), "north-", "south-").agg(
        F.count("*").alias("n"), F.count_distinct("corpus_id").alias("corpora")))
query("j9_two_sided_counts", f"""WITH {MIRROR}, n AS (SELECT corpus_id, count(*) AS k FROM mg GROUP BY 1)
SELECT c.name AS original, coalesce(a.k, 0) AS grants_before, replace(c.name, 'north-', 'south-') AS mirrored, coalesce(b.k, 0) AS grants_after
FROM corpora c LEFT JOIN n a ON a.corpus_id = c.corpus_id LEFT JOIN n b ON b.corpus_id = c.corpus_id + 100""")(
    lambda t: acs.mirror_check(mirrored(t), grants_with_some_mirrored(t), "north-", "south-"))

# -- changes ---------------------------------------------------------------------------------------------

query("m1_append", """SELECT (SELECT max(idx) FROM passages) + row_number() OVER (ORDER BY conv_id * 1000 + turn) AS idx, text FROM conversations WHERE trim(text) <> ''""")(
    lambda t: mutate.append(t.passages, t.conversations.filter("trim(text) <> ''").select(F.expr("conv_id * 1000 + turn").alias("o"), "text"), "o").select("idx", "text"))


def change_log_rows(t):
    return t.events.select(F.expr("user_id").alias("idx"), F.expr("CASE WHEN event_type IN ('click', 'view') THEN 'delete' ELSE 'restore' END").alias("op"), "ts")


LOG = """lg AS (SELECT user_id AS idx, arg_max(CASE WHEN event_type IN ('click', 'view') THEN 'delete' ELSE 'restore' END, ts) AS op FROM events GROUP BY 1),
cu AS (SELECT p.idx, source, coalesce(op = 'delete', tombstone) AS tombstone FROM passages p LEFT JOIN lg ON p.idx = lg.idx)"""
query("m2_tombstone_log", f"WITH {LOG} SELECT idx, tombstone FROM cu")(
    lambda t: mutate.apply_log(t.passages, change_log_rows(t)).select("idx", "tombstone"))
query("m2b_list_deleted", f"WITH {LOG} SELECT idx, source FROM cu WHERE tombstone")(lambda t: mutate.list_deleted(t.passages, change_log_rows(t)))
query("m3_tombstone_by_source", "SELECT idx, tombstone OR source = 'src6' AS tombstone FROM passages")(
    lambda t: mutate.apply_log(t.passages, mutate.delete_source(t.passages, "src6", F.lit("2024-01-01").cast("timestamp_ntz"))).select("idx", "tombstone"))


@query("m4_edit", """
WITH e AS (SELECT idx, text, source, (SELECT max(idx) FROM passages) + row_number() OVER (ORDER BY idx) AS new_idx FROM passages WHERE source = 'src8')
SELECT 'appended' AS kind, new_idx AS idx, text || ' edited' AS value FROM e UNION ALL SELECT 'succession', new_idx, substr(sha256(text), 1, 16) FROM e
UNION ALL SELECT 'log', idx, 'delete' FROM e""")
def _(t):
    edits = t.passages.filter("source = 'src8'").select("idx", F.concat("text", F.lit(" edited")).alias("new_text"))
    out = mutate.edit(t.passages, edits, F.lit("2024-01-01").cast("timestamp_ntz"))
    return (out["appended"].select(F.lit("appended").alias("kind"), "idx", F.col("text").alias("value"))
            .unionByName(out["succession"].select(F.lit("succession").alias("kind"), F.col("new_idx").alias("idx"), F.col("old_key").alias("value")))
            .unionByName(out["log"].select(F.lit("log").alias("kind"), "idx", F.col("op").alias("value"))))


@query("m5_resolve_succession", """
WITH RECURSIVE nx AS (SELECT 'c' || conv_id || '-' || turn AS old_key, 'c' || conv_id || '-' || (turn + 1) AS new_key FROM conversations
  WHERE (conv_id, turn + 1) IN (SELECT conv_id, turn FROM conversations)),
w AS (SELECT 'c' || conv_id || '-' || turn AS key, 'c' || conv_id || '-' || turn AS current FROM conversations UNION ALL SELECT w.key, nx.new_key FROM w JOIN nx ON nx.old_key = w.current)
SELECT key, current FROM w WHERE current NOT IN (SELECT old_key FROM nx)""")
def _(t):
    turns = t.conversations.select("conv_id", "turn").distinct()
    follows = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("f"))
    name = "concat('c', conv_id, '-', {})"
    links = turns.join(follows, ["conv_id", "turn"]).select(
        F.expr(name.format("turn")).alias("old_key"), F.expr(name.format("turn + 1")).alias("new_key"), F.col("turn").alias("ts"))
    return mutate.resolve_succession(turns.select(F.expr(name.format("turn")).alias("key")), links)


@query("m6_set_perms", """
WITH r AS (SELECT n_nationkey * 7 AS lo, n_nationkey * 7 + n_nationkey % 9 AS hi, n_nationkey % 4 AS mask, n_nationkey AS seq FROM nation),
h AS (SELECT b.idx, arg_max(mask, seq) AS mask FROM block b JOIN r ON b.idx >= lo AND b.idx < hi GROUP BY 1)
SELECT b.idx, coalesce(h.mask, b.perms)::INT AS perms FROM block b LEFT JOIN h ON h.idx = b.idx""")
def _(t):
    ranges = t.nation.selectExpr("n_nationkey * 7 AS lo", "n_nationkey * 7 + n_nationkey % 9 AS hi", "n_nationkey % 4 AS mask", "n_nationkey AS seq")
    return mutate.set_perms(t.block.select("idx", "perms"), ranges).select("idx", "perms")


@query("m6b_set_perms_overlapping", """
WITH r AS (SELECT user_id % 90 AS lo, CASE WHEN event_id % 7 = 0 THEN (SELECT max(idx) + 1 FROM block) ELSE user_id % 90 + event_id % 60 END AS hi, event_id % 4 AS mask, event_id AS seq FROM events WHERE event_id % 60 > 0 AND event_id % 11 = 0),
h AS (SELECT b.idx, arg_max(mask, seq) AS mask FROM block b JOIN r ON b.idx >= lo AND b.idx < hi GROUP BY 1)
SELECT b.idx, coalesce(h.mask, b.perms)::INT AS perms FROM block b LEFT JOIN h ON h.idx = b.idx""")
def _(t):
    """Many ranges over the same ids, some without an end."""
    ranges = t.events.filter("event_id % 60 > 0 AND event_id % 11 = 0").selectExpr(
        "user_id % 90 AS lo", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id % 90 + event_id % 60 END AS hi", "CAST(event_id % 4 AS INT) AS mask", "event_id AS seq")
    return mutate.set_perms(t.block.select("idx", "perms"), ranges).selectExpr("idx", "CAST(perms AS INT) AS perms")


@query("m7_statements", """
SELECT idx, source, tombstone OR source = 'src1' AS tombstone, CASE WHEN source = 'src2' THEN 'reviewed' ELSE '' END AS tags FROM passages
UNION ALL SELECT (SELECT max(idx) FROM passages) + row_number() OVER (ORDER BY item_id), 'manual-entry', false, '' FROM benchmark""")
def _(t):
    base = t.passages.select("idx", "text", "source", "tombstone", F.array().cast("array<string>").alias("tags"))
    fresh = t.benchmark.select("item_id", "text", F.lit("manual-entry").alias("source"), F.lit(False).alias("tombstone"),
                               F.array().cast("array<string>").alias("tags"))
    grown = mutate.insert_into(base, fresh, "item_id").drop("item_id")
    tagged = mutate.update_tags(grown, F.col("source") == "src2", ["reviewed"])
    gone = mutate.delete_where(tagged, F.col("source") == "src1")
    return gone.select("idx", "source", "tombstone", F.array_join("tags", ",").alias("tags"))
