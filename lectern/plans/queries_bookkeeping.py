"""Registered queries: sources and sinks, joins, counts, windows, pages, set operations."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import corpus as cp
from ..operators import diff, filters, joins, ranking
from ..operators import retrieval as rt
from ..session import scratch_path
from ..sources import archives, catalog, corpus_io, documents
from .fixtures import QUERY_IDX
from .registry import query

# -- sources and sinks ----------------------------------------------------------------------------


@query("s1_scan_passages", "SELECT idx, text, source FROM passages WHERE NOT tombstone")
def _(t):
    return filters.live(t.passages).select("idx", "text", "source")


def packed_archives(t) -> DataFrame:
    """The corpus written as array archives, with formats 2 and 3 blocks: one per Arrow batch, or several where its longest
    text, whose width every row of the text array takes, would make that array large."""
    rows = t.block.join(t.embeddings.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("v")), "idx")

    def pack(batches):
        import io
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        layout = np.dtype([("id", "<u4"), ("version", "u1"), ("kind", "u1"), ("prev", "<u4"), ("next", "<u4"), ("sibling", "<u4"),
                           ("source", "<u4"), ("sequence", "<u2"), ("ts", "<u4"), ("flags", "u1"), ("perms", "u1"),
                           ("lifecycle", "u1"), ("rest", "V33")])
        def cut(batch):
            longest = pc.max(pc.utf8_length(batch.column("text"))).as_py() or 0
            step = max(1, archives.BYTES_PER_BATCH // (4 * max(longest, 1)))
            yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))

        for batch in (part for whole in batches for part in cut(whole)):
            n = batch.num_rows
            col = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in
                   ("idx", "source_hash", "ts_unix", "flags", "perms", "lifecycle")}
            raw = np.zeros(n, dtype=layout)
            raw["id"] = col["idx"] + 1
            raw["version"] = np.where(col["idx"] % 2 == 0, 2, 3)
            raw["prev"], raw["next"] = col["idx"], col["idx"] + 2
            raw["source"] = np.where(raw["version"] == 2, col["source_hash"], col["idx"] % 65536)
            raw["ts"], raw["flags"], raw["perms"], raw["lifecycle"] = (col[c] for c in ("ts_unix", "flags", "perms", "lifecycle"))
            buf = io.BytesIO()
            np.savez_compressed(
                buf, embeddings=np.array(batch.column("v").to_pylist(), dtype=np.float32),
                passages=np.array(batch.column("text").to_pylist()), source_paths=np.array(batch.column("source").to_pylist()),
                hippocampus=np.frombuffer(raw.tobytes(), dtype=np.uint8).reshape(n, 64))
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{col['idx'][0]}.npz"]), pa.array([buf.getvalue()], pa.binary())],
                                             names=["path", "content"])

    return rows.mapInArrow(pack, "path string, content binary")


@query("s2_ingest_archives", """
SELECT b.idx, b.text, b.source, 64 AS dim, round(list_sum(e.embedding::DOUBLE[]), 4) AS v_sum
FROM block b JOIN embeddings e ON b.idx = e.vec_id""")
def _(t):
    rows = archives.ingest(packed_archives(t))
    total = F.aggregate(vx.doubles("v"), F.lit(0.0), lambda s, x: s + x)
    return rows.select((archives.unpack_block(F.col("block"))["pattern_id"] - 1).alias("idx"), "text", "source",
                       F.size("v").alias("dim"), F.round(total, 4).alias("v_sum"))


@query("s3_unpack_block", """
SELECT idx + 1 AS pattern_id, CASE WHEN idx % 2 = 0 THEN 2 ELSE 3 END AS format_version, 0 AS corpus_type,
  CASE WHEN idx > 0 THEN idx - 1 END AS prev_idx, idx + 1 AS next_idx, CASE WHEN idx % 2 = 0 THEN source_hash END AS source_hash,
  CASE WHEN idx % 2 = 1 THEN idx % 65536 END AS source_idx, 0 AS sequence, ts_unix, flags, perms, lifecycle
FROM block WHERE idx IN (SELECT vec_id FROM embeddings)""")
def _(t):
    return archives.ingest(packed_archives(t)).select(archives.unpack_block(F.col("block")).alias("b")).select("b.*")


@query("s5_normalize_sources", """
WITH g AS (SELECT source, min(idx) AS f, count(*) AS n FROM passages WHERE source <> '' GROUP BY 1)
SELECT row_number() OVER (ORDER BY f) AS source_idx, source, n FROM g
UNION ALL SELECT 0, '', count(*) FROM passages WHERE source = ''""")
def _(t):
    return corpus_io.normalize_sources(t.passages)


@query("s6_recover_source", "SELECT idx, source FROM passages")
def _(t):
    rows = t.passages.select("idx", F.expr("CASE WHEN idx % 4 = 0 THEN source END").alias("a"),
                             F.expr("CASE WHEN idx % 4 = 1 THEN source ELSE '' END").alias("b"),
                             F.expr("CASE WHEN idx % 4 = 2 THEN source END").alias("c"),
                             F.concat("source", F.lit(" (part 1/2)\n"), "text").alias("text"))
    return rows.select("idx", corpus_io.recover_source(F.col("a"), F.col("b"), F.col("c"), F.col("text")).alias("source"))


DISPLAY = "coalesce(nullif(regexp_extract(stem, '^[0-9a-f]{12}_(.+)$', 1), ''), stem)"
PLACE = "CASE location WHEN 'canonical' THEN 1 WHEN 'sandbox' THEN 2 ELSE 3 END"


@query("s7_catalog_list", f"""
WITH r AS (SELECT *, {DISPLAY} AS display, row_number() OVER (PARTITION BY stem ORDER BY suffix <> '.npz', {PLACE}, mtime DESC, size) AS rn
  FROM files WHERE size >= 1024) SELECT stem, suffix, location, size, mtime, display FROM r WHERE rn = 1""")
def _(t):
    return catalog.catalog(t.files)


@query("s8_resolve_name", f"""
WITH w AS (SELECT DISTINCT {DISPLAY} AS name FROM files),
c AS (SELECT stem AS name, stem, location, mtime, CASE WHEN location = 'sandbox' THEN 2 ELSE 1 END AS rung FROM files WHERE suffix = '.npz'
  UNION ALL SELECT {DISPLAY}, stem, location, mtime, 3 FROM files WHERE suffix = '.npz' AND location = 'sandbox'),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rung, mtime DESC, stem) AS rn FROM c)
SELECT w.name, r.stem, r.location, r.mtime FROM w LEFT JOIN r ON w.name = r.name AND rn = 1""")
def _(t):
    shown = F.coalesce(F.nullif(F.regexp_extract("stem", catalog.SANDBOX_STEM, 1), F.lit("")), F.col("stem"))
    return catalog.resolve(t.files.select(shown.alias("name")).distinct(), t.files)


@query("s9_read_folder", "SELECT sum(length(text) + 1)::BIGINT AS chars FROM conversations WHERE trim(text) <> ''")
def _(t):
    path = scratch_path(t.spark, "texts")
    t.conversations.filter("trim(text) <> ''").select("text").write.option("maxRecordsPerFile", 1000).text(path)
    read = documents.read_folder(t.spark, path)
    return read.agg(F.sum(F.length("text")).cast("bigint").alias("chars"))


@query("s10_read_jsonl", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '{bad ' || text ELSE text END AS text FROM conversations WHERE trim(text) <> ''")
def _(t):
    line = F.expr("CASE turn % 3 WHEN 0 THEN to_json(named_struct('text', text)) WHEN 1 THEN to_json(named_struct('content', text)) "
                  "ELSE concat('{bad ', text) END")
    return documents.read_jsonl(t.conversations.filter("trim(text) <> ''").select("conv_id", "turn", line.alias("value")))


@query("s11_flatten_json", """
SELECT event_id, 'at.ids[0]: ' || user_id || chr(10) || 'at.ids[1].deep[0].u: None' || chr(10) || 'at.ids[1].ok: ' || CASE WHEN value > 50 THEN 'True' ELSE 'False' END
  || chr(10) || 'at.type: ' || event_type || chr(10) || 'k: ' || json_extract_string(props, '$.k') AS lines FROM events""")
def _(t):
    nested = F.expr("concat(substr(props, 1, length(props) - 1), ', \"at\": {\"type\": \"', event_type, '\", \"ids\": [', user_id, "
                    "', {\"ok\": ', value > 50, ', \"deep\": [{\"u\": null}], \"none\": {}}]}}')")
    return documents.flatten_json(t.events.select("event_id", nested.alias("raw")), "raw").select("event_id", "lines")


HTML = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for tag in ("script", "style", "noscript"):
    HTML = f"regexp_replace({HTML}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', '', 'g')"
HTML = f"regexp_replace({HTML}, '(?s)<[^>]*>', chr(10), 'g')"
for mark, char in documents.ENTITIES:
    HTML = "replace({}, '{}', '{}')".format(HTML, mark, char.replace("'", "''"))


@query("s12_html_to_text", f"SELECT page_id, regexp_replace(regexp_replace({HTML}, '\\s*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM pages")
def _(t):
    return t.pages.select("page_id", documents.html_to_text(F.col("html")).alias("text"))


@query("s13_html_table_cells", """
SELECT o_orderkey AS id, r AS row, c AS col, CASE r WHEN 0 THEN ['Order', 'Total', ''][c + 1]
  ELSE [o_orderkey::VARCHAR, '$' || format('{:,.2f}', o_totalprice), 'paid & closed'][c + 1] END AS val
FROM orders, (VALUES (0), (1)) a(r), (VALUES (0), (1), (2)) b(c)""")
def _(t):
    html = F.expr("concat('<table><tr><th>Order</th><th> Total </th></tr><TR class=x><td>', o_orderkey, '</td><td><b>$', format_number(o_totalprice, 2), "
                  "'</b></td><td>paid  &amp;\nclosed</td></TR><tr></tr></table>')")
    return documents.html_table_cells(t.orders.select(F.col("o_orderkey").alias("id"), html.alias("html")))


@query("s14_markdown_sections", """
WITH m AS (SELECT doc_id, '# Top' || chr(10) || '## ' || source || chr(10) || text || chr(10) || '## Tail' AS text FROM documents),
s AS (SELECT doc_id, unnest(string_split(replace(text, chr(10) || '## ', chr(10) || chr(1) || '## '), chr(10) || chr(1))) AS part,
  unnest(range(1, 1 + len(string_split(replace(text, chr(10) || '## ', chr(10) || chr(1) || '## '), chr(10) || chr(1))))) AS section FROM m)
SELECT doc_id, section::INT AS section, regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS text FROM s WHERE trim(part) <> ''""")
def _(t):
    md = F.concat(F.lit("# Top\n## "), "source", F.lit("\n"), "text", F.lit("\n## Tail"))
    return documents.markdown_sections(t.documents.select("doc_id", md.alias("text")))


@query("s15_write_corpus_compact", """
SELECT c AS corpus_id, row_number() OVER (PARTITION BY c ORDER BY idx) - 1 AS idx, text FROM (SELECT lang AS c, idx, text FROM passages WHERE NOT tombstone)""")
def _(t):
    path = scratch_path(t.spark, "corpus")
    corpus_io.write_corpus(t.passages.withColumn("corpus_id", F.col("lang")), path, compact=True)
    return corpus_io.scan_passages(t.spark, path).select("corpus_id", "idx", "text")


MICRO = "array_to_string(list_transform({v}, lambda x: round_even(x * 1000000, 0)::BIGINT), ',')"
FP = f"""SELECT count(*) AS count, substr(sha256(arg_min({MICRO.format(v='v')}, idx) || '|' || arg_max({MICRO.format(v='v')}, idx) || '|' || count(*)), 1, 16) AS fingerprint FROM """


@query("s16_corpus_fingerprint", FP + "vectors")
def _(t):
    return corpus_io.fingerprint(t.vectors)


@query("s17_validate_manifest", """
WITH o AS (SELECT source AS corpus_id, count(*) AS c FROM old_snap GROUP BY 1), n AS (SELECT source AS corpus_id, count(*) AS c FROM new_snap GROUP BY 1)
SELECT coalesce(o.corpus_id, n.corpus_id) AS corpus_id, CASE WHEN o.c IS NULL THEN 'legacy' WHEN n.c IS NULL THEN 'missing'
  WHEN o.c <> n.c THEN 'count mismatch' WHEN coalesce(o.corpus_id, n.corpus_id) LIKE '%3' THEN 'fingerprint mismatch' ELSE 'ok' END AS status
FROM o FULL JOIN n ON o.corpus_id = n.corpus_id""")
def _(t):
    def manifest(df, mark):
        fp = F.when(F.col("source").like("%3"), F.lit(mark)).otherwise(F.lit("same"))
        return df.groupBy(F.col("source").alias("corpus_id"), fp.alias("fingerprint")).agg(F.count("*").alias("count"))
    return corpus_io.validate_manifest(manifest(t.old_snap, "a"), manifest(t.new_snap, "b"))


@query("s18_fetch_full_text", """
WITH cand AS (SELECT idx FROM scored ORDER BY cos DESC, idx LIMIT 25) SELECT p.idx, p.text FROM passages p JOIN cand c ON p.idx = c.idx""")
def _(t):
    ids = rt.best(t.vectors.select("idx", vx.cosine("v", t.query_vec).alias("score")), 25)
    return corpus_io.fetch_full_text(ids, t.passages)


@query("s19_write_report_csv", "SELECT source, count(*) AS n FROM passages GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "report")
    corpus_io.write_report_csv(t.passages.groupBy("source").agg(F.count("*").alias("n")), path)
    return t.spark.read.schema("source string, n bigint").csv(path, header=True)


@query("s20_read_pattern_meta", """
SELECT c_custkey AS id, i AS idx, CASE i WHEN 0 THEN c_name ELSE c_mktsegment END AS source, CASE i WHEN 0 THEN 'document' ELSE 'table' END AS content_type,
  ['a', lower(c_mktsegment)][1 + i] AS first_tag, CASE WHEN i = 1 THEN c_nationkey END AS page FROM customer, (VALUES (0), (1)) v(i)""")
def _(t):
    meta = F.expr("concat('[{\"v\":1,\"source\":\"', c_name, '\",\"tags\":[\"a\"],\"content_type\":\"document\"},{\"source\":\"', c_mktsegment, "
                  "'\",\"tags\":[\"', lower(c_mktsegment), '\"],\"content_type\":\"table\",\"page\":', c_nationkey, '}]')")
    rows = documents.read_pattern_meta(t.customer.select(F.col("c_custkey").alias("id"), meta.alias("meta")))
    return rows.select("id", "idx", "source", "content_type", F.col("tags")[0].alias("first_tag"), "page")


@query("s21_read_corpus_header", """
SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 3 = 1 THEN 'ada' END AS owner, n AS position, 'f' || n AS file,
  n_nationkey + n AS chunks, n IS NULL AS derive_from_hash
FROM nation LEFT JOIN (VALUES (0), (1)) v(n) ON n < n_nationkey % 3""")
def _(t):
    header = F.expr(
        "concat('{\"cart_name\":\"', n_name, '\",\"files\":[', CASE n_nationkey % 3 WHEN 0 THEN '' "
        "WHEN 1 THEN concat('{\"name\":\"f0\",\"owner\":\"ada\",\"chunks\":', n_nationkey, '}') "
        "ELSE concat('{\"name\":\"f0\",\"owner\":\"ada\",\"chunks\":', n_nationkey, '},{\"name\":\"f1\",\"chunks\":', n_nationkey + 1, '}') END, ']}')")
    rows = documents.read_header(t.nation.select(F.col("n_nationkey").alias("id"), header.alias("header")))
    return rows.select("id", "name", "owner", "position", "file", "chunks", "derive_from_hash")


# -- joins ------------------------------------------------------------------------------------------

@query("j1_passages_with_vectors", """
SELECT doc_id AS idx, true AS has_passage, vec_id IS NOT NULL AS has_vector FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE vec_id IS NULL
UNION ALL SELECT vec_id, false, true FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def _(t):
    return joins.length_mismatch(t.passages, t.embeddings.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("v")))


@query("j2_source_names", "SELECT idx, CASE WHEN source = 'src9' THEN '' ELSE source END AS source FROM passages")
def _(t):
    table = t.passages.filter("source <> 'src9'").select(F.expr("cast(substr(source, 4) AS INT)").alias("source_idx"), "source").distinct()
    rows = t.passages.select("idx", F.expr("cast(substr(source, 4) AS INT)").alias("source_idx"))
    return joins.with_source_names(rows, table).select("idx", "source")


@query("j3_results_with_block", """
WITH cand AS (SELECT idx, cos FROM scored ORDER BY cos DESC, idx LIMIT 25)
SELECT c.idx, round(cos, 6) AS score, flags, perms, b.source, p.lang FROM cand c LEFT JOIN block b ON c.idx = b.idx LEFT JOIN passages p ON c.idx = p.idx""")
def _(t):
    few = rt.best(t.vectors.select("idx", vx.cosine("v", t.query_vec).alias("score")), 25)
    return joins.attach(few, t.block.select("idx", "flags", "perms", "source"), t.passages.select("idx", "lang")).withColumn(
        "score", F.round("score", 6))


@query("j4_results_with_candidates", """
WITH a AS (SELECT idx, cos FROM scored ORDER BY cos DESC, idx LIMIT 50), b AS (SELECT idx, ham FROM scored ORDER BY ham DESC, idx LIMIT 50)
SELECT a.idx, round(cos, 6) AS cos, round(ham, 6) AS ham FROM a JOIN b ON a.idx = b.idx""")
def _(t):
    both = t.vectors.select("idx", vx.similarity("v", t.query_vec).alias("s"))
    a = rt.best(both.select("idx", F.col("s.cosine").alias("cos")), 50, "cos")
    b = rt.best(both.select("idx", F.col("s.hamming").alias("ham")), 50, "ham")
    return a.join(b, "idx").select("idx", F.round("cos", 6).alias("cos"), F.round("ham", 6).alias("ham"))


query("j5_drop_tombstones", "SELECT idx, source FROM passages WHERE NOT tombstone")(
    lambda t: joins.drop_ids(t.passages, t.tombstones).select("idx", "source"))


@query("j6_keep_by_content_key", "SELECT idx FROM passages WHERE md5(text) IN (SELECT md5(text) FROM passages WHERE source = 'src2')")
def _(t):
    keyed = t.passages.withColumn("content_key", filters.content_key(F.col("text")))
    return joins.keep_ids(keyed, keyed.filter("source = 'src2'"), "content_key").select("idx")


@query("j12_snapshot_text_match", """
WITH o AS (SELECT idx, text, row_number() OVER (PARTITION BY text ORDER BY idx DESC) AS r FROM old_snap),
n AS (SELECT idx, text, row_number() OVER (PARTITION BY text ORDER BY idx) AS r FROM new_snap)
SELECT n.idx AS new_idx, o.idx AS old_idx FROM n JOIN o ON n.text = o.text AND n.r = o.r""")
def _(t):
    return diff.diff_exact(t.old_snap, t.new_snap).filter("status = 'unchanged'").select("new_idx", "old_idx")


@query("j14_subset_flags", """
SELECT idx, CASE WHEN contains(lower(text), 'tion') AND contains(lower(text), 'the') THEN 'both' WHEN contains(lower(text), 'tion') THEN 'only_a' ELSE 'only_b' END AS side
FROM passages WHERE contains(lower(text), 'tion') OR contains(lower(text), 'the')""")
def _(t):
    return diff.subset_overlap(t.passages, "tion", "the").select("idx", "side")


@query("j15_toc_mismatch", """
WITH d AS (SELECT source, count(*) AS declared FROM old_snap GROUP BY 1), a AS (SELECT source, count(*) AS actual FROM new_snap GROUP BY 1)
SELECT coalesce(d.source, a.source) AS source, coalesce(declared, 0) AS declared, coalesce(actual, 0) AS actual FROM d FULL JOIN a ON d.source = a.source
WHERE coalesce(declared, 0) <> coalesce(actual, 0)""")
def _(t):
    return joins.toc_mismatch(t.old_snap.groupBy("source").agg(F.count("*").alias("declared")), t.new_snap)


@query("j16_results_with_proposals", """
WITH cand AS (SELECT idx, cos FROM scored ORDER BY cos DESC, idx LIMIT 25),
k AS (SELECT event_id % 500 AS idx, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY 1)
SELECT c.idx, round(cos, 6) AS score, array_to_string(kinds, ',') AS kinds FROM cand c LEFT JOIN k ON c.idx = k.idx""")
def _(t):
    few = rt.best(t.vectors.select("idx", vx.cosine("v", t.query_vec).alias("score")), 25)
    proposals = t.events.select(F.expr("event_id % 500").alias("idx"), F.col("event_type").alias("kind"))
    return joins.with_proposals(few, proposals).select("idx", F.round("score", 6).alias("score"), F.array_join("kinds", ",").alias("kinds"))


# -- counts --------------------------------------------------------------------------------------------

query("a1_count_live", "SELECT count_if(NOT tombstone)::BIGINT AS live, count_if(tombstone)::BIGINT AS tombstoned, count(*) AS total FROM passages")(
    lambda t: cp.count_live(t.passages))
query("a2_source_status", "SELECT source, count(*) AS n, CASE WHEN count(*) < 48 THEN 'under-utilized' ELSE 'ok' END AS status FROM passages WHERE NOT tombstone GROUP BY 1")(
    lambda t: cp.source_status(filters.live(t.passages), 48))
query("a4_list_sources", "SELECT source, count(*) AS n, count_if(NOT tombstone)::BIGINT AS active FROM passages GROUP BY 1")(
    lambda t: cp.list_sources(t.passages))
query("a5_toc_from_hash", """
WITH g AS (SELECT source_hash, min(idx) AS f, count(*) AS n FROM block GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY f) AS position FROM g)
SELECT position, 'source #' || position || ' (hash ' || lpad(lower(hex(source_hash)), 8, '0') || ')' AS name, n FROM r""")(
    lambda t: cp.toc_from_hash(t.block))


@query("a14_governability", "SELECT CASE WHEN idx % 5 = 0 THEN 'from path' WHEN idx % 7 = 0 THEN 'no provenance' ELSE 'hash' END AS reason, count(*) AS n, count(*) FILTER (WHERE idx % 5 = 0 OR idx % 7 <> 0) AS keyed FROM block GROUP BY 1")
def _(t):
    from ..operators import access
    rows = t.block.select(F.expr("CASE WHEN idx % 5 <> 0 AND idx % 7 <> 0 THEN source_hash END").alias("source_hash"),
                          F.expr("CASE WHEN idx % 5 = 0 THEN source END").alias("source_path"),
                          F.lit(None).cast("int").alias("source_idx"), F.lit(True).alias("well_formed"))
    return cp.governability(access.with_document_key(rows))


query("a15_corpus_header", """
SELECT count(DISTINCT source) AS file_count, count(*) AS total_chunks, count_if(lang = 'fr')::BIGINT AS graphic_count, count_if(lang = 'de')::BIGINT AS table_count FROM passages""")(
    lambda t: cp.corpus_header(t.passages.withColumn("kind", F.expr("CASE lang WHEN 'fr' THEN 'graphic' WHEN 'de' THEN 'table' ELSE 'document' END"))))
query("a17_exception_map", "SELECT corpus_id, seat, source_hash, level FROM exceptions")(lambda t: cp.exception_map(t.exceptions))
query("a18_grant_counts", "SELECT c.corpus_id, c.name, count(g.grantee) AS grants FROM corpora c LEFT JOIN grants g ON c.corpus_id = g.corpus_id GROUP BY 1, 2")(
    lambda t: cp.grant_counts(t.corpora, t.grants))


@query("a19_constraint_violations", """
WITH u AS (SELECT o_orderkey AS corpus_id, o_custkey AS owner, floor(o_totalprice * 100) AS size_bytes, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders)
SELECT corpus_id, owner, nth > 1 AS second_corpus, size_bytes > 10485760 AS too_large FROM u WHERE nth > 1 OR size_bytes > 10485760""")
def _(t):
    return cp.constraint_violations(t.orders.select(F.col("o_orderkey").alias("corpus_id"), F.col("o_custkey").alias("owner"),
                                                    F.floor(F.col("o_totalprice") * 100).alias("size_bytes")))


query("a20_firm_level_view", "SELECT corpus_id, event_type, count(*) AS touches, count(DISTINCT seat) AS seats FROM activity WHERE seat IS NOT NULL GROUP BY 1, 2")(
    lambda t: cp.attention(t.activity, ["corpus_id", "event_type"]))
query("a21_apps_per_user", "SELECT seat, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS apps FROM activity WHERE seat IS NOT NULL GROUP BY 1")(
    lambda t: cp.apps_per_user(t.activity.filter("seat IS NOT NULL")).withColumn("apps", F.array_join("apps", ",")))
query("a22_provision_status", "SELECT seat AS user, arg_max(event_type, ts) AS outcome, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM activity WHERE seat IS NOT NULL GROUP BY 1")(
    lambda t: cp.provision_status(t.activity.filter("seat IS NOT NULL").select(F.col("seat").alias("user"), F.col("event_type").alias("outcome"), "ts", "event_id")
                                  ).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss")))

# -- windows ---------------------------------------------------------------------------------------------

query("w1_link_prev_next", """
SELECT idx, lag(idx) OVER (PARTITION BY source ORDER BY idx) AS prev_idx, lead(idx) OVER (PARTITION BY source ORDER BY idx) AS next_idx,
  lag(idx) OVER (ORDER BY idx) AS prev_linear FROM passages""")(
    lambda t: cp.link_prev_next(cp.link_prev_next(t.passages.select("idx", "source"), linear=True).select(
        "idx", "source", F.col("prev_idx").alias("prev_linear"))).select("idx", "prev_idx", "next_idx", "prev_linear"))
query("w2_chunk_labels", """
SELECT idx, CASE WHEN count(*) OVER (PARTITION BY source) > 1 THEN source || ' (part ' || row_number() OVER (PARTITION BY source ORDER BY idx) || '/'
  || count(*) OVER (PARTITION BY source) || ')' ELSE source END AS label FROM passages""")(
    lambda t: cp.chunk_labels(t.passages.select("idx", "source")).select("idx", "label"))


@query("w4_rank_results", """
WITH cand AS (SELECT idx, cos FROM scored ORDER BY cos DESC, idx LIMIT 25), k AS (SELECT c.* FROM cand c JOIN passages p ON c.idx = p.idx WHERE NOT tombstone)
SELECT row_number() OVER (ORDER BY cos DESC, idx)::INT AS rank, idx FROM k""")
def _(t):
    few = rt.best(t.vectors.select("idx", vx.cosine("v", t.query_vec).alias("score")), 25)
    return joins.rank_results(rt.with_passages(few, t.passages).select("idx", "score")).select("rank", "idx")


query("w5_latest_per_name", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY mtime DESC, suffix DESC, location DESC, size DESC) AS rn FROM files)
SELECT stem, suffix, location, size, mtime FROM r WHERE rn = 1""")(lambda t: cp.latest_per_name(t.files))
query("w6_keep_last_n", """
WITH r AS (SELECT corpus_id, event_id, row_number() OVER (PARTITION BY corpus_id ORDER BY ts DESC, event_id DESC) AS rn FROM activity)
SELECT corpus_id, event_id FROM r WHERE rn <= 500""")(lambda t: cp.keep_last(t.activity, 500).select("corpus_id", "event_id"))

# -- top-k and pages ---------------------------------------------------------------------------------------

query("t1_topk", "SELECT idx, round(cos, 6) AS score FROM scored ORDER BY cos DESC, idx LIMIT 15")(
    lambda t: rt.best(t.vectors.select("idx", vx.cosine("v", t.query_vec).alias("score")), 15).select("idx", F.round("score", 6).alias("score")))
query("t2_topk_per_group", """
WITH r AS (SELECT label, idx, cos, row_number() OVER (PARTITION BY label ORDER BY cos DESC, idx) AS rank FROM scored)
SELECT label, idx, round(cos, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")(
    lambda t: ranking.top_per_key(t.vectors.select("label", "idx", vx.cosine("v", t.query_vec).alias("score")), ["label"], 5,
                                  [F.desc("score"), F.asc("idx")], "idx").withColumn("score", F.round("score", 6)))
query("t3_page", "SELECT idx, source, (SELECT count(*) FROM passages) AS total FROM passages ORDER BY idx LIMIT 25 OFFSET 50")(
    lambda t: cp.page(t.passages.select("idx", "source"), 50, 25))
@query("t3b_stored_page", "SELECT idx, source, count(*) OVER () AS total FROM passages ORDER BY idx LIMIT 25 OFFSET (SELECT count(*) * 9 // 10 FROM passages)")
def _(t):
    """A page at nine tenths of a stored corpus, through its page index."""
    path = scratch_path(t.spark, "corpus")
    corpus_io.write_corpus(t.passages.select("idx", "source", F.lit("all").alias("corpus_id")), path)
    corpus_io.write_page_index(t.spark, path)
    return corpus_io.stored_page(t.spark, path, "all", t.passages.count() * 9 // 10, 25)


query("t4_source_page", "SELECT idx, tombstone, (SELECT count(*) FROM passages WHERE source = 'src5') AS total FROM passages WHERE source = 'src5' ORDER BY idx LIMIT 25 OFFSET 5")(
    lambda t: cp.source_page(t.passages.select("idx", "source", "tombstone"), "src5", 5, 25).drop("source"))


@query("t6_order_limit_offset", """
SELECT s.idx, round(cos, 6) AS relevance FROM scored s JOIN block b ON s.idx = b.idx ORDER BY cos DESC, ts_unix, s.idx LIMIT 10 OFFSET 3""")
def _(t):
    rt.relevance_view(t.block.select("idx", "ts_unix"), t.vectors, t.query_vec, "paged_corpus")
    return t.spark.sql("SELECT idx, round(relevance, 6) AS relevance FROM paged_corpus ORDER BY paged_corpus.relevance DESC, ts_unix, idx LIMIT 10 OFFSET 3")


# -- set operations ------------------------------------------------------------------------------------------

query("u1_subset_overlap", """
WITH f AS (SELECT contains(lower(text), 'eaux') OR contains(lower(source), 'eaux') AS a, contains(lower(text), 'src1') OR contains(lower(source), 'src1') AS b FROM passages)
SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' ELSE 'only_b' END AS side, count(*) AS n FROM f WHERE a OR b GROUP BY 1""")(
    lambda t: diff.subset_overlap(t.passages, "eaux", "src1").groupBy("side").agg(F.count("*").alias("n")))


@query("u2_union_primary_walk", """
WITH a AS (SELECT idx, cos FROM scored ORDER BY cos DESC, idx LIMIT 10), b AS (SELECT idx, ham FROM scored ORDER BY ham DESC, idx LIMIT 10)
SELECT idx, round(cos, 6) AS score, false AS from_walk FROM a UNION ALL SELECT idx, round(ham, 6), true FROM b""")
def _(t):
    both = t.vectors.select("idx", vx.similarity("v", t.query_vec).alias("s"))
    a = rt.best(both.select("idx", F.col("s.cosine").alias("score")), 10)
    b = rt.best(both.select("idx", F.col("s.hamming").alias("score")), 10)
    return diff.union_primary_walk(a, b).withColumn("score", F.round("score", 6))


query("u3_distinct_sources", "SELECT source, min(idx) AS first_idx FROM passages GROUP BY 1")(lambda t: cp.distinct_sources(t.passages))

EXACT = """o AS (SELECT idx, text, source, row_number() OVER (PARTITION BY text ORDER BY idx DESC) AS r FROM old_snap),
n AS (SELECT idx, text, source, row_number() OVER (PARTITION BY text ORDER BY idx) AS r FROM new_snap),
x AS (SELECT CASE WHEN o.idx IS NULL THEN 'added' WHEN n.idx IS NULL THEN 'removed' ELSE 'unchanged' END AS status, n.idx AS new_idx, o.idx AS old_idx,
  coalesce(n.source, o.source) AS source FROM n FULL JOIN o ON n.text = o.text AND n.r = o.r)"""
query("u4_diff_exact", f"WITH {EXACT} SELECT * FROM x")(lambda t: diff.diff_exact(t.old_snap, t.new_snap))


# Vectors of different documents are far below 0.92 in these tables, and a moved vector stays above
# it, so old and new rows of one document pair off in idx order. A brute-force test covers the rule.
SEMANTIC = """so AS (SELECT idx, text, source, row_number() OVER (PARTITION BY idx % 1000000000 ORDER BY idx) AS k FROM old_vec),
sn AS (SELECT idx, text, source, row_number() OVER (PARTITION BY idx % 1000000000 ORDER BY idx) AS k FROM new_vec),
sx AS (SELECT CASE WHEN so.idx IS NULL THEN 'added' WHEN sn.idx IS NULL THEN 'removed' WHEN so.text = sn.text THEN 'unchanged' ELSE 'modified' END AS status,
  sn.idx AS new_idx, so.idx AS old_idx, coalesce(sn.source, so.source) AS source FROM sn FULL JOIN so ON so.idx % 1000000000 = sn.idx % 1000000000 AND so.k = sn.k)"""


@query("u5_diff_semantic", f"WITH {SEMANTIC} SELECT * FROM sx")
def _(t):
    return diff.diff_semantic(t.old_vec, t.new_vec)


query("u6_diff_counts", f"WITH {EXACT} SELECT source, status, count(*) AS n FROM x GROUP BY 1, 2")(
    lambda t: diff.diff_counts(diff.diff_exact(t.old_snap, t.new_snap)))
query("u7_diff_notes", f"""WITH {EXACT}, c AS (SELECT count_if(status = 'added')::BIGINT AS added, count_if(status = 'removed')::BIGINT AS removed, 0::BIGINT AS modified,
  count_if(status = 'unchanged')::BIGINT AS unchanged FROM x)
SELECT *, unchanged + removed AS n_old, unchanged + added AS n_new, abs(added - removed) / greatest(unchanged + removed, unchanged + added) > 0.5 AS structural_note,
  unchanged / greatest(unchanged + removed, unchanged + added) >= 0.98 AS rebuild_note FROM c""")(
    lambda t: diff.diff_notes(diff.diff_totals(diff.diff_exact(t.old_snap, t.new_snap)), F.lit(False)))
