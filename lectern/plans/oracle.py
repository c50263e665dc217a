"""DuckDB twins of the fixture views, spliced into a query's SQL as needed."""
from __future__ import annotations

import re

VIEWS = {
    "passages": """SELECT doc_id AS idx, text, source, lang, doc_id % 17 = 0 AS tombstone FROM documents""",
    "vectors": """SELECT vec_id AS idx, embedding::DOUBLE[] AS v, label FROM embeddings
        WHERE vec_id IN (SELECT doc_id FROM documents)""",
    "corpus": """SELECT p.*, x.v, x.label FROM passages p JOIN vectors x ON p.idx = x.idx""",
    "query_vec": """SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7""",
    "scored": """SELECT idx, v, label,
        list_inner_product(v, q) / (sqrt(list_inner_product(q, q)) + 1e-9) / (sqrt(list_inner_product(v, v)) + 1e-9) AS cos,
        1.0 - len(list_filter(list_zip(v, q), lambda p: (p[1] > 0) <> (p[2] > 0))) / len(v)::DOUBLE AS ham
        FROM vectors, query_vec""",
    "block": """SELECT doc_id AS idx, source, text,
        (CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END
          + (doc_id % 3)::INT * 32)::INT AS flags,
        CASE doc_id % 11 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 3 END AS perms,
        (CASE WHEN doc_id % 4 = 0 THEN (doc_id % 7)::INT ELSE 0 END + CASE WHEN doc_id % 13 = 0 THEN 8 ELSE 0 END
          + CASE WHEN doc_id % 19 = 0 THEN 16 ELSE 0 END + CASE WHEN doc_id % 23 = 0 THEN 32 ELSE 0 END)::INT AS lifecycle,
        CASE WHEN doc_id % 29 = 0 THEN 0 ELSE 1700000000 + doc_id * 3600 END AS ts_unix,
        ('0x' || substr(md5(source), 1, 8))::UBIGINT::BIGINT AS source_hash FROM documents""",
    "signatures": """SELECT idx, v[1:32] AS signature FROM vectors""",
    "aux_scores": """SELECT idx, ((idx * 37) % 100) / 100.0::DOUBLE AS aux FROM vectors""",
    "tombstones": """SELECT idx FROM passages WHERE tombstone""",
    "old_snap": """SELECT doc_id AS idx, text, source FROM documents WHERE source <> 'src1'
        UNION ALL SELECT doc_id + 1000000000, text, source FROM documents WHERE source = 'src2'""",
    "new_snap": """SELECT doc_id AS idx, text || CASE WHEN lang = 'de' THEN ' rev' ELSE '' END AS text, source
        FROM documents WHERE source <> 'src0'
        UNION ALL SELECT doc_id + o, text, source FROM documents, (VALUES (1000000000), (2000000000)) t(o)
        WHERE source = 'src2'""",
    "old_vec": """SELECT s.idx, s.text, s.source, e.embedding::DOUBLE[] AS v
        FROM old_snap s JOIN embeddings e ON e.vec_id = s.idx % 1000000000""",
    "new_vec": """SELECT s.idx, s.text, s.source, CASE WHEN d.lang = 'de' AND s.idx < 1000000000
          THEN list_concat([e.embedding[1]::DOUBLE + 0.1], e.embedding[2:]::DOUBLE[]) ELSE e.embedding::DOUBLE[] END AS v
        FROM new_snap s JOIN embeddings e ON e.vec_id = s.idx % 1000000000
        JOIN documents d ON d.doc_id = s.idx % 1000000000""",
    "corpora": """SELECT n_nationkey::BIGINT AS corpus_id, 'seat-' || n_regionkey AS owner,
        'north-' || lower(n_name) AS name, n_nationkey % 2 = 0 AS inherit FROM nation""",
    "grants": """SELECT corpus_id, grantee, CASE r WHEN 1 THEN 'viewer' WHEN 2 THEN 'commenter' ELSE 'editor' END AS level
        FROM (SELECT c_nationkey::BIGINT AS corpus_id, 'seat-' || (c_custkey % 20) AS grantee, max(c_custkey % 4) AS r
              FROM customer WHERE c_custkey % 4 > 0 GROUP BY 1, 2)""",
    "exceptions": """SELECT corpus_id, source, ('0x' || substr(md5(source), 1, 8))::UBIGINT::BIGINT AS source_hash, seat,
        CASE m % 4 WHEN 0 THEN 'deny' WHEN 1 THEN 'viewer' WHEN 2 THEN 'commenter' ELSE 'editor' END AS level
        FROM (SELECT s_nationkey::BIGINT AS corpus_id, 'src' || (s_suppkey % 20) AS source,
                     'seat-' || (s_suppkey % 7) AS seat, max(s_suppkey) AS m FROM supplier GROUP BY 1, 2, 3)""",
    "exposures": """SELECT corpus_id, source, level, ('0x' || substr(md5(source), 1, 8))::UBIGINT::BIGINT AS source_hash
        FROM (SELECT n_nationkey::BIGINT AS corpus_id, 'src' || (n_nationkey % 20) AS source,
              CASE n_nationkey % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'commenter' ELSE 'editor' END AS level FROM nation)""",
    "files": """SELECT CASE WHEN location = 'sandbox' THEN substr(md5(p_partkey::VARCHAR), 1, 12) || '_' || name ELSE name END AS stem,
        CASE WHEN location = 'legacy' THEN '.pkl' ELSE '.npz' END AS suffix, location,
        p_partkey * 37 % 5000 AS size, 1700000000 + p_partkey * 60 AS mtime
        FROM (SELECT p_partkey, replace(lower(p_name), ' ', '-') || '-' || (p_size % 5) AS name,
              CASE p_partkey % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'sandbox' ELSE 'legacy' END AS location FROM part)""",
    "cells": """SELECT table_id, row, col::INT AS col, vals[col + 1] AS val FROM (
          SELECT o_custkey AS table_id, o_orderkey AS row, [o_orderkey::VARCHAR, format('{:,.2f}', o_totalprice), '',
            CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END,
            CASE WHEN o_orderstatus <> 'F' THEN 'to be settled' ELSE '' END, 'clerk'] AS vals FROM orders
          UNION ALL SELECT c_custkey, -2, ['ORDER', 'P R I C E', '', 'PRIO', '', 'CLERK'] FROM customer
          UNION ALL SELECT c_custkey, -1, ['Statement of ' || c_name || ' for 12 months', '', '', '', '', ''] FROM customer
        ), range(6) r(col)""",
    "activity": """SELECT event_id, ts, user_id % 10 AS corpus_id,
        CASE WHEN event_id % 25 = 0 THEN NULL ELSE 'u' || user_id END AS seat, event_type,
        floor(value * 10)::BIGINT AS units, props FROM events""",
    "invoice_base": """SELECT o.*, c.*, o_orderdate::DATE AS od FROM orders o JOIN customer c ON o_custkey = c_custkey""",
    "invoices": """SELECT o_orderkey AS idx, 'inv-' || c_nationkey || '-' || strftime(od, '%Y%m%d') || '.pdf' AS source,
        'Invoice ' || o_orderkey || ' from ' || c_name || ' dated ' || strftime(od, '%Y-%m-%d')
        || '. Total invoice: $' || format('{:,.2f}', o_totalprice)
        || '. Fuel surcharge: $' || (o_orderkey % 90 + 10) || '.' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '.'
        || CASE o_orderkey % 4
           WHEN 0 THEN ' Refund adjustment: ($' || (o_orderkey % 40 + 1) || '.50) for damaged goods.'
           WHEN 1 THEN ' Delivery date ' || strftime(od + INTERVAL 7 DAY, '%m/%d/%Y') || '.'
           WHEN 2 THEN ' Paid ' || (o_orderkey % 500 + 1) || '.25 EUR on ' || strftime(od, '%B %-d, %Y') || '.'
           ELSE '' END
        || chr(10) || 'Shipped to ' || upper(lower(c_mktsegment)[1]) || lower(c_mktsegment)[2:] || ' Goods under ' || o_orderpriority AS text,
        o_orderkey % 17 = 0 AS tombstone FROM invoice_base""",
    # extraction results of the composed invoices, known by construction
    "invoice_dates": """SELECT o_orderkey AS idx, od AS date, 1 AS pos, 'iso' AS source_format,
          strftime(od, '%Y-%m-%d') AS raw_span, 1.0::DOUBLE AS confidence FROM invoice_base
        UNION ALL SELECT o_orderkey, (od + INTERVAL 7 DAY)::DATE, 2, 'us_slash',
          strftime(od + INTERVAL 7 DAY, '%m/%d/%Y'), 0.9::DOUBLE FROM invoice_base WHERE o_orderkey % 4 = 1
        UNION ALL SELECT o_orderkey, od, 2, 'long', strftime(od, '%B %-d, %Y'), 0.95::DOUBLE FROM invoice_base
          WHERE o_orderkey % 4 = 2""",
    "invoice_money": """SELECT o_orderkey AS idx, o_totalprice::DECIMAL(18,4) AS value, 'USD' AS currency, 1 AS pos,
          false AS is_negative, 'invoice' AS hint, '$' || format('{:,.2f}', o_totalprice) AS raw_span FROM invoice_base
        UNION ALL SELECT o_orderkey, ((o_orderkey % 90 + 10) || '.' || lpad((o_orderkey % 100)::VARCHAR, 2, '0'))::DECIMAL(18,4),
          'USD', 2, false, 'surcharge', '$' || (o_orderkey % 90 + 10) || '.' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') FROM invoice_base
        UNION ALL SELECT o_orderkey, ((o_orderkey % 40 + 1) || '.50')::DECIMAL(18,4), 'USD', 3, true, 'adjustment',
          '($' || (o_orderkey % 40 + 1) || '.50)' FROM invoice_base WHERE o_orderkey % 4 = 0
        UNION ALL SELECT o_orderkey, ((o_orderkey % 500 + 1) || '.25')::DECIMAL(18,4), 'EUR', 3, false, 'paid',
          (o_orderkey % 500 + 1) || '.25 EUR' FROM invoice_base WHERE o_orderkey % 4 = 2""",
    "invoice_entities": """SELECT idx, entity FROM (SELECT o_orderkey AS idx, unnest(['Invoice', 'Customer', 'Total', 'Fuel',
          CASE o_orderkey % 4 WHEN 0 THEN 'Refund' WHEN 1 THEN 'Delivery' WHEN 2 THEN 'Paid' END,
          CASE WHEN o_orderkey % 4 = 2 THEN 'EUR' END,
          'Shipped', upper(lower(c_mktsegment)[1]) || lower(c_mktsegment)[2:] || ' Goods',
          CASE WHEN o_orderpriority LIKE '%NOT%' THEN NULL ELSE substr(o_orderpriority, 3) END]) AS entity
          FROM invoice_base) WHERE entity IS NOT NULL""",
}
_NAME = re.compile(r"\b(" + "|".join(sorted(VIEWS, key=len, reverse=True)) + r")\b")


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names, each after those it needs."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name not in ordered:
                need(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    need(sql)
    if not ordered:
        return sql
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
