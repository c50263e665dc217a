"""Every query of the package that has SQL against it on the smallest tables, and the schemas its contracts name."""
import duckdb
import pytest

from check import rows
from conftest import SMALL
from lectern.llm import queries

SQL = queries.all_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = queries.all_queries()[name](spark, SMALL)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


@pytest.mark.parametrize(("name", "columns"), [
    ("op11_prefix_trie", {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint",
                          "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"}),
    ("op12_overlap_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
    ("op13_centroid_clusters", {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint",
                                "centroid_sha256": "string"})])
def test_columns(spark, name, columns):
    assert dict(queries.all_queries()[name](spark, SMALL).dtypes) == columns
