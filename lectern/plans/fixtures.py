"""Views over the given tables, shaped as the operators' inputs.

Each view has a DuckDB twin of the same name in ``oracle.py``. Attributes the tables lack (flag
bytes, seats, grants) are computed from their keys, for every row.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERY_IDX = 7
SHARE_BYTES = 16 << 20     # of the files: a task that counts distinct pairs of words holds most of those in its share
KEYWORDS = ("tion", "ering", "xylograph")


class Tables:
    """The given tables of one scale factor, and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            self.__dict__[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return self.__dict__[name]
        raise AttributeError(name)

    # -- passages and vectors ------------------------------------------------------------------

    @cached_property
    def passages(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("idx"), "text", "source", "lang",
            F.expr("doc_id % 17 = 0").alias("tombstone"))

    @cached_property
    def wide_passages(self) -> DataFrame:
        """The passages spread over all cores, for work on whole texts."""
        return spread(self.documents).select(
            F.col("doc_id").alias("idx"), "text", "source", "lang", F.expr("doc_id % 17 = 0").alias("tombstone"))

    @cached_property
    def dealt_passages(self) -> DataFrame:
        """The passages in shares of bounded size, for counts of what nearly every text has of its own."""
        return spread(self.documents.select("doc_id", "text"), SHARE_BYTES).select(F.col("doc_id").alias("idx"), "text")

    @cached_property
    def vectors(self) -> DataFrame:
        known = self.documents.select(F.col("doc_id").alias("idx"))
        return self.embeddings.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("v"), "label").join(
            known, "idx", "left_semi")

    @cached_property
    def corpus(self) -> DataFrame:
        return self.passages.join(self.vectors, "idx")

    @property
    def query_vec(self):
        return self.embeddings.filter(F.col("vec_id") == QUERY_IDX).select(F.col("embedding").alias("v")).scalar()

    @cached_property
    def block(self) -> DataFrame:
        """Flag, permission and lifecycle bytes, time and source hash of each passage."""
        from ..functions.text import source_hash
        return self.documents.select(
            F.col("doc_id").alias("idx"), "source", "text",
            F.expr("CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END "
                   "+ CAST(doc_id % 3 AS INT) * 32").alias("flags"),
            F.expr("CASE doc_id % 11 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 3 END").alias("perms"),
            F.expr("CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 7 AS INT) ELSE 0 END "
                   "+ CASE WHEN doc_id % 13 = 0 THEN 8 ELSE 0 END + CASE WHEN doc_id % 19 = 0 THEN 16 ELSE 0 END "
                   "+ CASE WHEN doc_id % 23 = 0 THEN 32 ELSE 0 END").alias("lifecycle"),
            F.expr("CASE WHEN doc_id % 29 = 0 THEN 0 ELSE 1700000000 + doc_id * 3600 END").alias("ts_unix"),
            source_hash(F.col("source")).alias("source_hash"))

    @cached_property
    def signatures(self) -> DataFrame:
        return self.vectors.select("idx", F.slice("v", 1, 32).alias("signature"))

    @cached_property
    def aux_scores(self) -> DataFrame:
        return self.vectors.select("idx", F.expr("((idx * 37) % 100) / 100.0D").alias("aux"))

    @cached_property
    def tombstones(self) -> DataFrame:
        return self.passages.filter("tombstone").select("idx")

    # -- snapshots -------------------------------------------------------------------------------

    @cached_property
    def old_snap(self) -> DataFrame:
        base = self.documents.filter("source <> 'src1'").select(F.col("doc_id").alias("idx"), "text", "source")
        again = self.documents.filter("source = 'src2'").select(
            F.expr("doc_id + 1000000000").alias("idx"), "text", "source")
        return base.unionByName(again)

    @cached_property
    def new_snap(self) -> DataFrame:
        base = self.documents.filter("source <> 'src0'").select(
            F.col("doc_id").alias("idx"),
            F.expr("concat(text, CASE WHEN lang = 'de' THEN ' rev' ELSE '' END)").alias("text"), "source")
        again = self.documents.filter("source = 'src2'").select(
            F.explode(F.array(F.lit(1000000000), F.lit(2000000000))).alias("off"), "doc_id", "text", "source")
        return base.unionByName(again.select(F.expr("doc_id + off").alias("idx"), "text", "source"))

    def _with_vectors(self, snap: DataFrame, moved: bool) -> DataFrame:
        v = self.embeddings.select(F.expr("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
        lang = self.documents.select("doc_id", "lang")
        joined = snap.withColumn("doc_id", F.expr("idx % 1000000000")).join(v, "doc_id").join(lang, "doc_id")
        shifted = F.concat(F.array(F.col("v")[0] + F.lit(0.1)), F.slice("v", 2, 63))
        value = F.when((F.col("lang") == "de") & (F.col("idx") < 1000000000), shifted).otherwise(F.col("v")) if moved else F.col("v")
        return joined.select("idx", "text", "source", value.alias("v"))

    @cached_property
    def old_vec(self) -> DataFrame:
        return self._with_vectors(self.old_snap, False)

    @cached_property
    def new_vec(self) -> DataFrame:
        return self._with_vectors(self.new_snap, True)

    # -- access ----------------------------------------------------------------------------------

    @cached_property
    def corpora(self) -> DataFrame:
        return self.nation.select(
            F.col("n_nationkey").cast("bigint").alias("corpus_id"),
            F.expr("concat('seat-', n_regionkey)").alias("owner"),
            F.expr("concat('north-', lower(n_name))").alias("name"),
            F.expr("n_nationkey % 2 = 0").alias("inherit"))

    @cached_property
    def grants(self) -> DataFrame:
        rows = self.customer.filter("c_custkey % 4 > 0").groupBy(
            F.col("c_nationkey").cast("bigint").alias("corpus_id"),
            F.expr("concat('seat-', c_custkey % 20)").alias("grantee")).agg(
            F.max(F.expr("CAST(c_custkey % 4 AS INT)")).alias("level_rank"))
        return rows.select("corpus_id", "grantee", F.expr(
            "CASE level_rank WHEN 1 THEN 'viewer' WHEN 2 THEN 'commenter' ELSE 'editor' END").alias("level"))

    @cached_property
    def exceptions(self) -> DataFrame:
        from ..functions.text import source_hash
        return self.supplier.groupBy(
            F.col("s_nationkey").cast("bigint").alias("corpus_id"),
            F.expr("concat('src', s_suppkey % 20)").alias("source"),
            F.expr("concat('seat-', s_suppkey % 7)").alias("seat")).agg(F.max("s_suppkey").alias("last")).select(
            "corpus_id", "source", source_hash(F.col("source")).alias("source_hash"), "seat",
            F.expr("CASE last % 4 WHEN 0 THEN 'deny' WHEN 1 THEN 'viewer' WHEN 2 THEN 'commenter' ELSE 'editor' END"
                   ).alias("level"))

    @cached_property
    def exposures(self) -> DataFrame:
        from ..functions.text import source_hash
        rows = self.nation.select(F.col("n_nationkey").cast("bigint").alias("corpus_id"),
                                  F.expr("concat('src', n_nationkey % 20)").alias("source"),
                                  F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'commenter' "
                                         "ELSE 'editor' END").alias("level"))
        return rows.withColumn("source_hash", source_hash(F.col("source")))

    # -- files, cells, activity --------------------------------------------------------------------

    @cached_property
    def files(self) -> DataFrame:
        named = self.part.select(
            "p_partkey", F.expr("concat(replace(lower(p_name), ' ', '-'), '-', p_size % 5)").alias("name"),
            F.expr("CASE p_partkey % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'sandbox' ELSE 'legacy' END").alias("location"))
        return named.select(
            F.expr("CASE WHEN location = 'sandbox' THEN concat(substr(md5(cast(cast(p_partkey AS STRING) AS BINARY)), 1, 12), '_', name) "
                   "ELSE name END").alias("stem"),
            F.expr("CASE WHEN location = 'legacy' THEN '.pkl' ELSE '.npz' END").alias("suffix"), "location",
            F.expr("p_partkey * 37 % 5000").alias("size"), F.expr("1700000000 + p_partkey * 60").alias("mtime"))

    @cached_property
    def cells(self) -> DataFrame:
        order = "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"
        data = self.orders.select(
            F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("row"),
            F.posexplode(F.expr(
                "array(cast(o_orderkey AS STRING), format_number(o_totalprice, 2), '', "
                "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END, "
                "CASE WHEN o_orderstatus <> 'F' THEN 'to be settled' ELSE '' END, 'clerk')")).alias("col", "val"))
        head = self.customer.select(
            F.col("c_custkey").alias("table_id"), F.lit(-2).cast("bigint").alias("row"),
            F.posexplode(F.expr("array('ORDER', 'P R I C E', '', 'PRIO', '', 'CLERK')")).alias("col", "val"))
        prose = self.customer.select(
            F.col("c_custkey").alias("table_id"), F.lit(-1).cast("bigint").alias("row"),
            F.posexplode(F.expr("array(concat('Statement of ', c_name, ' for 12 months'), '', '', '', '', '')")
                         ).alias("col", "val"))
        return data.unionByName(head).unionByName(prose)

    @cached_property
    def activity(self) -> DataFrame:
        return activity_view(self.events)

    @cached_property
    def invoices(self) -> DataFrame:
        joined = spread(self.orders).join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        day = "date_format(o_orderdate, 'yyyy-MM-dd')"
        text = (
            f"concat('Invoice ', o_orderkey, ' from ', c_name, ' dated ', {day}, "
            "'. Total invoice: $', format_number(o_totalprice, 2), "
            "'. Fuel surcharge: $', o_orderkey % 90 + 10, '.', lpad(cast(o_orderkey % 100 AS string), 2, '0'), '.', "
            "CASE o_orderkey % 4 "
            "WHEN 0 THEN concat(' Refund adjustment: ($', o_orderkey % 40 + 1, '.50) for damaged goods.') "
            "WHEN 1 THEN concat(' Delivery date ', date_format(date_add(cast(o_orderdate AS date), 7), 'MM/dd/yyyy'), '.') "
            "WHEN 2 THEN concat(' Paid ', o_orderkey % 500 + 1, '.25 EUR on ', date_format(o_orderdate, 'MMMM d, yyyy'), '.') "
            "ELSE '' END, "
            "chr(10), 'Shipped to ', initcap(lower(c_mktsegment)), ' Goods under ', o_orderpriority)")
        return joined.select(
            F.col("o_orderkey").alias("idx"),
            F.expr("concat('inv-', c_nationkey, '-', date_format(o_orderdate, 'yyyyMMdd'), '.pdf')").alias("source"),
            F.expr(text).alias("text"), F.expr("o_orderkey % 17 = 0").alias("tombstone"))


def activity_view(events: DataFrame) -> DataFrame:
    """Events as corpus activity; works on a stream as well."""
    return events.select(
        "event_id", "ts", F.expr("user_id % 10").alias("corpus_id"),
        F.expr("CASE WHEN event_id % 25 = 0 THEN NULL ELSE concat('u', user_id) END").alias("seat"),
        "event_type", F.expr("CAST(floor(value * 10) AS BIGINT)").alias("units"), "props")
