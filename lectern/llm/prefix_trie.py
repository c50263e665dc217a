"""Prefix trie of conversations by bursting containers.

A conversation is the sequence of the 120-bit ids of its turns. It is cut into suffixes of at most ``span`` turns; a suffix lies in
the container of its trie head, the prefix before it, known by a hash. A container of more than ``most`` suffixes bursts: its
head becomes a node and its suffixes move on to one container per next turn id. ``span`` bounds the rounds of bursting, so a
conversation, or a group of equal ones, may be of any size. The containers that are left go to shards by head, are sorted by turn
ids and swept into nodes.

A node is named by its smallest member and its depth. The nodes that a conversation is the smallest member of are the tail of
its path, from some depth ``o`` on, so sums over subtrees are sums over members and need no walk: a member saves
the bytes of its turns from the node's depth to below ``o``, is one leaf if it is the smallest member of one, and one child if it
is the smallest member of a node right below.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import in_order
from ..session import materialize

#: Turns of a suffix, suffixes of a container, conversations that share a head, and how many lengths a head may have.
SPAN, MOST, GROUP, LENGTHS = 8, 4096, 5, 9


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, a, b, bytes of every turn with a conv_id: ``a`` and ``b`` are the id of its role and text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    code = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), code.alias("code"), F.octet_length(text).cast("long").alias("bytes")).select(
        "conv_id", "turn", *[F.conv(F.substring("code", at, 15), 16, 10).cast("long").alias(n) for n, at in (("a", 1), ("b", 16))], "bytes")


def rebuilt(turns: DataFrame, group: int = GROUP, lengths: int = LENGTHS) -> DataFrame:
    """conv_id, depth, a, b, bytes: conversations whose first turns are those of the first one of their group.

    One row of every conversation has a null depth and marks that it is there, turns or none.
    """
    placed = in_order(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], "pos")
    numbered = materialize(placed.select("conv_id", "pos", "a", "b", "bytes", (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
                                         F.crc32(F.col("conv_id").cast("string").cast("binary")).alias("c")).withColumn(
        "h", F.col("c") % lengths), "turns")
    own = F.col("conv_id") == F.col("base")
    heads = numbered.filter(own & (F.col("pos") < lengths)).groupBy("base").agg(
        F.array_sort(F.collect_list(F.struct("pos", "a", "b", "bytes"))).alias("head"))
    others = numbered.filter(~own & (F.col("pos") == 1)).select("conv_id", "base", "h").join(heads, "base", "left").select(
        "conv_id", F.expr("slice(coalesce(head, array()), 1, cast(h AS int))").alias("head"))
    columns = ["conv_id", "depth", "a", "b", "bytes"]
    copied = others.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.a", "t.b", "t.bytes")
    after = numbered.filter(~own & (F.col("pos") > F.col("h"))).join(others.select("conv_id", F.size("head").alias("m")), "conv_id").select(
        "conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("depth"), "a", "b", "bytes")
    first = numbered.filter(own).withColumnRenamed("pos", "depth").select(*columns)
    there = numbered.filter("pos = 1").select("conv_id", *[F.lit(None).cast("long").alias(c) for c in columns[1:]])
    return first.unionByName(copied).unionByName(after).unionByName(there)


def suffixes(rows: DataFrame, span: int) -> DataFrame:
    """conv_id, k, n, a, b, bytes, before, g, f: turns ``k`` x ``span`` + 1 and on of every conversation, fewer than ``span`` in the
    last suffix, which may be empty; the bytes before them; and the hash of the prefix that is their head."""
    full = rows.filter(F.col("depth") % span == 0).select("conv_id", F.expr(f"depth DIV {span}").alias("k"), F.lit(None).cast(
        "struct<depth:bigint,a:bigint,b:bigint,bytes:bigint>").alias("t"))   # what follows a full suffix, be it empty
    parts = rows.select("conv_id", F.coalesce(F.expr(f"(depth - 1) DIV {span}"), F.lit(0)).alias("k"),
                        F.when(F.col("depth").isNotNull(), F.struct("depth", "a", "b", "bytes")).alias("t")).unionByName(full).groupBy(
        "conv_id", "k").agg(F.array_sort(F.collect_list("t")).alias("t")).select(
        "conv_id", "k", F.size("t").alias("n"), *[F.col(f"t.{c}").alias(c) for c in ("a", "b", "bytes")])
    cut = materialize(parts, "suffixes")
    several = (F.col("k") > 0) | (F.col("n") == span)
    hashed = cut.filter(several).select("*", F.aggregate("bytes", F.lit(0).cast("long"), lambda x, y: x + y).alias("_s"),
                                        F.xxhash64("k", "a", "b").alias("_g"), F.xxhash64(F.lit(7), "k", "a", "b").alias("_f"))
    many = in_order(hashed, ["conv_id"], [F.col("k")], "_pos", {"_upto": "_s"}, {"_xg": "_g", "_xf": "_f"}).select(
        *cut.columns, (F.col("_upto") - F.col("_s")).alias("before"), F.col("_xg").bitwiseXOR(F.col("_g")).alias("g"),
        F.col("_xf").bitwiseXOR(F.col("_f")).alias("f"))
    zero = F.lit(0).cast("long")
    return cut.filter(~several).select("*", zero.alias("before"), zero.alias("g"), zero.alias("f")).unionByName(many)


def _burst(rows: DataFrame, span: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Suffixes in containers of at most ``most``, ``t`` turns below where they begin, with ``owners``, the smallest members of the
    nodes passed; and the suffixes that ended on the way, with ``leaf``."""
    rest = rows.withColumn("t", F.lit(0)).withColumn("owners", F.array().cast("array<bigint>"))
    placed, ended = [], []
    for t in range(span + 1):
        big = materialize(rest.groupBy("g", "f").agg(F.count("*").alias("_n"), F.min("conv_id").alias("owner"), F.max("n").alias("reach"))
                          .filter(F.col("_n") > most).drop("_n"), "burst")
        if big.isEmpty():
            break
        placed.append(rest.join(big, ["g", "f"], "left_anti"))
        hit = rest.join(big, ["g", "f"]).withColumn("owners", F.concat("owners", F.array("owner")))
        ended.append(hit.filter(F.col("n") == t).withColumn(
            "leaf", (F.col("n") < span) & (F.col("owner") == F.col("conv_id")) & (F.col("reach") == t)))
        turn = [F.get("a", F.lit(t)), F.get("b", F.lit(t))]
        moved = hit.filter(F.col("n") > t).select(
            *[c for c in rest.columns if c not in ("g", "f", "t")], F.lit(t + 1).alias("t"),
            F.xxhash64("g", "f", *turn).alias("g"), F.xxhash64(F.lit(7), "g", "f", *turn).alias("f"))
        rest = materialize(moved, "burst-suffixes")
    placed.append(rest)
    whole = placed[0]
    for more in placed[1:]:
        whole = whole.unionByName(more)
    columns = ["conv_id", "k", "n", "bytes", "before", "owners", "leaf"]
    out = whole.limit(0).withColumn("leaf", F.lit(False)).select(*columns) if not ended else ended[0].select(*columns)
    for more in ended[1:]:
        out = out.unionByName(more.select(*columns))
    return whole, out


_SWEPT = "conv_id long, k long, n int, bytes array<long>, before long, owners array<long>, leaf boolean"


def _sweep(table: pa.Table, span: int) -> pa.RecordBatch:
    """Nodes of whole containers: rows sorted by container and turn ids; a node is a run of equal ids so far."""
    rows = table.num_rows
    g, f, conv, n, t = (table.column(c).to_numpy() for c in ("g", "f", "conv_id", "n", "t"))
    ids = np.full((rows, span), -1, np.int64)
    a, b = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("a", "b"))
    row = np.repeat(np.arange(rows), n)
    place = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    if len(a):
        by = np.lexsort((b, a))
        new = np.concatenate([[True], (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])])
        dense = np.empty(len(a), np.int64)
        dense[by] = np.cumsum(new) - 1
        ids[row, place] = dense
    order = np.lexsort((*[ids[:, j] for j in reversed(range(span))], f, g))
    g, f, conv, n, t, ids = (x[order] for x in (g, f, conv, n, t, ids))
    owners = np.full((rows, span + 1), -1, np.int64)
    passed = table.column("owners").combine_chunks().take(pa.array(order))
    owners[np.repeat(np.arange(rows), t), np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)] = passed.flatten().to_numpy()
    leaf = np.zeros(rows, bool)
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (f[1:] != f[:-1])])
    for j in range(span + 1):
        if j:
            new[1:] |= ids[1:, j - 1] != ids[:-1, j - 1]
        begins, run = np.flatnonzero(new), np.cumsum(new) - 1
        least, reach = np.minimum.reduceat(conv, begins)[run], np.maximum.reduceat(n, begins)[run]
        here = t <= j
        owners[here, j] = least[here]
        leaf |= here & (n == j) & (n < span) & (least == conv) & (reach == j)
    sizes = n.astype(np.int64) + 1
    flat = owners[np.arange(span + 1)[None, :] < sizes[:, None]]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
    taken = {c: table.column(c).combine_chunks().take(pa.array(order)) for c in ("conv_id", "k", "n", "bytes", "before")}
    return pa.RecordBatch.from_arrays([*taken.values(), lists, pa.array(leaf)], [*taken, "owners", "leaf"])


def _nodes_of(containers: DataFrame, span: int) -> DataFrame:
    def work(batches):
        held: list[pa.RecordBatch] = []

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            g, f = batch.column("g").to_numpy(), batch.column("f").to_numpy()
            other = np.flatnonzero((g != g[-1]) | (f != f[-1]))
            begin = int(other[-1]) + 1 if len(other) else 0    # where the last container of the batch begins
            if not begin and (len(held) == 1 or (held[-2].column("g")[-1].as_py(), held[-2].column("f")[-1].as_py()) == (g[0], f[0])):
                continue
            whole = pa.Table.from_batches([*held[:-1], batch.slice(0, begin)])
            held = [batch.slice(begin)]
            if whole.num_rows:
                yield _sweep(whole, span)
        if held:
            yield _sweep(pa.Table.from_batches(held), span)

    shards = containers.select("conv_id", "k", "n", "a", "b", "bytes", "before", "t", "owners", "g", "f").repartition("g", "f")
    return shards.sortWithinPartitions("g", "f").mapInArrow(work, _SWEPT)


def _summed(column: str, length: Column) -> Column:
    return F.aggregate(F.slice(column, F.lit(1), length), F.lit(0).cast("long"), lambda x, y: x + y)


def _members(swept: DataFrame, span: int) -> DataFrame:
    """Every suffix with what its conversation has as a whole: ``o``, the bytes before it, its length, and whether it is the smallest
    member of a leaf."""
    off = (F.array_position("owners", F.col("conv_id")) - 1).cast("int")
    # a suffix that begins at a node named by its conversation follows one that ends there
    owned = (F.col("off") > 0) | ((F.col("off") == 0) & (F.col("k") == 0))
    marked = swept.withColumn("off", off).withColumn("o", F.when(owned, F.col("k") * span + F.col("off"))).withColumn(
        "o_bytes", F.when(owned, F.col("before") + _summed("bytes", F.greatest(F.col("off") - 1, F.lit(0))))).withColumn(
        "all_bytes", F.col("before") + _summed("bytes", F.col("n"))).withColumn("len", F.col("k") * span + F.col("n"))
    several = (F.col("k") > 0) | (F.col("n") == span)
    whole = marked.filter(several).groupBy("conv_id").agg(
        F.min("o").alias("o"), F.min("o_bytes").alias("o_bytes"), F.max("all_bytes").alias("all_bytes"), F.max("len").alias("len"),
        F.bool_or("leaf").alias("leaf"))
    parts = marked.filter(several).drop("o", "o_bytes", "all_bytes", "len", "leaf").join(whole, "conv_id")
    return marked.filter(~several).unionByName(parts).withColumn("o", F.coalesce("o", F.col("len") + 1)).withColumn(
        "o_bytes", F.coalesce("o_bytes", "all_bytes"))


def _digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 of nodes where conversations end. The members of a node, in order, lie over sorted ranges that join
    their ids; the digest of a node, serial by nature, streams over these strings."""
    def join(batches):
        for batch in batches:
            owner, depth, conv = (batch.column(c).to_numpy() for c in ("owner", "depth", "conv_id"))
            cut = [0, *(np.flatnonzero((owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])) + 1).tolist(), len(owner)]
            yield pa.RecordBatch.from_arrays([pa.array(owner[cut[:-1]]), pa.array(depth[cut[:-1]]), pa.array(conv[cut[:-1]]), pa.array(
                [",".join(map(str, conv[x:y].tolist())) for x, y in zip(cut, cut[1:])], pa.string())], ["owner", "depth", "first", "ids"])

    def digest(batches):
        at, state = None, None
        fields = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids"))):
                if (owner, depth) == at:
                    state.update(b",")
                else:
                    if at:
                        out.append((*at, state.hexdigest()))
                    at, state = (owner, depth), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(fields.names, o)) for o in out], fields)
        if at:
            yield pa.RecordBatch.from_pylist([dict(zip(fields.names, (*at, state.hexdigest())))], fields)

    by = ["owner", "depth", "conv_id"]
    joined = ends.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(join, "owner long, depth long, first long, ids string")
    return joined.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(
        digest, "owner long, depth long, ends_sha256 string")


def trie(rows: DataFrame, span: int = SPAN, most: int = MOST) -> DataFrame:
    """A row per node of the trie over ``rows`` (conv_id, depth, a, b, bytes as ``rebuilt`` gives them), as ``prefix_trie`` says."""
    if span < 2:
        raise ValueError("a suffix holds at least two turns")
    containers, ended = _burst(materialize(suffixes(rows, span), "suffix-heads"), span, most)
    columns = ["conv_id", "k", "n", "bytes", "before", "owners", "leaf"]
    swept = materialize(_nodes_of(containers, span).select(*columns).unionByName(ended.select(*columns)), "swept")
    members = _members(swept, span).select("*", F.posexplode("owners").alias("j", "owner")).filter("j > 0 OR k = 0").select(
        "owner", (F.col("k") * span + F.col("j")).alias("depth"), F.get("owners", F.col("j") - 1).alias("parent"), "o", "o_bytes", "len", "leaf",
        (F.col("before") + _summed("bytes", F.greatest(F.col("j") - 1, F.lit(0)))).alias("above"))
    nodes = members.groupBy("owner", "depth").agg(
        F.min("parent").alias("parent"), F.count("*").alias("n_convs"),
        F.sum(((F.col("o") <= F.col("depth") + 1) & (F.col("depth") < F.col("len"))).cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.when(F.col("depth") < F.col("o"), F.col("o_bytes") - F.col("above")).otherwise(0)).alias("saved_tokens"))
    ends = swept.filter(F.col("n") < span).select(F.get("owners", F.col("n")).alias("owner"), (F.col("k") * span + F.col("n")).alias("depth"), "conv_id")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(_digests(ends), ["owner", "depth"], "left").select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, span: int = SPAN, most: int = MOST) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie over the
    rebuilt conversations of a table (conv_id, turn, role, text).

    Turns are ordered by ``turn``, null first, and those of one number by the md5 of role and text, so equal rows are turns of
    their own in any order. A null role or text counts as empty. Rows without a conv_id take no part. An empty table has no nodes,
    the root among them; otherwise the root is named by the smallest conversation. Texts are read once and leave
    the scan as ids and lengths. Other columns are not read. Tables of ids are written below ``spark.checkpoint.dir`` when
    this is called.
    """
    return trie(rebuilt(materialize(turn_ids(conversations), "turn-ids")), span, most)
