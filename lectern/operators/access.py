"""Access: who may open a corpus, and which of its documents and passages a seat may read."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flags as fl
from ..functions import text as tx

DENY = "deny"


def mount_decision(corpora: DataFrame, grants: DataFrame, requests: DataFrame, enforced: bool = True) -> DataFrame:
    """(request_id, corpus_id, seat) -> allowed, reason and level; the first rule that fits decides."""
    best = best_grants(grants)
    r = requests.join(corpora.select("corpus_id", "owner", F.lit(True).alias("registered")), "corpus_id", "left").join(
        best, ["corpus_id", "seat"], "left")
    seat = F.coalesce("seat", F.lit(""))
    rules = [
        (F.lit(not enforced), True, "unenforced", None),
        (F.col("registered").isNull(), True, "unregistered", None),
        ((seat != "") & (seat == F.col("owner")), True, "owner", F.lit("owner")),
        (seat == "", False, "anonymous", None),
        (F.col("level").isNotNull(), True, "granted", F.col("level")),
    ]
    outcome = None
    for test, allowed, reason, level in rules:
        row = F.struct(F.lit(allowed).alias("allowed"), F.lit(reason).alias("reason"),
                       (F.lit(None).cast("string") if level is None else level).alias("level"))
        outcome = F.when(test, row) if outcome is None else outcome.when(test, row)
    refused = F.struct(F.lit(False).alias("allowed"), F.lit("no grant").alias("reason"), F.lit(None).cast("string").alias("level"))
    return r.select("request_id", "corpus_id", "seat", outcome.otherwise(refused).alias("d")).select(
        "request_id", "corpus_id", "seat", "d.*")


def best_grants(grants: DataFrame) -> DataFrame:
    """Highest level per (corpus, seat)."""
    rank = fl.access_rank(F.col("level"))
    return grants.groupBy("corpus_id", F.col("grantee").alias("seat")).agg(fl.level_of_rank(F.max(rank)).alias("level"))


def effective_access(corpora: DataFrame, grants: DataFrame, seat: str) -> DataFrame:
    """owner, granted level or null, per corpus."""
    mine = best_grants(grants).filter(F.col("seat") == seat).select("corpus_id", "level")
    return corpora.join(mine, "corpus_id", "left").select(
        "corpus_id", "name", F.when(F.col("owner") == seat, "owner").otherwise(F.col("level")).alias("access"))


def access_for_names(names: DataFrame, corpora: DataFrame, grants: DataFrame, seat: str | None) -> DataFrame:
    """Level by corpus name: ``unregistered`` differs from denied (null); best grant wins."""
    per_name = corpora.select("corpus_id", "name", "owner")
    mine = best_grants(grants).filter(F.col("seat") == seat).select("corpus_id", "level") if seat else None
    if mine is None:
        held = per_name.groupBy("name").agg(F.lit(None).cast("string").alias("access"))
    else:
        rank = F.greatest(F.when(F.col("owner") == seat, 4).otherwise(0), fl.access_rank(F.col("level")))
        best = per_name.join(mine, "corpus_id", "left").groupBy("name").agg(F.max(rank).alias("r"))
        held = best.select("name", fl.level_of_rank(F.nullif("r", F.lit(0))).alias("access"))
    known = held.withColumn("registered", F.lit(True))
    return names.filter(F.trim("name") != "").join(known, "name", "left").select(
        "name", F.when(F.col("registered").isNull(), "unregistered").otherwise(F.col("access")).alias("access"))


def visible_corpora(corpora: DataFrame, grants: DataFrame, seat: str) -> DataFrame:
    """Owned or granted corpora with what the seat may do."""
    seen = effective_access(corpora, grants, seat).filter("access IS NOT NULL")
    caps = [fl.can(F.col("access"), c).alias(f"can_{c}") for c in fl.CAPABILITIES["owner"]]
    return seen.select("corpus_id", "name", "access", *caps)


def resolve_object(rows: DataFrame) -> DataFrame:
    """Adds may_read, may_write, level and origin to rows carrying ``corpus_level``, ``inherit``,
    ``exposure``, ``exception``, ``perms`` and ``is_owner``.

    A seat's own exception beats ownership, ownership beats exposure, exposure beats the default
    of the corpus. Permission bits then bind everyone.
    """
    level, exposure, exception = F.col("corpus_level"), F.col("exposure"), F.col("exception")

    def answer(read, write, lvl, origin):
        return F.struct(read.alias("read"), write.alias("write"), lvl.cast("string").alias("level"), F.lit(origin).alias("origin"))

    no, none = F.lit(False), F.lit(None)
    exposed = (fl.access_rank(level) >= fl.access_rank(exposure)) & (fl.access_rank(exposure) > 0)
    may_inherit = level.isNull() | (fl.access_rank(level) > 0)
    decided = (
        F.when(exception == DENY, answer(no, no, none, "exception"))
        .when(exception.isNotNull(), answer(F.lit(True), fl.can(exception, "write"), exception, "exception"))
        .when(F.col("is_owner"), answer(F.lit(True), F.lit(True), F.lit("owner"), "owner"))
        .when(exposure.isNotNull() & exposed, answer(F.lit(True), fl.can(level, "write"), level, "explicit"))
        .when(exposure.isNotNull(), answer(no, no, none, "explicit"))
        .when(F.col("inherit"), answer(may_inherit, level.isNull() | fl.can(level, "write"), level, "inherited"))
        .otherwise(answer(no, no, none, "withheld")))
    read_bit = F.col("perms").isNull() | fl.has_bit(F.coalesce("perms", F.lit(0)), fl.PERM_R)
    write_bit = F.col("perms").isNull() | fl.has_bit(F.coalesce("perms", F.lit(0)), fl.PERM_W)
    out = rows.withColumn("_d", decided)
    return out.select(*rows.columns, (F.col("_d.read") & read_bit).alias("may_read"), (F.col("_d.write") & write_bit).alias("may_write"),
                      F.col("_d.level").alias("level"), F.col("_d.origin").alias("origin"))


def with_document_key(rows: DataFrame) -> DataFrame:
    """Adds ``document_key`` and the reason it has, or lacks, one."""
    reason = (F.when(~F.col("well_formed"), "malformed").when(F.col("source_hash").isNotNull(), "hash")
              .when(F.coalesce("source_path", F.lit("")) != "", "from path")
              .when(F.col("source_idx").isNotNull(), "malformed").otherwise("no provenance"))
    keyed = rows.withColumn("reason", reason)
    key = F.when(F.col("reason") == "hash", F.col("source_hash")).when(
        F.col("reason") == "from path", tx.source_hash(F.col("source_path")))
    return keyed.withColumn("document_key", key)


def seat_view(passages: DataFrame, corpora: DataFrame, grants: DataFrame, exceptions: DataFrame, exposures: DataFrame,
              seat: str) -> DataFrame:
    """Passages (corpus_id, source_hash, perms, ...) with the seat's decision on each.

    Corpora, grants of one seat and exposures are per corpus or document, joined before the
    passages' own columns are read; adaptive execution broadcasts them when they are small.
    """
    access = effective_access(corpora, grants, seat).join(corpora.select("corpus_id", "inherit"), "corpus_id")
    rules = exceptions.filter(F.col("seat") == seat).select("corpus_id", "source_hash", F.col("level").alias("exception"))
    shown = exposures.select("corpus_id", "source_hash", F.col("level").alias("exposure"))
    rows = (passages.join(access.select("corpus_id", "inherit", F.col("access").alias("corpus_level")), "corpus_id", "left")
            .join(rules, ["corpus_id", "source_hash"], "left").join(shown, ["corpus_id", "source_hash"], "left"))
    rows = rows.withColumn("inherit", F.coalesce("inherit", F.lit(True))).withColumn(
        "is_owner", F.coalesce(F.col("corpus_level") == "owner", F.lit(False)))
    return resolve_object(rows)


def readable_for(passages: DataFrame, corpora: DataFrame, grants: DataFrame, exceptions: DataFrame, exposures: DataFrame,
                 seat: str) -> DataFrame:
    """What the seat may read. Search over this, so that a cut to k is a cut of readable rows."""
    legacy = F.when(F.coalesce("perms", F.lit(0)) == 0, F.lit(fl.LEGACY_PERMS)).otherwise(F.col("perms"))
    seen = seat_view(passages.withColumn("perms", legacy), corpora, grants, exceptions, exposures, seat)
    return seen.filter("may_read").select(*passages.columns)


def secure_search(vectors: DataFrame, query, readable: DataFrame, k: int = 10) -> DataFrame:
    """Top k among readable passages: the filter comes before the cut."""
    from ..functions import vectors as vx
    from . import joins
    from .retrieval import best
    allowed = vectors.join(readable.select("idx"), "idx", "left_semi")
    return joins.rank_results(best(allowed.select("idx", vx.cosine("v", query).alias("score")), k))


def mark_grandfathered(decisions: DataFrame) -> DataFrame:
    """Inherited readable answers on a corpus that has since become explicit."""
    return decisions.withColumn("grandfathered", F.col("explicit_now") & (F.col("origin") == "inherited") & F.col("may_read"))


def sidecar_level(payload: Column) -> Column:
    """Level from a permission file: none at all is editor; a known ``access_level``; else an old
    r / rw / rwx string; anything else is viewer."""
    obj = F.from_json(payload, "access_level string, default string")
    level = F.lower(F.trim(obj["access_level"]))
    old = F.lower(F.trim(obj["default"]))
    mapped = F.when(old == "r", "viewer").when(old.isin("rw", "rwx"), "editor")
    return (F.when(payload.isNull(), "editor").when(level.isin("viewer", "commenter", "editor"), level)
            .otherwise(F.coalesce(mapped, F.lit("viewer"))))


def mirror_grants(corpora: DataFrame, grants: DataFrame, old_prefix: str, new_prefix: str) -> DataFrame:
    """Grants to add so that each mirrored corpus carries those of its original; same owner and
    renamed, and only where absent."""
    old = corpora.filter(F.startswith("name", F.lit(old_prefix))).select(
        "corpus_id", F.replace("name", F.lit(old_prefix), F.lit(new_prefix)).alias("new_name"), "owner")
    new = corpora.select(F.col("corpus_id").alias("new_id"), F.col("name").alias("new_name"), "owner")
    wanted = grants.join(old, "corpus_id").join(new, ["new_name", "owner"]).select(
        F.col("new_id").alias("corpus_id"), "grantee", "level")
    return wanted.dropDuplicates(["corpus_id", "grantee"]).join(grants.select("corpus_id", "grantee"), ["corpus_id", "grantee"], "left_anti")


def mirror_check(corpora: DataFrame, grants: DataFrame, old_prefix: str, new_prefix: str) -> DataFrame:
    """Grant counts of each original and its mirror."""
    counts = grants.groupBy("corpus_id").agg(F.count("*").alias("n"))
    counted = corpora.join(counts, "corpus_id", "left").select("name", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    old = counted.filter(F.startswith("name", F.lit(old_prefix))).select(
        F.col("name").alias("original"), F.col("n").alias("grants_before"),
        F.replace("name", F.lit(old_prefix), F.lit(new_prefix)).alias("mirrored"))
    new = counted.select(F.col("name").alias("mirrored"), F.col("n").alias("grants_after"))
    return old.join(new, "mirrored", "left")
