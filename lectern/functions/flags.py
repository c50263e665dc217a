"""Bit fields of a passage: flags, permissions, lifecycle; and access levels."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the flags byte.
TOMBSTONE, PINNED, HAS_PARENT, HAS_CHILD, HAS_SIBLING = 1, 2, 4, 8, 16
PERISH_SHIFT, PERISH_MASK = 5, 3
# Bits of the permission byte; 0 is an old row and means read + write.
PERM_R, PERM_W, PERM_X = 1, 2, 4
LEGACY_PERMS = PERM_R | PERM_W
# Truth status names by code; other codes are UNKNOWN.
STATUSES = ("ACTIVE", "SUPERSEDED", "INCORRECT", "DEFERRED", "ONGOING")
URGENT, IMPORTANT, TO_CONSOLIDATE = 8, 16, 32
# Access levels by rank, and what each may do.
LEVELS = ("viewer", "commenter", "editor", "owner")
CAPABILITIES = {
    "viewer": ("read",),
    "commenter": ("read", "annotate"),
    "editor": ("read", "annotate", "write"),
    "owner": ("read", "annotate", "write", "share", "sign"),
}
# Old permission strings of a corpus file.
LEGACY_LEVELS = {"r": "viewer", "rw": "editor", "rwx": "editor"}


def has_bit(value: Column, bit: int) -> Column:
    return value.cast("int").bitwiseAND(F.lit(bit)) != 0


def is_tombstoned(flags: Column) -> Column:
    return has_bit(flags, TOMBSTONE)


def perish_class(flags: Column) -> Column:
    return F.shiftright(flags.cast("int"), PERISH_SHIFT).bitwiseAND(F.lit(PERISH_MASK))


def effective_perms(perms: Column) -> Column:
    return F.when(F.coalesce(perms, F.lit(0)) == 0, F.lit(LEGACY_PERMS)).otherwise(perms.cast("int"))


def can_read_bits(perms: Column) -> Column:
    return has_bit(effective_perms(perms), PERM_R)


def can_write_bits(perms: Column) -> Column:
    return has_bit(effective_perms(perms), PERM_W)


def status_code(lifecycle: Column) -> Column:
    return lifecycle.cast("int").bitwiseAND(F.lit(7))


def status_name(lifecycle: Column) -> Column:
    code = status_code(lifecycle)
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in STATUSES]), code), F.lit("UNKNOWN"))


def encode_lifecycle(status: Column, urgent: Column, important: Column, consolidate: Column) -> Column:
    """Pack a lifecycle byte; a status outside 0..7 is an error."""
    packed = (status.cast("int") + F.when(urgent, URGENT).otherwise(0)
              + F.when(important, IMPORTANT).otherwise(0) + F.when(consolidate, TO_CONSOLIDATE).otherwise(0))
    return F.when(status.between(0, 7), packed).otherwise(
        F.raise_error(F.lit("truth status must be within 0..7")).cast("int"))


def access_rank(level: Column) -> Column:
    """viewer 1 .. owner 4; anything else 0."""
    return F.array_position(F.array(*[F.lit(n) for n in LEVELS]), F.coalesce(level, F.lit(""))).cast("int")


def level_of_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in LEVELS]), rank - 1)


def can(level: Column, capability: str) -> Column:
    """An unknown level or capability is refused."""
    holders = [name for name, caps in CAPABILITIES.items() if capability in caps]
    return F.coalesce(level.isin(holders), F.lit(False)) if holders else F.lit(False)
