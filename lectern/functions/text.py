"""String functions: labels, links, snippets, cells, quality."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import record

ELLIPSIS = "…"
EMPTY_PASSAGE = "(empty passage)"

# Scheme of a source link and prefixes dropped from its slug.
LINK_SCHEME = "vps://source/"
SLUG_PREFIXES = ("poem:", "doc:", "pdf:")
# Endings that mark a first line as a file label.
LABEL_ENDINGS = (".md", ".txt", ".pdf", ".docx", ".html", ".json", ".csv", ".log")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title(text: Column, width: int = 100) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("[empty]")).otherwise(
        F.substring(lines(text)[0], 1, width))


def preview(text: Column, width: int = 200) -> Column:
    return F.substring(F.array_join(F.slice(lines(text), 2, 2), " "), 1, width)


def snippet(text: Column, width: int) -> Column:
    """One line, cut at the last space when that keeps at least half the width."""
    flat = collapse_spaces(F.coalesce(text, F.lit("")))
    cut = F.substring(flat, 1, width)
    head = F.regexp_extract(cut, r"(?s)^(.*) ", 1)
    room = F.length(head) >= width // 2
    spaced = F.contains(cut, F.lit(" ")) & room
    short = F.rtrim(F.when(spaced, head).otherwise(cut))
    return (F.when(flat == "", F.lit(EMPTY_PASSAGE))
            .when(F.length(flat) <= width, flat)
            .otherwise(F.concat(short, F.lit(ELLIPSIS))))


def first_content_line(text: Column, width: int = 120) -> Column:
    """First non-blank line, or the second when the first is only a file label."""
    # a lambda, since transform would give F.trim the position as the characters to trim
    rows = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda r: F.trim(r)), lambda r: r != "")
    first = F.get(rows, F.lit(0))
    low = F.lower(first)
    ending = F.lit(False)
    for end in LABEL_ENDINGS:
        ending = ending | F.endswith(low, F.lit(end))
    label = (F.length(first) <= 120) & (
        F.startswith(first, F.lit("[[[")) | ending
        | (~F.contains(first, F.lit(" ")) & F.contains(first, F.lit("."))))
    picked = F.when((F.size(rows) > 1) & label, F.get(rows, F.lit(1))).otherwise(first)
    return (F.when(F.size(rows) == 0, F.lit(EMPTY_PASSAGE))
            .when(F.length(picked) > width,
                  F.concat(F.rtrim(F.substring(picked, 1, width - 1)), F.lit(ELLIPSIS)))
            .otherwise(picked))


def label_line(text: Column) -> Column:
    """First line without its last `` (part N/M)`` suffix."""
    first = F.split(text, "\n", 2)[0]
    return F.nullif(F.trim(F.regexp_replace(first, r"^(.*) \(part .*$", "$1")), F.lit(""))


def source_slug(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    joined = "|".join(SLUG_PREFIXES)
    low = F.regexp_replace(low, f"^(?:{joined})", "")
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def source_link(name: Column, empty: str = "(no source)") -> Column:
    shown = F.trim(F.coalesce(name, F.lit("")))
    escaped = F.replace(F.replace(F.replace(shown, F.lit("\\"), F.lit("\\\\")),
                                  F.lit("]"), F.lit("\\]")), F.lit("|"), F.lit("\\|"))
    slug = source_slug(name)
    return (F.when(shown == "", F.lit(empty)).when(slug == "", escaped)
            .otherwise(F.concat(F.lit("["), escaped, F.lit(f"]({LINK_SCHEME}"), slug, F.lit(")"))))


def truncate_words(text: Column, n: int = 200) -> Column:
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(parts) > n, F.concat(F.array_join(F.slice(parts, 1, n), " "), F.lit("..."))
                  ).otherwise(text)


def strip_upload_prefix(name: Column) -> Column:
    return F.regexp_replace(name, "^[0-9a-f]{8}_", "")


def source_hash(name: Column) -> Column:
    """First 32 bits of the MD5 of the name, as BIGINT."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("bigint")


FNV_OFFSET = 2166136261   # fixed values of the 32-bit FNV-1a hash
FNV_PRIME = 16777619


def fnv1a32(name: Column) -> Column:
    """FNV-1a over UTF-16 code units, as the browser computes it."""
    units = F.hex(F.encode(name, "UTF-16BE"))
    count = (F.length(units) / 4).cast("int")
    codes = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count),
        lambda i: F.conv(F.substring(units, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    # the product stays below 2^57 and is reduced to 32 bits at each step
    return F.aggregate(codes, F.lit(FNV_OFFSET).cast("bigint"), lambda h, c: (
        h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, half to even; ``0%`` for an empty whole."""
    return F.when(whole <= 0, F.lit("0%")).otherwise(
        F.concat(F.bround(100 * part / whole, 0).cast("int").cast("string"), F.lit("%")))


def one_decimal(x: Column) -> Column:
    """One decimal, an exact tie (x.25, x.75) to even."""
    tie = (x * 4 == F.floor(x * 4)) & (x * 2 != F.floor(x * 2))
    return F.format_string("%.1f", F.when(tie, F.bround(x, 1)).otherwise(x))


def signed_percent(pct: Column) -> Column:
    sign = F.when(pct >= 0, F.lit("+")).otherwise(F.lit(""))
    nearest = F.rint(pct)
    whole = (F.abs(pct) >= 10) & (F.abs(pct - nearest) < 0.05)
    return F.when(whole, F.concat(sign, nearest.cast("int").cast("string"), F.lit("%"))).otherwise(
        F.concat(sign, one_decimal(pct), F.lit("%")))


def delta_label(a: Column, b: Column, absolute: bool = False) -> Column:
    """Signed percentage when both sides are positive, else the difference."""
    a, b = a.cast("double"), b.cast("double")
    diff = b - a
    sign = F.when(diff >= 0, F.lit("+")).otherwise(F.lit(""))
    plain = F.when(diff == F.floor(diff), F.concat(sign, diff.cast("bigint").cast("string"))
                   ).otherwise(F.concat(sign, one_decimal(diff)))
    if absolute:
        shown = plain
    else:
        shown = F.when((a > 0) & (b > 0), signed_percent((b - a) / a * 100.0)).otherwise(plain)
    return F.when(a.isNull() | b.isNull(), F.lit("—")).otherwise(shown)


UNREADABLE = "[^\\x20-\\x7E\\n\\r\\t\\u00A0-\\u024F]"


def readable_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, UNREADABLE, ""))


def numeric_dominant(cell: Column) -> Column:
    s = F.trim(F.coalesce(cell, F.lit("")))
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    return (s != "") & (F.length(s) <= 24) & (digits > 0) & (digits / F.greatest(F.length(s), F.lit(1)) >= 0.5)


def collapse_spaced(cell: Column) -> Column:
    text = F.coalesce(cell, F.lit(""))
    parts = F.filter(F.split(text, r"\s+"), lambda p: p != "")
    return F.when((F.size(parts) > 1) & F.forall(parts, lambda p: F.length(p) == 1),
                  F.array_join(parts, "")).otherwise(text)


def join_single_char_runs(text: Column, min_run: int = 3) -> Column:
    """Runs of at least ``min_run`` one-character lines become one spaced line."""
    kinds = F.transform(lines(text), lambda r: F.when(F.length(F.trim(r)) == 1, F.trim(r)).otherwise(r))
    # runs of one-character lines, found on the line-joined text
    joined = F.array_join(kinds, "\n")
    run = r"(?<=^|\n)([^\s])((?:\n[^\s]){%d,})(?=\n|$)" % (min_run - 1)
    parts = F.split(joined, run, -1)
    hits = F.transform(F.regexp_extract_all(joined, F.lit(run), F.lit(0)),
                       lambda m: F.replace(m, F.lit("\n"), F.lit(" ")))
    pairs = F.zip_with(parts, hits, lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(m, F.lit(""))))
    return F.array_join(pairs, "")


def display_name(display: Column, full: Column, user: Column, email: Column) -> Column:
    filled = [F.nullif(F.trim(c), F.lit("")) for c in (display, full, user, F.substring_index(email, "@", 1))]
    return F.coalesce(*filled, F.lit("Unknown"))


def frontmatter(text: Column) -> Column:
    """Key/value pairs of a leading ``---`` block."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    rows = F.filter(F.split(block, "\n"), lambda r: F.regexp_like(r, F.lit(r"^[A-Za-z][\w -]*:")))
    return F.transform(rows, lambda r: record(
        key=F.trim(F.substring_index(r, ":", 1)),
        value=F.trim(F.regexp_replace(r, r"^[^:]*:", ""))))


def wikilinks(text: Column) -> Column:
    inner = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    return F.transform(inner, lambda t: record(
        target=F.trim(F.regexp_replace(t, r"[#|].*$", "")),
        heading=F.nullif(F.trim(F.regexp_extract(t, r"#([^|]*)", 1)), F.lit("")),
        shown=F.nullif(F.trim(F.regexp_extract(t, r"\|(.*)$", 1)), F.lit(""))))


def hashtags(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?:^|\s)#([A-Za-z][\w/-]*)"), F.lit(1))
    return F.array_distinct(found)


def strip_export_hash(path: Column) -> Column:
    """Decode ``%20`` and drop the 32-hex suffix an exporter adds before the extension."""
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.coalesce(decoded, path), r"[ _]?[0-9a-f]{32}(?=\.[^./]+$|$)", "")
