"""Dates, money and entity mentions in text, as array-of-struct expressions.

Spark has no regex function returning offsets, so a span list is built from two built-ins: the
matches and the pieces between them, whose lengths add up to the offsets. ``let`` binds an
intermediate array once, so later stages refer to it without evaluating it again.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as they stand in dates.
MONTHS = ("(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|"
          "Aug(?:ust)?|Sep(?:t|tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)")
MONTH_STARTS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Date formats with their confidence. What a place must begin with is tested before what may stand in front.
ISO = (r"\d(?<!\d\d)\d{3}-\d{2}-\d{2}(?!\d)", "iso", 1.0)
COMPACT = (r"\d(?<!\d\d)\d{7}(?!\d)", "compact", 0.95)
SLASH = (r"\d(?<!\d\d)\d?/\d{1,2}/(?:\d{2}|\d{4})(?!\d)", "us_slash", 0.9)
MONTH_FIRST = (rf"(?i)(?=[a-z])\b{MONTHS}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b", "long", 0.95)
DAY_FIRST = (rf"(?i)(?=\d)\b\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTHS}\s+\d{{4}}\b", "long", 0.95)

# Amounts and currency marks.
AMOUNT = r"(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
AMOUNT_THREE_DIGITS_FIRST = r"(?:\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)"
CODE_NAMES = ("USD", "EUR", "GBP", "CAD", "AUD", "JPY", "CHF")
CODES = f"(?:{'|'.join(CODE_NAMES)})"
HINT_WORD = "[A-Za-z][A-Za-z_-]*"
HINT_WINDOW = 20
MONEY = "decimal(18,4)"
MONEY_TYPE = (f"array<struct<value:{MONEY},currency:string,raw_span:string,start:int,end:int,is_negative:boolean,"
              "confidence:double,context_hint:string>>")

# Preset names and the hint tokens they stand for.
PRESETS = {
    "fuel_surcharge": ("fuel", "surcharge"),
    "invoice_total": ("total", "invoice"),
    "state_fee": ("state", "fee"),
    "tax": ("tax", "sales"),
    "delivery": ("delivery",),
    "tip": ("tip", "gratuity"),
}


def record(**fields: Column) -> Column:
    """Struct with its field names as literals: a generator in the same select strips aliases."""
    return F.named_struct(*[c for name, value in fields.items() for c in (F.lit(name), value)])


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _total_length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda s, x: s + F.length(x))


SPAN_TYPE = "array<struct<raw:string,start:int,end:int>>"
MARK = "\x01"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<raw, start, end>>: non-overlapping matches with character offsets.

    Text without a match, the usual case, is scanned once and never split.
    """

    def locate(m):
        def place(p):
            def one(raw, i):
                before = _total_length(F.slice(p, F.lit(1), i + 1)) + _total_length(F.slice(m, F.lit(1), i))
                return let(before, lambda start: record(raw=raw, start=start, end=(start + F.length(raw))))
            return F.transform(m, one).cast(SPAN_TYPE)
        # split() compiles a pattern for every row but not a single character; text that holds this one is split by the pattern
        pieces = F.when(F.contains(text, F.lit(MARK)), F.split(text, pattern, -1)).otherwise(
            F.split(F.regexp_replace(text, pattern, MARK), MARK, -1))
        return F.when(F.size(m) == 0, F.array().cast(SPAN_TYPE)).otherwise(let(pieces, place))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), locate)


def _holding(text: Column, marks, found: Column, kind: str) -> Column:
    """``found`` where the text holds one of the marks without which it would be empty: a pattern costs far more to search."""
    some = reduce(lambda x, y: x | y, [F.contains(text, F.lit(m)) for m in marks])
    return F.when(some, found).otherwise(F.array().cast(kind))


def _with_digits(text: Column, found: Column, kind: str) -> Column:
    """Neither a date nor an amount lacks a digit; other text is not searched further."""
    return F.when(F.regexp_like(text, F.lit("[0-9]")), found).otherwise(F.array().cast(kind))


def _overlaps(kept: Column):
    return lambda h: F.exists(kept, lambda k: (h["start"] < k["end"]) & (h["end"] > k["start"]))


def _date(y: Column, m: Column, d: Column) -> Column:
    """Null for an impossible day; the cast is much cheaper than a pattern-based parser."""
    return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), m.cast("string"), d.cast("string")).try_cast("date")


def _read_iso(raw):
    return raw.try_cast("date")


def _read_compact(raw):
    year = F.substring(raw, 1, 4).cast("int")
    day = _date(year, F.substring(raw, 5, 2), F.substring(raw, 7, 2))
    return F.when(year.between(1900, 2099), day)


def _read_slash(raw):
    part = F.split(raw, "/")
    y = part[2].cast("int")
    year = F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
    return _date(year, part[0].cast("int"), part[1].cast("int"))


def _read_long(raw):
    name = F.lower(F.substring(F.regexp_extract(raw, "[A-Za-z]{3,}", 0), 1, 3))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTH_STARTS]), name)
    day = F.regexp_extract(raw, r"(?<!\d)(\d{1,2})(?!\d)", 1)
    return _date(F.regexp_extract(raw, r"(\d{4})$", 1), month.cast("int"), day.cast("int"))


DATED_TYPE = "array<struct<start:int,rank:double,shortness:int,end:int,raw:string,date:date,source_format:string>>"


def _dated(text: Column, kind, read) -> Column:
    pattern, name, confidence = kind
    hits = F.transform(spans(text, pattern), lambda h: record(
        start=h["start"], rank=F.lit(-confidence),
        shortness=(h["start"] - h["end"]), end=h["end"], raw=h["raw"],
        date=read(h["raw"]), source_format=F.lit(name)))
    return F.filter(hits, lambda h: h["date"].isNotNull()).cast(DATED_TYPE)


def extract_dates(text: Column) -> Column:
    """array<struct<date, raw_span, start, end, confidence, source_format>>, by offset.

    Candidates sort by start, then confidence, then length; each one that begins before the end
    of the last kept one is dropped.
    """
    text = F.coalesce(text, F.lit(""))
    named = let(F.lower(text), lambda low: _holding(low, MONTH_STARTS, F.concat(
        _dated(text, MONTH_FIRST, _read_long), _dated(text, DAY_FIRST, _read_long)), DATED_TYPE))
    found = F.concat(_holding(text, "-", _dated(text, ISO, _read_iso), DATED_TYPE), _dated(text, COMPACT, _read_compact),
                     _holding(text, "/", _dated(text, SLASH, _read_slash), DATED_TYPE), named)

    kept_type = ("array<struct<date:date,raw_span:string,start:int,end:int,confidence:double,"
                 "source_format:string>>")

    def shape(h):
        return record(date=h["date"], raw_span=h["raw"], start=h["start"],
                        end=h["end"], confidence=(-h["rank"]).cast("double"),
                        source_format=h["source_format"])

    def sweep(acc, h):
        free = h["start"] >= acc["edge"]
        return record(edge=F.when(free, h["end"]).otherwise(acc["edge"]),
                        kept=F.when(free, F.concat(acc["kept"], F.array(shape(h)).cast(kept_type)))
                        .otherwise(acc["kept"]))

    def settle(hits):
        start = record(edge=F.lit(-1), kept=F.array().cast(kept_type))
        swept = F.aggregate(F.array_sort(hits), start, sweep, lambda acc: acc["kept"])
        return F.when(F.size(hits) <= 1, F.transform(hits, shape).cast(kept_type)).otherwise(swept)

    return _with_digits(text, let(found, settle), kept_type)


def dates_of(text: Column) -> Column:
    """array<date> of the kept dates."""
    return F.transform(extract_dates(text), lambda d: d["date"])


def first_date(text: Column, source: Column) -> Column:
    """Earliest date in the text, else in the source name."""
    return F.coalesce(F.array_min(dates_of(text)), F.array_min(dates_of(source)))


def context_hint(text: Column, start: Column, end: Column) -> Column:
    """Nearest word within 20 characters, the left side first; lower case."""
    left = F.substring(text, F.greatest(start - HINT_WINDOW, F.lit(0)) + 1,
                       F.least(start, F.lit(HINT_WINDOW)))
    right = F.substring(text, end + 1, F.lit(HINT_WINDOW))
    before = F.regexp_extract_all(left, F.lit(HINT_WORD), F.lit(0))
    after = F.regexp_extract(right, HINT_WORD, 0)
    return F.lower(F.coalesce(F.try_element_at(before, F.lit(-1)), F.nullif(after, F.lit(""))))


def extract_currency(text: Column, presets=(), three_digits_first: bool = False) -> Column:
    """array<struct<value, currency, raw_span, start, end, is_negative, confidence, context_hint>>.

    A parenthesised dollar amount beats a plain one, which beats a trailing code, then the euro
    and pound signs; a later kind never overlaps an earlier one. ``three_digits_first`` reads an
    ungrouped ``$1234.56`` as 123, as the original amount pattern does.
    """
    text = F.coalesce(text, F.lit(""))
    amount = AMOUNT_THREE_DIGITS_FIRST if three_digits_first else AMOUNT
    stages = [
        ("(", rf"\(\s*\$\s*{amount}\s*\)", "USD", True, 1.0),
        ("$", rf"\$\s*{amount}", "USD", False, 1.0),
        (CODE_NAMES, rf"(?=\d)(?<!\w){amount}\s*{CODES}\b", None, False, 0.95),
        ("€", rf"€\s*{amount}", "EUR", False, 0.9),
        ("£", rf"£\s*{amount}", "GBP", False, 0.9),
    ]

    def read(marks, pattern, currency, negative, confidence):
        def one(h):
            number = F.replace(F.regexp_extract(h["raw"], r"\d[\d,]*(?:\.\d+)?", 0), F.lit(","), F.lit(""))
            code = F.lit(currency) if currency else F.substring(h["raw"], -3, 3)
            return record(
                value=number.try_cast(MONEY), currency=code, raw_span=h["raw"],
                start=h["start"], end=h["end"], is_negative=F.lit(negative),
                confidence=F.lit(confidence).cast("double"),
                context_hint=context_hint(text, h["start"], h["end"]))
        hits = F.filter(F.transform(spans(text, pattern), one), lambda h: h["value"].isNotNull())
        return _holding(text, marks, hits.cast(MONEY_TYPE), MONEY_TYPE)

    def stage(kept, rest):
        if not rest:
            return F.array_sort(kept, lambda a, b: a["start"] - b["start"])
        fresh = F.filter(read(*rest[0]), lambda h: ~_overlaps(kept)(h))
        return let(F.concat(kept, fresh), lambda k: stage(k, rest[1:]))

    hits = let(read(*stages[0]), lambda k: stage(k, stages[1:]))
    hits = _with_digits(text, hits, MONEY_TYPE)
    return filter_presets(hits, presets) if presets else hits


def preset_tokens(presets) -> list[str]:
    tokens = set()
    for name in presets:
        tokens.update(PRESETS.get(name.lower(), (name.lower(),)))
    return sorted(tokens)


def filter_presets(hits: Column, presets) -> Column:
    """Keep amounts whose hint contains, or is contained in, a wanted token."""
    tokens = preset_tokens(presets)

    def wanted(h):
        hint = h["context_hint"]
        match = F.lit(False)
        for t in tokens:
            match = match | F.contains(hint, F.lit(t)) | F.contains(F.lit(t), hint)
        return hint.isNotNull() & match

    return F.filter(hits, wanted)


def mention_context(text: Column, start: Column, end: Column, reach: int = 100) -> Column:
    """Text around a span, up to the nearest sentence end within ``reach`` characters."""
    left = F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
    right = F.substring(text, end + 1, F.lit(reach))
    inside = F.regexp_extract(right, r"^[^.!?\n]*[.!?\n]", 0)
    tail = F.when(inside != "", inside).otherwise(right)
    middle = F.substring(text, start + 1, end - start)
    joined = F.concat(F.regexp_extract(left, r"[^.!?\n]*$", 0), middle, tail)
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


def _quote(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def entity_mentions(text: Column, name: str, aliases=(), reach: int = 100) -> Column:
    """array<struct<entity_name, matched_text, start, end, context>>; longer terms win."""
    text = F.coalesce(text, F.lit(""))
    terms: list[str] = []
    for term in sorted([name, *[a for a in aliases if a]], key=len, reverse=True):
        if term.lower() not in terms:
            terms.append(term.lower())
    lowered = F.lower(text)

    def stage(kept, rest):
        if not rest:
            return F.transform(
                F.array_sort(kept, lambda a, b: a["start"] - b["start"]),
                lambda h: record(
                    entity_name=F.lit(name),
                    matched_text=F.substring(text, h["start"] + 1, h["end"] - h["start"]),
                    start=h["start"], end=h["end"],
                    context=mention_context(text, h["start"], h["end"], reach)))
        fresh = F.filter(spans(lowered, _quote(rest[0])), lambda h: ~_overlaps(kept)(h))
        return let(F.concat(kept, fresh), lambda k: stage(k, rest[1:]))

    return let(spans(lowered, _quote(terms[0])), lambda k: stage(k, terms[1:]))


def entity_candidates(text: Column, min_length: int = 2) -> Column:
    """One to three capitalised tokens in a row whose first token is no stopword."""
    from .lexical import CALENDAR_WORDS, TOKEN_STOPWORDS
    token = "[A-Z][a-zA-Z0-9]{%d,}" % (max(min_length, 1) - 1)
    pattern = rf"\b{token}(?:\s+{token}){{0,2}}\b"
    stop = [*TOKEN_STOPWORDS, *CALENDAR_WORDS]
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda c: ~F.lower(F.regexp_extract(c, r"^\S+", 0)).isin(*stop))


def discover_entities(text: Column, min_length: int = 2) -> Column:
    """Distinct candidates ignoring case, first surface form and order kept."""
    def firsts(found):
        return let(F.transform(found, F.lower), lambda keys: F.filter(
            found, lambda c, i: F.array_position(keys, F.lower(c)) == i + 1))
    return let(entity_candidates(text, min_length), firsts)
