"""Tokenising, stemming and keyword matching."""
from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes in matching order.
STEM_SUFFIXES = ("ings", "ing", "tion", "sion", "ness", "ment", "able", "ible", "ful",
                 "less", "ous", "ive", "ed", "es", "s", "ly")

# Words dropped from a search query.
QUERY_STOPWORDS = (
    "a an the is are what who how when where why which of in on for to and or it as at by "
    "from about with me tell show find search").split()

# Words the result filters ignore.
FILTER_STOPWORDS = (
    "the and but for nor not yet are was were has had have does did will can may use its his "
    "her our who how all any this that they them then than these those with from into each "
    "when where what which there their been being would could should about also just more "
    "some only very such do so if or as at by in is it no of on to up we an be he me show "
    "find tell give list get want need look make let see know").split()

# Words ignored when mining tokens, bigrams and entities.
TOKEN_STOPWORDS = (
    "the a an and or but if then of in on at to for with by as is are was were be been being "
    "have has had do does did this that these those it its i we you they he she him her them "
    "us my your our their his hers not no yes so than from into onto up down out over under "
    "about just very also will would should could can may might must there here what which "
    "who whom whose when where why how any some all each every one two three am pm").split()

# Calendar words. Themes keep "may" through the list above either way.
CALENDAR_WORDS = (
    "monday tuesday wednesday thursday friday saturday sunday january february march april "
    "may june july august september october november december").split()

TOKEN_PATTERN = r"[A-Za-z][A-Za-z0-9\-]{1,}"
STEM_STRIP = ".,!?;:'\""
QUERY_STRIP = "?.,!"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _not_in(stop) -> "callable":
    """A literal IN list of this length is compiled to a hash set."""
    return lambda w: ~w.isin(*stop)


def simple_stem(word: Column) -> Column:
    """Drop the first listed suffix that leaves at least three characters.

    Where two suffixes fit, the longer is listed first, so the first that fits is the longest one;
    a reluctant head of three or more characters finds exactly that.
    """
    return F.regexp_replace(F.lower(word), f"^(.{{3,}}?)(?:{'|'.join(STEM_SUFFIXES)})$", "$1")


def keyword_match(keyword: str, text: Column) -> Column:
    """Substring of the lower-cased text, or equal stem of one of its words.

    A word's stem begins the word, so text without the keyword's stem is never split, and only
    words beginning with it are stemmed.
    """
    text = F.lower(text)
    stem = simple_stem(F.lit(keyword))

    def same_stem(w):
        bare = F.btrim(w, F.lit(STEM_STRIP))
        return F.startswith(bare, stem) & (simple_stem(bare) == stem)

    return F.contains(text, F.lit(keyword)) | (F.contains(text, stem) & F.exists(F.split(text, r"\s+"), same_stem))


def _count(flags) -> Column:
    total = F.lit(0)
    for flag in flags:
        total = total + flag.cast("int")
    return total


def keyword_hits(keywords, text: Column) -> Column:
    return _count(keyword_match(k, text) for k in keywords)


def contains_hits(keywords, lowered: Column) -> Column:
    return _count(F.contains(lowered, F.lit(k)) for k in keywords)


def boost(hits: Column, per_hit: float, cap: float) -> Column:
    return F.least(hits * F.lit(per_hit), F.lit(cap))


def fielded_boost(keywords, text: Column) -> Column:
    """Title .1 each (at most .3), body-only .05 each (at most .2), several-keyword bonus."""
    body = F.lower(text)
    title = F.lower(F.split(text, "\n", 2)[0])
    in_title = contains_hits(keywords, title)
    body_only = _count(F.contains(body, F.lit(k)) & ~F.contains(title, F.lit(k)) for k in keywords)
    found = contains_hits(keywords, body)
    phrase = F.when(found >= 2, F.least(0.05 + found * 0.05, F.lit(0.25))).otherwise(F.lit(0.0))
    return boost(in_title, 0.1, 0.3) + boost(body_only, 0.05, 0.2) + phrase


def query_keywords(query: Column) -> Column:
    """Words longer than two characters, stripped of ``?.,!``, without stopwords."""
    long_words = F.filter(_words(query), lambda w: F.length(w) > 2)
    cleaned = F.transform(long_words, lambda w: F.btrim(F.lower(w), F.lit(QUERY_STRIP)))
    return F.filter(cleaned, _not_in(QUERY_STOPWORDS))


def clean_query(query: Column) -> Column:
    kept = query_keywords(query)
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(query)


def filter_keywords(query: Column) -> Column:
    """Keywords of the result filters; a query of stopwords only keeps its raw words."""
    plain = F.transform(_words(query), lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", ""))
    plain = F.filter(plain, lambda w: F.length(w) >= 2)
    kept = F.filter(plain, _not_in(FILTER_STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(plain)


def content_tokens(text: Column) -> Column:
    """Lower-cased ASCII tokens of three or more characters, without stopwords."""
    lowered = F.translate(text, ascii_uppercase, ascii_lowercase)
    tokens = F.regexp_extract_all(lowered, F.lit(TOKEN_PATTERN), F.lit(0))
    keep = _not_in(TOKEN_STOPWORDS)
    return F.filter(tokens, lambda t: (F.length(t) > 2) & keep(t))


def bigrams(tokens: Column) -> Column:
    """Consecutive kept tokens, so a pair may straddle a dropped stopword."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))),
                       F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))
