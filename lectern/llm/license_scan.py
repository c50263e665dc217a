"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor folder.

A file's own licence is the template most like one of its lines, one of its runs of as many words as the template, or the
whole text of a licence file. Runs find notices wrapped over lines, within longer lines and within the full texts of
licences. Files without one take that of the licence file in the nearest folder above them. Everything is a join: terms with the
few template weights, folders with their ancestors.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

THRESHOLD = 0.75
MOST_TERMS = 20_000    # of all templates together; they are broadcast
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
#: Everyday words of texts in any language, poor as hints; the choice changes no result.
FREQUENT = set("a and any are as at be by for from in is it may mit not of on or that the this to with work you".split())
#: What tells licences of like wording apart: a run must hold these words of its template, as well as its numbers, and none of the
#: words of its kin.
TELLING = {"nc", "noncommercial"}
KIN = {"lesser", "affero", "sharealike", "noderivatives", "sa", "nd"}
#: Customary notices of common licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def terms(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def weights(templates=TEMPLATES) -> tuple[dict[str, float], float, list[tuple[int, str, str, float]]]:
    """Inverse document frequency of each term over the templates, that of any other term, and the unit
    vectors as (template, licence, term, weight)."""
    bags = [Counter(terms(text)) for _, text in templates]
    seen = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in seen.items()}
    rows = []
    for k, ((name, _), bag) in enumerate(zip(templates, bags)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(k, name, t, n * idf[t] / norm) for t, n in sorted(bag.items())]
    if len(rows) > MOST_TERMS:
        raise ValueError(f"{len(rows)} template terms; at most {MOST_TERMS} are sent to every task")
    return idf, math.log(1 + len(bags)) + 1, rows


def anchors(rows: list[tuple[int, str, str, float]], threshold: float) -> list[str]:
    """Terms one of which every text as similar as ``threshold`` must hold: by Cauchy and Schwarz the terms left out
    of a template cannot reach it on their own."""
    found = set()
    for k in {r[0] for r in rows}:
        left = 1.0
        for _, _, term, w in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2] in FREQUENT or len(r[2]) == 1, -r[3], r[2])):
            if math.sqrt(max(left, 0)) < threshold - 1e-9:
                break
            found.add(term)
            left -= w * w
    return sorted(found)


def _sums(x: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x)])
    return total[n:] - total[:-n]


AROUND = 2   # words on either side of a run in which words of its kin count against it


class Matcher:
    """The templates as tables, made once a task."""

    def __init__(self, templates, threshold: float):
        self.idf, self.other, rows = weights(templates)
        self.threshold = threshold
        self.anchors = anchors(rows, threshold)
        self.wanted = set(self.anchors)
        self.known = []
        for k, (name, text) in enumerate(templates):
            mine = {t: w for j, _, t, w in rows if j == k}
            self.known.append((name, mine, len(terms(text)), {t for t in mine if t.isdigit() or t in TELLING}, KIN - set(mine)))

    def bag(self, words: list[str]) -> dict[str, float]:
        """The best score, from the threshold on, of each licence for all words together."""
        found: dict[str, float] = {}
        counts = Counter(words)
        norm = math.sqrt(sum((n * self.idf.get(t, self.other)) ** 2 for t, n in counts.items()))
        for name, mine, _, must, mustnt in self.known:
            if must <= counts.keys() and not mustnt & counts.keys():
                score = round(sum(n * self.idf[t] * mine[t] for t, n in counts.items() if t in mine) / norm, 6)
                if score >= self.threshold and score > found.get(name, 0):
                    found[name] = score
        return found

    def runs(self, words: list[str]) -> dict[str, float]:
        """The same over all runs of as many words as a template has (or all words, if these are fewer)."""
        found: dict[str, float] = {}
        ids: dict[str, int] = {}
        at = np.array([ids.setdefault(w, len(ids)) for w in words])
        weight = np.array([self.idf.get(w, self.other) for w in ids])
        squares = (weight * weight)[at]
        for name, mine, n, must, mustnt in self.known:
            if not must <= ids.keys():
                continue
            unit = np.array([mine.get(w, 0.0) for w in ids]) * weight
            n = min(n, len(words))
            dots = _sums(unit[at], n)
            # the norm without repeats is a lower bound, so only few places are counted
            for place in np.flatnonzero((dots > 0) & (dots >= (self.threshold - 1e-6) * np.sqrt(np.maximum(_sums(squares, n), 0)))).tolist():
                here, counts = np.unique(at[place:place + n], return_counts=True)
                score = round(float(counts @ unit[here] / np.sqrt(((counts * weight[here]) ** 2).sum())), 6)
                if score >= self.threshold and score > found.get(name, 0) and must <= set(words[place:place + n]) \
                        and not mustnt & set(words[max(place - AROUND, 0):place + n + AROUND]):
                    found[name] = score
        return found

    def of_file(self, text: str, whole: bool) -> list[tuple[str, str, float]]:
        """(kind, licence, score) of a text in lower case; what holds no anchor is passed over."""
        words = _WORDS(text)
        if self.wanted.isdisjoint(words):
            return []
        out = [("file", name, score) for name, score in self.bag(words).items()] if whole else []
        for line in text.split("\n"):
            if any(a in line for a in self.anchors):
                mine = _WORDS(line)
                if not self.wanted.isdisjoint(mine):
                    out += [("header", name, score) for name, score in self.bag(mine).items()]
        return out + [("header", name, score) for name, score in self.runs(words).items()]


_WORDS = re.compile("[a-z0-9]+").findall


_FIELDS = pa.schema([("_k0", pa.int64()), ("_k1", pa.int64()), ("kind", pa.string()), ("licence", pa.string()), ("score", pa.float64())])


def scan_licences(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` (path, text, and any other columns but text kept) with licence, found, score and origin appended.

    ``found`` is 'header' for a line or a run of words of the file, 'file' for the text of a licence file, 'inherited' with the folder as
    ``origin``, or 'none'. Lines, runs and texts must hold the numbers and telling words of their template and none of the words
    of its kin. Equal scores go to the licence that comes first by name; of several licence files in a folder the
    most similar counts, then the first by licence name. A null path has no folder and inherits nothing; its own text is
    still read. Rows of one path are told apart by their texts. A null or empty text has no licence of its own.
    Whole texts are read. Rows that repeat stay. Appended names replace columns of the same name. An empty table gives an
    empty result. The rows with a licence of their own are written when this is called.
    """
    needed = anchors(weights(templates)[2], threshold)
    maybe = reduce(lambda a, b: a | b, [F.contains("_t", F.lit(t)) for t in needed])   # far cheaper than a pattern
    new = ("licence", "found", "score", "origin")
    names = [c for c in files.columns if c != "text" and c not in new]
    key = [F.xxhash64("path", "text").alias("_k0"), F.xxhash64(F.lit(7), "path", "text").alias("_k1")]
    schema = "_k0 long, _k1 long, kind string, licence string, score double"

    def own_licences(batches):
        matcher = Matcher(templates, threshold)
        for batch in batches:
            out = [(a, b, *hit) for a, b, text, whole in zip(*(batch.column(c).to_pylist() for c in ("_k0", "_k1", "_t", "_is")))
                   for hit in matcher.of_file(text, whole)]
            yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS.names, o)) for o in out], _FIELDS)

    scored = files.select(*key, F.lower("text").alias("_t"), F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)).alias("_is")).filter(
        maybe).mapInArrow(own_licences, schema)
    # one row a file with a licence of its own; written once, since it is needed three times below
    best = materialize(scored.groupBy("_k0", "_k1").agg(
        F.min(F.struct((-F.col("score")).alias("least"), "licence", "kind")).alias("_b")), "licences")
    own = files.select(*names, *key).join(best, ["_k0", "_k1"], "left").withColumn(
        "_dir", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(
            F.col("path").isNotNull(), F.lit("")))

    of_dir = own.filter(F.col("path").rlike(LICENCE_FILE) & F.col("_b").isNotNull()).groupBy("_dir").agg(
        F.min("_b").alias("_d")).withColumnRenamed("_dir", "_above")
    steps = F.split("_dir", "/", -1)
    above = own.filter("_b IS NULL AND _dir IS NOT NULL").select("_dir").distinct().select("_dir", F.explode(F.concat(
        F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)),
                                        lambda k: F.array_join(F.slice(steps, 1, k), "/")))).alias("_above")).distinct()
    nearest = above.join(of_dir, "_above").groupBy("_dir").agg(
        F.max(F.struct(F.length("_above").alias("n"), "_above", "_d")).alias("_near"))
    every = own.join(nearest, "_dir", "left")
    mine, near = F.col("_b").isNotNull(), F.col("_near").isNotNull()
    return every.select(
        *names, F.when(mine, F.col("_b.licence")).otherwise(F.col("_near._d.licence")).alias("licence"),
        F.when(mine, F.col("_b.kind")).when(near, F.lit("inherited")).otherwise(F.lit("none")).alias("found"),
        F.when(mine, -F.col("_b.least")).alias("score"),
        F.when(~mine & near, F.col("_near._above")).alias("origin"))


def sql_for(files: str, templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result as DuckDB SQL over ``files``, a query with doc_id, path and text."""
    idf, other, rows = weights(templates)
    known = ", ".join(f"('{t}', {w!r})" for t, w in sorted(idf.items()))
    vectors = ", ".join(f"({k}, '{n}', '{t}', {w!r})" for k, n, t, w in rows)
    licence = "(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"

    def listed(words) -> str:
        return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]::VARCHAR[]"

    guards = ", ".join(f"({k}, '{name}', {n}, {listed(must)}, {listed(mustnt)})" for k, (name, _, n, must, mustnt) in
                       enumerate(Matcher(templates, threshold).known))
    hints = listed(anchors(rows, threshold))
    return f"""
WITH RECURSIVE files AS ({files}), guards(template, licence, size, must, mustnt) AS (VALUES {guards}),
known(term, idf) AS (VALUES {known}), vectors(template, licence, term, weight) AS (VALUES {vectors}),
ws AS (SELECT path, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM files WHERE list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), {hints})),
spots AS (SELECT path, template, licence, p, ws[p:p + m - 1] AS run FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS p FROM (
    SELECT path, ws, template, licence, must, mustnt, least(size, len(ws)) AS m FROM ws, guards WHERE list_has_all(ws, must)))
  WHERE list_has_any(ws[p:p + m - 1], {hints}) AND list_has_all(ws[p:p + m - 1], must) AND NOT list_has_any(ws[greatest(p - {AROUND}, 1):p + m - 1 + {AROUND}], mustnt)),
bags AS (SELECT path, template, licence, p, term, count(*) AS n FROM (SELECT path, template, licence, p, unnest(run) AS term FROM spots) GROUP BY ALL),
runs AS (SELECT b.path, 'header' AS kind, b.licence, round(sum(n * coalesce(idf, 0) * coalesce(v.weight::DOUBLE, 0)) / sqrt(sum(pow(n * coalesce(idf, {other!r}::DOUBLE), 2))), 6) AS score
  FROM bags b LEFT JOIN known USING (term) LEFT JOIN vectors v ON v.template = b.template AND v.term = b.term GROUP BY b.path, b.template, b.licence, b.p),
parts AS (SELECT path, i AS no, 'header' AS kind, part FROM (
    SELECT path, unnest(string_split(lower(text), chr(10))) AS part, generate_subscripts(string_split(lower(text), chr(10)), 1) AS i FROM files)
  UNION ALL SELECT path, 0, 'file', lower(text) FROM files WHERE regexp_matches(path, '{licence}')),
counts AS (SELECT path, no, kind, term, count(*) AS n FROM (
    SELECT path, no, kind, unnest(string_split_regex(part, '[^a-z0-9]+')) AS term FROM parts) WHERE term <> '' GROUP BY ALL),
weighed AS (SELECT c.*, n * coalesce(idf, {other!r}::DOUBLE) AS w FROM counts c LEFT JOIN known USING (term)),
norms AS (SELECT path, no, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
held AS (SELECT path, no, list(term) AS held FROM counts GROUP BY ALL),
scored AS (SELECT path, kind, d.licence, round(dot / norm, 6) AS score FROM (
    SELECT path, no, kind, template, licence, sum(w * weight::DOUBLE) AS dot FROM weighed JOIN vectors USING (term) GROUP BY ALL) d
  JOIN norms USING (path, no) JOIN held USING (path, no) JOIN guards g ON g.template = d.template
  WHERE round(dot / norm, 6) >= {threshold} AND list_has_all(held, must) AND NOT list_has_any(held, mustnt)
  UNION ALL SELECT * FROM runs WHERE score >= {threshold}),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, licence, kind) = 1),
own AS (SELECT f.doc_id, f.path, b.licence, b.kind, b.score, regexp_replace(f.path, '/[^/]*$', '') AS dir
  FROM files f LEFT JOIN best b USING (path)),
of_dir AS (SELECT dir AS above, licence FROM own WHERE regexp_matches(path, '{licence}') AND licence IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence, kind) = 1),
ups AS (SELECT DISTINCT dir, dir AS above FROM own UNION SELECT dir, regexp_replace(above, '(^|/)[^/]*$', '') FROM ups WHERE above <> ''),
nearest AS (SELECT dir, above, licence FROM ups JOIN of_dir USING (above)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1)
SELECT doc_id, path, coalesce(o.licence, n.licence) AS licence,
  CASE WHEN o.licence IS NOT NULL THEN o.kind WHEN n.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS found,
  o.score, CASE WHEN o.licence IS NULL THEN n.above END AS origin
FROM own o LEFT JOIN nearest n USING (dir)"""
