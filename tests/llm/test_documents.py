import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import language_id, quality_rules
from lectern.llm.components import components
from lectern.llm.jaccard_join import jaccard_classes, keep_one_of_each
from lectern.llm.license_scan import TEMPLATES, anchors, scan_licences, terms, weights
from lectern.llm.shingles import bands_for
from lectern.llm.substring_dedup import cut_repeats, deduplicated
from lectern.llm.topk import quantised, top_k

BASE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{BASE}/documents.parquet")


# -- language -----------------------------------------------------------------------------------


def test_language_held_out(docs):
    got = language_id.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and sum(r["rejected"] for r in got) <= 5


def test_language_learns_from_no_held_out_row(docs):
    spoiled = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    got = language_id.language_report(spoiled)
    assert got.filter("lang_pred = 'xx'").count() == 0


def test_language_edges(spark, docs, odd, none):
    model = language_id.train(docs)
    got = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    for i in (1, 2, 3):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"]
    assert language_id.identify(none, model).count() == 0
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and {1, 2, 3}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert language_id.keep_identified(none, language_id.train(none)).count() == 0
    untaught = language_id.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert language_id.identify(odd, untaught).filter("lang_pred <> 'und'").count() == 0


def test_rejection_follows_doubt():
    model = language_id.fit(["aaa bbb aab"] * 30 + ["zzz yyy zzy"] * 30, ["a"] * 30 + ["z"] * 30)
    import pyarrow as pa
    best, score = model.predict(pa.array(["aaa bbb", "zzz yyy", "qqq kkk"]))
    assert [model.langs[b] for b in best[:2]] == ["a", "z"] and score[2] < min(score[:2])


# -- quality ------------------------------------------------------------------------------------


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    many, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark, docs, odd):
    extra = ["a b c d e f g h " * 2, "a a a a a a a a a a", "x\n\n x\nx\n", "é ü #*\x0b|\x1c", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8"]
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(
        spark.createDataFrame(list(enumerate(extra, 9000)), "doc_id long, text string"))
    for r in quality_rules.with_statistics(rows).select("text", *[F.col(f"_q.{c}") for c in quality_rules.BASE]).collect():
        assert tuple(r[c] for c in quality_rules.BASE) == brute_counts(r["text"]), (r["text"] or "")[:60]


def test_quality_learns_and_keeps(spark, docs, odd, none):
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    got = quality_rules.quality_report(docs, labels).join(labels, "doc_id").collect()
    bad, good = [r for r in got if r["quality"] == 0], [r for r in got if r["quality"] == 1 and not r["base_failed"]]
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad) and sum(r["kept"] for r in good) >= 0.99 * len(good)
    kept = quality_rules.keep_good(odd, labels)
    assert kept.columns == odd.columns and {1, 2, 3, 6, 7}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert quality_rules.quality_report(none, labels).count() == 0
    assert quality_rules.quality_report(odd, labels.limit(0)).count() == odd.count()


def test_quality_plan_is_native_and_computes_once(spark, docs):
    plan = quality_rules.quality_report(docs, spark.read.parquet(f"{BASE}/labels.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and plan.count("xxhash64") == 1


def test_covering_finds_planted_rules():
    rng = np.random.default_rng(1)
    columns = {"symbols_per_word": rng.random(3000), "upper_share": rng.random(3000), "chars_per_word": rng.random(3000)}
    bad = ((columns["symbols_per_word"] > 0.8) & (columns["upper_share"] > 0.5)) | (columns["chars_per_word"] < 0.05)
    rules = quality_rules.learn(columns, bad)
    found = np.zeros(3000, bool)
    for rule in rules:
        found |= quality_rules._covers(rule, columns, np.ones(3000, bool))
    assert (found & bad).sum() >= 0.95 * bad.sum() and (found & ~bad).sum() <= 0.05 * bad.sum()
    assert quality_rules.learn(columns, np.zeros(3000, bool)) == [] == quality_rules.learn(columns, np.ones(3000, bool))


# -- near copies --------------------------------------------------------------------------------


def brute_classes(sets):
    root, links = {i: i for i in sets}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys, where = sorted(sets), {}
    for i in keys:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    for i in keys:
        both = Counter(j for s in sets[i] for j in where[s] if j > i)
        for j, n in both.items():
            if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in keys}, links


def shingles(text):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_jaccard_join_equals_brute_force(docs):
    want, links = brute_classes({r["doc_id"]: shingles(r["text"]) for r in docs.collect()})
    got = jaccard_classes(docs).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (c, links[i]) for i, c in want.items()}


def test_jaccard_join_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr("lectern.llm.banding.BLOCK_SETS", 16)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):   # one large group of near copies, some with twins, all different from the rest
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(80)] = f"new{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"other{i}x{k}" for k in range(40))) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want, links = brute_classes({i: shingles(t) for i, t in rows})
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_classes(frame).collect()}
    missed = sum(links[i] - got[i][1] for i in want)
    assert {i: c for i, (c, _) in got.items()} == want and missed == 0


def test_jaccard_edges(spark, odd, none):
    rows = jaccard_classes(odd).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and got[5]["class_id"] == 4 and got[4]["n_links"] == 1
    assert got[1]["class_id"] == 1 and got[1]["n_links"] == 0 == got[2]["n_links"] and got[None]["class_id"] is None
    assert got[6]["n_links"] == 1 and jaccard_classes(none).count() == 0
    kept = keep_one_of_each(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(6) == 1 and 5 not in ids and None in ids and 4 in ids


def test_bands_reach_their_recall():
    for similarity in (0.5, 0.8, 0.95):
        bands, rows = bands_for(similarity, 0.999, 256)
        assert 1 - (1 - similarity ** rows) ** bands >= 0.999


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for n, r in got.items():
        groups.setdefault(r, set()).add(n)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 160)), [200, 201]]


# -- repeated passages --------------------------------------------------------------------------


def brute_cut(rows):
    sets = {}
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if len(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", line.lower())) >= 30:
                sets[i, p] = shingles(line)
    root, _ = brute_classes(sets)
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if root.get((i, p), (i, p)) == (i, p)) for i, t in rows if t is not None}


def test_substring_dedup_equals_brute_force(docs):
    want = brute_cut([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: r["text"] for r in deduplicated(docs).collect()} == want


def test_substring_edges(spark, odd, none):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = spark.createDataFrame([(1, f"first\n{passage}\nlast"), (2, passage), (3, f"{passage} tail\nshort\n\n{passage}"),
                                  (4, "clean " + " ".join(f"q{i}" for i in range(60))), (5, None), (6, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in deduplicated(rows).collect()}
    assert got[1]["text"] == f"first\n{passage}\nlast" and got[1]["n_repeated"] == 1 and got[2]["text"] == ""
    assert got[3]["text"] == "short\n" and got[3]["n_removed"] == 2 and got[3]["class_docs"] == [1]
    assert got[4]["n_repeated"] == 0 and got[5]["text"] is None and got[6]["text"] == ""
    assert deduplicated(none).count() == 0
    cut = cut_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def runs_of(text, n=50):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def test_passages_over_short_lines_and_within_long_ones(spark):
    passage = [f"p{i}" for i in range(60)]
    lines = "\n".join(" ".join(passage[i:i + 10]) for i in range(0, 60, 10))
    other = [" ".join(f"{c}{i}" for i in range(250)) for c in "abcd"]
    whole = " ".join(passage)
    rows = [(1, f"{other[0]} {whole}. {other[1]}"), (2, f"start\n\n{lines}\nend"), (3, f"{other[2]}. {whole}; {other[3]}"),
            (4, " ".join(passage[:49])), (5, "again and " * 100), (6, None), (7, "P0 p1, " + ", ".join(passage[2:]).upper())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in deduplicated(frame, run_words=50).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    assert got[2]["text"] == "start\n\nend" and got[2]["n_removed"] == 1 and got[2]["class_docs"] == [1]
    assert got[3]["text"] == f"{other[2]}. {other[3]}" and got[3]["class_docs"] == [1]
    assert got[4]["text"] == rows[3][1] and got[7]["text"] == ""
    assert words(got[5]["text"]) == ["again", "and"] * 25 and got[6]["text"] is None
    assert {r["doc_id"]: r["text"] for r in cut_repeats(frame, run_words=50).collect()} == {i: r["text"] for i, r in got.items()}


def test_no_two_documents_share_a_run(docs):
    held = Counter()
    for r in deduplicated(docs, run_words=50).collect():
        held.update(runs_of(r["text"]))
    before = Counter()
    for r in docs.collect():
        before.update(runs_of(r["text"]))
    assert max(before.values()) > 1 and [r for r, n in held.items() if n > 1 and before[r] > 1] == []


def brute_both(rows, n=50):
    """Texts without near copies of paragraphs, and then without runs of words that occur earlier in what is left, by plain loops
    over words and lines."""
    left, first, out = brute_cut(rows), {}, {}
    for i, _ in rows:
        w = words(left.get(i))
        for p in range(len(w) - n + 1):
            first.setdefault(tuple(w[p:p + n]), (i, p))
    for i, _ in rows:
        t = left.get(i)
        if t is None:
            out[i] = None
            continue
        w, run = words(t), {}
        for p in range(len(w) - n + 1):
            doc, at = first[tuple(w[p:p + n])]
            if doc != i or p >= at + n:
                run.update({q: run.get(q, run.get(p, p)) for q in range(p, p + n)})
        kept, k = [], 0
        for line in t.split("\n"):
            spots = [m.start() for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", line)]
            mine = range(k, k + len(spots))
            k += len(spots)
            if not spots:
                if not (k - 1 in run and k in run and run[k - 1] == run[k]):
                    kept.append(line)
            elif not all(q in run for q in mine):
                ends = [*spots[1:], len(line)]
                kept.append(line[:spots[0]] + "".join(line[a:b] for q, a, b in zip(mine, spots, ends) if q not in run))
        out[i] = "\n".join(kept)
    return out


def test_both_kinds_of_passages_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    passage = " ".join(f"p{i}" for i in range(70))
    rows += [(10_000, f"one\n{passage}\n\nand {passage}, then\nend"), (10_001, "x " + passage.replace(" ", "\n\n")), (10_002, passage + " " + passage),
             (10_003, " ".join(passage.split()[:45]) + " other " + passage), (10_004, None), (10_005, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in deduplicated(frame, run_words=50).collect()}
    want = brute_both(rows)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


# -- licences -----------------------------------------------------------------------------------


def test_licences(spark, none):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [("a/LICENSE", "x\n" + mit), ("a/b/COPYING.txt", apache), ("a/b/c/d.py", "code\ncode"), ("a/e/f.py", "code"),
            ("g/h.py", "# " + apache + "\ncode"), ("top.py", "code"), (None, mit), ("a/b/z.py", None), ("a/b/z.py", None), ("i", "")]
    frame = spark.createDataFrame([(*r, "mine") for r in rows], "path string, text string, licence string")
    got = [(r["path"], r["licence"], r["found"], r["origin"]) for r in scan_licences(frame).collect()]
    assert sorted(got, key=repr) == sorted([
        ("a/LICENSE", "MIT", "header", None), ("a/b/COPYING.txt", "Apache-2.0", "file", None),
        ("a/b/c/d.py", "Apache-2.0", "inherited", "a/b"), ("a/e/f.py", "MIT", "inherited", "a"),
        ("g/h.py", "Apache-2.0", "header", None), ("top.py", None, "none", None), (None, "MIT", "header", None),
        ("a/b/z.py", "Apache-2.0", "inherited", "a/b"), ("a/b/z.py", "Apache-2.0", "inherited", "a/b"), ("i", None, "none", None)], key=repr)
    assert scan_licences(none.withColumn("path", F.lit("a"))).count() == 0


def test_licence_texts_and_wrapped_headers(spark):
    mit = """MIT License

Copyright (c) 2024 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
    apache = """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at"""
    rows = [("m/LICENSE", mit), ("m/x.py", "code"), ("b/LICENSE", "Copyright Some Body\n\n" + bsd), ("g/x.py", gpl + "\nimport os"),
            ("a/x.java", "/*\n" + apache + "\n */\nclass X {}"), ("o/x.md", "This tool was written over a long year by a few people "
             "and is released under the MIT License. It comes with a manual and some examples."), ("n/x.py", "plain words " * 60),
            ("k/2.py", gpl.replace("version 3", "version 2")), ("k/l.py", gpl.replace("GNU General", "GNU Lesser General"))]
    frame = spark.createDataFrame(rows, "path string, text string")
    got = {r["path"]: (r["licence"], r["found"]) for r in scan_licences(frame).collect()}
    assert got == {"m/LICENSE": ("MIT", "header"), "m/x.py": ("MIT", "inherited"), "b/LICENSE": ("BSD-3-Clause", "header"),
                   "g/x.py": ("GPL-3.0", "header"), "a/x.java": ("Apache-2.0", "header"), "o/x.md": ("MIT", "header"),
                   "n/x.py": (None, "none"),
                   "k/2.py": (None, "none"), "k/l.py": (None, "none")}


def test_licences_of_rows_and_kin(spark):
    """Rows of one path with other texts, kin on one line, and notices of kin in a row."""
    lgpl = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
            "License as published by the Free Software Foundation, either version 3 of the License. ")
    short = "This work is licensed under the GNU Lesser General Public License, version 3. "
    rows = [("a/x.txt", "Released under the MIT License."), ("a/x.txt", "nothing here"), ("b/y.txt", "Licensed under CC BY-NC-ND 4.0."),
            ("c/z.txt", lgpl * 2), ("d/z.txt", short * 3), ("e/long.txt", "word " * 200_000 + "released under the mit license. " + "tail " * 1000),
            ("f/n.txt", "Licensed under CC BY-NC 4.0.")]
    got = sorted((r["path"], r["licence"] or "", r["found"]) for r in scan_licences(spark.createDataFrame(rows, "path string, text string")).collect())
    assert got == [("a/x.txt", "", "none"), ("a/x.txt", "MIT", "header"), ("b/y.txt", "", "none"), ("c/z.txt", "", "none"), ("d/z.txt", "", "none"),
                   ("e/long.txt", "MIT", "header"), ("f/n.txt", "CC-BY-NC-4.0", "header")]


def test_licences_on_odd_rows(odd, none):
    files = odd.withColumn("path", F.concat(F.lit("f/"), "doc_id"))
    got = scan_licences(files)
    assert got.count() == odd.count() and got.filter("licence IS NOT NULL").isEmpty()
    assert scan_licences(none.withColumn("path", F.lit("f"))).columns == got.columns


def test_anchors_miss_nothing():
    idf, other, rows = weights()
    hint = set(anchors(rows, 0.75))
    rng = random.Random(0)
    for _, text in TEMPLATES:
        for _ in range(200):
            bag = Counter(t for t in terms(text) if rng.random() < 0.6)
            norm = sum((n * idf[t]) ** 2 for t, n in bag.items()) ** 0.5
            for k in {r[0] for r in rows}:
                dot = sum(bag[t] * idf[t] * w for j, _, t, w in rows if j == k)
                assert not norm or dot / norm < 0.75 or hint & set(bag)


# -- search -------------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 12).round(2)]) for i in range(300)]
    rows += [(300, None), (301, [0.1, None] + [0.0] * 10), (302, [float("nan")] * 12), (303, [float("inf")] * 12), (304, [0.5] * 4),
             (20, rows[20][1]), (305, rows[7][1]), (306, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    vectors = quantised(frame)
    got = {}
    for r in top_k(vectors, vectors.filter("vec_id % 20 = 0"), 5, query_block=6).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in {(i, tuple(v)) for i, v in whole if i % 20 == 0}:
        best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q))[:5]
        assert [got[q][k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert top_k(vectors.limit(0), vectors.limit(0)).count() == 0


# -- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    from lectern.session import materialize
    for first in (odd, none):
        rows = first
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, rows, BASE), "stage")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == rows.columns, name
            rows = out
    assert rows.count() == 0


def test_pipeline_on_documents(spark, docs):
    packed = corpus_pipeline.run(spark, BASE).collect()
    kept = {r["doc_id"] for r in packed}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()}
    assert sum(labels[i] == 0 for i in kept if i in labels) <= 0.1 * sum(q == 0 for q in labels.values())
    classes = {r["doc_id"]: r["class_id"] for r in jaccard_classes(docs.filter(F.col("doc_id").isin(list(kept)))).collect()}
    assert all(i == c for i, c in classes.items())
