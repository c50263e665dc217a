"""The burst trie against a plain one."""
import hashlib
import random
import zlib

import pytest

from lectern.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner int"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))

    def code(x):
        return hashlib.md5(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).hexdigest()[:30]

    first = {c: [x[1:] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, code(x)))] for c, v in convs.items()}
    nodes = {}
    for c, own in first.items():
        h = zlib.crc32(str(c).encode()) % 9
        full = first.get(c - int(c - 5 * int(c / 5)), [])[:h] + own[h:]
        for d in range(len(full) + 1):
            node = nodes.setdefault(tuple(full[:d]), ([], []))
            node[0].append(c)
            if d == len(full):
                node[1].append(c)
    out, totals = [], {}
    for path in sorted(nodes, key=len, reverse=True):
        below = [p for p in nodes if len(p) == len(path) + 1 and p[:-1] == path] if len(nodes) < 400 else kids(nodes).get(path, [])
        leaves = sum(totals[p][0] for p in below) or 1
        saved = sum(totals[p][1] for p in below) + (len(nodes[path][0]) - 1) * (len(path[-1][1].encode()) if path else 0)
        totals[path] = leaves, saved
        members, ends = nodes[path]
        out.append((min(members), len(path), min(nodes[path[:-1]][0]) if path else None, len(members), len(below), leaves, saved,
                    hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()))
    return sorted(map(str, out))


def kids(nodes, kept={}):
    if kept.get("of") is not nodes:
        by = {}
        for p in nodes:
            if p:
                by.setdefault(p[:-1], []).append(p)
        kept.update({"of": nodes, "by": by})
    return kept["by"]


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    assert sorted(map(str, (tuple(r) for r in prefix_trie(df, **more).collect()))) == brute(rows)


def talk(rng, conv, length, few):
    return [(conv, t, rng.choice(["user", "assistant"]), rng.choice(few)) for t in range(length)]


@pytest.mark.parametrize(("span", "most"), [(8, 4096), (8, 5), (2, 3), (3, 1)])
def test_random_conversations(spark, span, most):
    rng = random.Random(span * 100 + most)
    rows = [r for c in range(90) for r in talk(rng, c * 3 - 60, rng.randrange(0, 9), ["a", "b", "é"])]
    check(spark, rows, span=span, most=most)


def test_long_and_equal_conversations(spark):
    rng = random.Random(9)
    long = talk(rng, 0, 150, ["x", "y"])
    rows = [(c, *r[1:]) for c in range(0, 70, 5) for r in long[:150 - c]]                 # each a prefix of the other
    rows += [(c, *r[1:]) for c in range(100, 200, 5) for r in long[:16]]                   # equal, ending between suffixes
    rows += [(c, t, "user", f"own {c} {t}") for c in range(201, 204) for t in range(24)]
    check(spark, rows, span=8, most=4)
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "no conversation"), (1, None, None, None), (1, 2, "user", ""), (1, 2, "user", ""), (1, 2, "", "user"), (1, 2, None, "user"),
            (2, 1, "user", "gone: nothing before it"), (5, 3, "b", "later"), (5, 1, "b", "long " * 5000), (5, 1, "a", "long " * 5000), (6, 1, "a", "x"),
            (7, 1, "a", "x"), (8, 9, "a", "x"), (-7, 1, "a", "x"), (-5, 1, "b", "y"), (-5, 2, "b", "z"), (10 ** 15, 1, "a", "x")]
    check(spark, rows)
    check(spark, rows, span=2, most=1)
    check(spark, [])
    check(spark, [(3, 1, "a", "x")])
