"""Extraction, chunking and text functions on written cases."""
import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lectern.functions import extract as ex
from lectern.functions import lexical as lx
from lectern.functions import text as tx
from lectern.operators import build


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,want", [
    ("due 2026-05-17.", ["2026-05-17"]), ("752657234_20260517_034.pdf", ["2026-05-17"]), ("5/4/26 and 12/31/1999", ["2026-05-04", "1999-12-31"]),
    ("on 1/2/70", ["1970-01-02"]), ("January 5, 2026; 6 Feb 2026; Sept 3rd 2025", ["2026-01-05", "2026-02-06", "2025-09-03"]),
    ("2026-02-30 and 20261234 and 13/45/2020", []), ("120260517 18880101", []), ("", []), ("no dates", []),
])
def test_dates(spark, text, want):
    assert [d["date"].isoformat() for d in one(spark, ex.extract_dates, text)] == want


def test_date_offsets_count_code_points(spark):
    text = "é𝒳ü 2026-05-17 — May 1, 2025"
    for d in one(spark, ex.extract_dates, text):
        assert text[d["start"]:d["end"]] == d["raw_span"]


@pytest.mark.parametrize("text,want", [
    ("Fuel surcharge $8.95", [("8.95", "USD", False, "surcharge")]), ("credit ($ 12.50) given", [("12.50", "USD", True, "credit")]),
    ("paid 1,234.56 EUR", [("1234.56", "EUR", False, "paid")]), ("£5 and €6.25", [("5", "GBP", False, "and"), ("6.25", "EUR", False, "and")]),
    ("total $1,234,567.89", [("1234567.89", "USD", False, "total")]), ("$1234.56", [("1234.56", "USD", False, None)]), ("10 EA", []),
])
def test_money(spark, text, want):
    got = [(m["value"], m["currency"], m["is_negative"], m["context_hint"]) for m in one(spark, ex.extract_currency, text)]
    assert got == [(Decimal(v).quantize(Decimal("0.0001")), c, n, h) for v, c, n, h in want]


def test_money_three_digits_first(spark):
    got = one(spark, lambda c: ex.extract_currency(c, three_digits_first=True), "$1234.56")
    assert got[0]["value"] == Decimal("123")


def test_money_presets(spark):
    text = "state fee $2.00 and tip $3.00 and tax $4.00"
    got = one(spark, lambda c: ex.extract_currency(c, ("state_fee", "tip")), text)
    assert [m["value"] for m in got] == [Decimal(2), Decimal(3)]


def test_mentions_longest_first(spark):
    text = "Acme Portland sent it. ACME paid Acme portland! fine"
    got = one(spark, lambda c: ex.entity_mentions(c, "Acme Portland", ["acme", "ACME PORTLAND"]), text)
    assert [m["matched_text"] for m in got] == ["Acme Portland", "ACME", "Acme portland"]
    assert got[1]["context"] == "ACME paid Acme portland!"


def test_discover_entities(spark):
    text = "The Big House met Ada Lovelace. ada LOVELACE met Ada Lovelace in March at UK"
    assert one(spark, ex.discover_entities, text) == ["Ada Lovelace", "LOVELACE", "UK"]


def test_small_functions(spark):
    assert one(spark, tx.join_single_char_runs, "x\nS\nP\nT\nrow\na\nb") == "x S P T\nrow\na\nb"
    assert one(spark, tx.source_slug, "PDF: 2026 Annual Report v2") == "2026-annual-report-v2"
    assert one(spark, tx.source_link, "a]b|c") == "[a\\]b\\|c](vps://source/a-b-c)"
    assert one(spark, tx.source_link, "***") == "***"
    assert one(spark, tx.label_line, "name (part 1/2)\nbody") == "name"
    assert one(spark, lx.simple_stem, "Buildings") == "build"
    assert one(spark, lambda c: lx.keyword_match("running", c), "he runs, and runn; stops") is True
    assert one(spark, lx.clean_query, "what is the") == "what is the"
    assert one(spark, lambda c: tx.snippet(c, 10), "abcdefghij klm") == "abcdefghij…"


def loop_chunks(text, size, overlap):
    rows, out, i = text.split("\n"), [], 0
    wc = [len(r.split()) for r in rows]
    if sum(wc) <= size:
        return [text]
    while True:
        j, n = i, 0
        while j < len(rows) and (n == 0 or n + wc[j] <= size):
            n, j = n + wc[j], j + 1
        if "\n".join(rows[i:j]).strip():
            out.append("\n".join(rows[i:j]).strip())
        if j == len(rows):
            return out
        b, n = j, 0
        while b > i + 1 and n < overlap:
            b, n = b - 1, n + wc[b - 1]
        i = b


def test_line_chunks_random():
    rng = random.Random(2)
    for _ in range(400):
        rows = [" ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 0, 1, 3, 9, 30]))) for _ in range(rng.randint(1, 30))]
        text, size, overlap = "\n".join(rows), rng.randint(1, 25), rng.randint(0, 12)
        got = build.line_chunks(text, size, overlap)
        assert got == loop_chunks(text, size, overlap)
        kept = {line for piece in got for line in piece.split("\n")}
        assert all(r.strip() == "" or r in kept or r.strip() in kept for r in rows)


def test_char_chunks():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("ab \n" if rng.random() < .5 else "abcdefgh") for _ in range(rng.randint(1, 300)))
        limit = rng.randint(4, 40)
        got = build.char_chunks(text, limit)
        assert all(len(p) <= limit for p in got) or got == [text]
        assert "".join("".join(got).split()) == "".join(text.split())


def test_merge_map():
    assert build.merge_map(4, {(0, 1), (1, 2)}) == [0, 1, 2, 2]
    assert build.merge_map(3, set()) == [0, 0, 0]


def test_first_date_falls_back_to_source(spark):
    df = spark.createDataFrame([("none", "inv-20240105.pdf")], "text string, source string")
    assert df.select(ex.first_date(F.col("text"), F.col("source")).alias("d")).first()["d"] == datetime.date(2024, 1, 5)


def test_table_functions_give_the_spans_of_the_columns(spark, tables):
    """Every row of the SQL table functions, also on texts with quotes, brackets and nothing to find."""
    from lectern.functions import extract as ex
    from lectern.functions import sqlfuncs
    sqlfuncs.register(spark)
    sqlfuncs.register_mentions(spark, "find_goods", "Goods", ("o'neil (ltd) + 'x'", "Invoice"))
    odd = [(1, None), (2, ""), (3, "O'Neil (ltd) + 'x' paid ($3.50) on 20240102, 1/2/99"), (4, "no digit; GOODS, goods\\n and Invoice"), (5, "€ 4, £5.00 and 1,000 USD")]
    rows = tables.invoices.select("idx", "text").limit(80).union(spark.createDataFrame(odd, "idx bigint, text string"))
    for name, spans in (("extract_dates", ex.extract_dates(F.col("text"))), ("extract_currency", ex.extract_currency(F.col("text"))),
                        ("find_goods", ex.entity_mentions(F.col("text"), "Goods", ("o'neil (ltd) + 'x'", "Invoice")))):
        want = rows.select("idx", F.explode(spans).alias("s")).select("idx", "s.*")
        got = spark.sql(f"SELECT p.idx, f.* FROM {{p}} p, LATERAL {name}(text) f", p=rows)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and not want.isEmpty()
    want = rows.select("idx", F.explode(ex.discover_entities(F.col("text"))).alias("entity"))
    got = spark.sql("SELECT p.idx, f.entity FROM {p} p, LATERAL discover_entities(text) f", p=rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_flatten_json(spark):
    from lectern.sources import documents
    deep = "[" * 9 + '{"x": "end"}' + "]" * 9
    cases = [('{"b": {"z": [1, {"q": "x\\ny"}], "a": null}, "a b": true, "f": 1.50, "e": 1e5, "em": {}, "el": []}',
              "a b: True\nb.a: None\nb.z[0]: 1\nb.z[1].q: x\ny\ne: 100000.0\nf: 1.5"),
             (deep, "[0]" * 9 + ".x: end"), ("[1, [2, 3]]", "[0]: 1\n[1][0]: 2\n[1][1]: 3"), ('"alone"', "alone"), ("7", "7"), ("{}", ""),
             ("{not json", "{not json"), ("", ""), (None, None), ('{"s": "{\\"not\\": \\"opened\\"}"}', 's: {"not": "opened"}'),
             ('{"a": 1, "a": 2}', '{"a": 1, "a": 2}'), ("[" + ", ".join(map(str, range(12))) + "]", "\n".join(f"[{i}]: {i}" for i in range(12)))]
    rows = spark.createDataFrame([(i % 5, c, "kept") for i, (c, _) in enumerate(cases)], "id int, raw string, at string").repartition(3)
    flat = documents.flatten_json(rows, "raw")
    assert flat.columns == ["id", "raw", "at", "lines"]
    assert sorted(map(str, ((r.raw, r.lines) for r in flat.collect()))) == sorted(map(str, cases))
    assert "ython" not in flat._jdf.queryExecution().toString()


def test_first_content_line_keeps_digits_at_its_ends(spark):
    assert one(spark, tx.first_content_line, "0997 of 10 and 20") == "0997 of 10 and 20"
    assert one(spark, tx.first_content_line, "notes.md\n  11 lines in 101  \n2") == "11 lines in 101"
